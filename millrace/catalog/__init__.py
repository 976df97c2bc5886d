"""Pipeline exports as tables: steps, links, parameters, settings."""
