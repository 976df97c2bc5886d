"""Writers and their guards. These are the only actions."""
