"""Document-flow operators for Spark: scan, parse, map, route, join, load and archive."""
