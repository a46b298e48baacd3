"""Query to query rewrites, caching and dispatch."""
