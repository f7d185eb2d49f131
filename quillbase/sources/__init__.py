"""Versioned tables, catalog, indexes and page files on any file system that Spark reaches."""
