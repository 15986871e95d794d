"""Security review of source files, diffs and change events as Spark jobs."""
