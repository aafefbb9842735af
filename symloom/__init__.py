"""symloom: code-index analytics as Spark jobs."""
