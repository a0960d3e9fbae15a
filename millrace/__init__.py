"""Millrace: warehouse pipelines and SQL-corpus lineage as Spark jobs."""
