"""DuckDB statements that the Spark queries are compared with."""
