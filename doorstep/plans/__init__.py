"""Query registry, Spark SQL twins and the DuckDB oracle text."""
