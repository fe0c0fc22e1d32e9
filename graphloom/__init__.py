"""Property-graph queries and their checks on PySpark."""
