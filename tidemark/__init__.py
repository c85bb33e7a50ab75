"""A Spark-native analytics engine: SQL with a MySQL accent, copy-on-write tables, and DataFrame query surfaces."""
