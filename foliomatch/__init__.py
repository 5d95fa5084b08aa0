"""Near-duplicate detection and analytics over ordered collections, on PySpark."""
