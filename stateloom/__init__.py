"""stateloom: Spark-first analytics over the recorded state of large workflow campaigns."""
