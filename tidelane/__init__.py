"""tidelane: Spark-first operators for agent-training and evaluation data."""
