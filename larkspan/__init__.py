"""larkspan: set-at-a-time retrieval and knowledge analytics as Spark DataFrame plans."""
