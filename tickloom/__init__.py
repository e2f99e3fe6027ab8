"""Event-replay analytics as Spark DataFrame operators."""
