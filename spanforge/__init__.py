"""Text-pattern analytics on Spark."""
