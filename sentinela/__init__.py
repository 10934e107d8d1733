"""Text-safety analytics on Spark."""
