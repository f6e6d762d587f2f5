"""Text-outcome analytics on Spark."""
