"""Text de-identification analytics on Spark."""
