"""Document conversion and corpus analytics on Spark."""
