"""Distribution, structure and change analytics on Spark."""
