"""Document analytics and corpus preparation on Spark."""
