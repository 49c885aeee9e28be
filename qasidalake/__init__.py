"""Arabic verse search and corpus preparation on Spark."""
