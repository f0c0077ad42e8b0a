"""Credit-risk analytics as DataFrame operators on Spark."""
