"""Security-log analytics and training-data operators written for Spark."""
