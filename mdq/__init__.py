"""Market-data analytics on PySpark: plain functions from DataFrame to DataFrame."""
