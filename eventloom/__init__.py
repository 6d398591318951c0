"""Event-catalogue analytics on PySpark: DataFrame-in, DataFrame-out operators."""
