"""Quote-tick analytics on PySpark: DataFrames in, DataFrames out."""
