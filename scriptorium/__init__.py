"""Text-quality analytics on PySpark DataFrames."""
