"""A relational query and data-manipulation engine on PySpark DataFrames."""
