"""foliant: document-capture analytics on Spark DataFrames."""
