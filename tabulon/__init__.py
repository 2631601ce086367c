"""Analytics over sectioned, delimited exports and tables of text, expressed with Spark's DataFrame operations."""
