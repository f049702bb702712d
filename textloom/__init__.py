"""Web-text analytics on Spark DataFrames."""
