"""Housing-market analytics on PySpark: sources, cleaning, statistics, text, geography, streams."""
