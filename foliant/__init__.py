"""foliant: document analytics and keyword retrieval as ordinary Spark DataFrames."""
