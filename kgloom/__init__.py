"""Knowledge-graph and retrieval analytics on Spark DataFrames."""
