"""Graph-pattern, set-algebra and edge-layout analytics on Spark DataFrames."""
