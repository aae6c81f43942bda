"""weftgraph: similarity-network analytics and corpus processing on Spark DataFrames."""
