"""framegraph: stream-graph analytics on Spark DataFrames."""
