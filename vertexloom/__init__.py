"""Graph analytics on Spark DataFrames: analyses of typed sub-graphs, vertex programs and recommendations."""
