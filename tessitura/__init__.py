"""Time-series pattern mining, similarity graphs and classification on Spark DataFrames."""
