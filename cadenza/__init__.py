"""Sample-accurate analytics over time series and framed streams, on Spark DataFrames."""
