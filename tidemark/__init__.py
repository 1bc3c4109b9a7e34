"""Point-in-time market analytics and training-data operators on Spark DataFrames."""
