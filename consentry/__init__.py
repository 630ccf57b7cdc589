"""Privacy-policy analytics over event and text data, on Spark DataFrames."""
