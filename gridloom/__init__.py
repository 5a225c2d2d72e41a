"""Block models and text corpora on Spark DataFrames."""
