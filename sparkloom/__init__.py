"""A declarative dataset-rewriting engine on Spark DataFrames."""
