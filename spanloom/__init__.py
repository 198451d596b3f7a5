"""Text-span alignment and annotation on Spark DataFrames."""
