"""patchlens: risk review of code-change sets as Spark DataFrames."""
