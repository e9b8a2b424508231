"""quillon: time-series summaries, text-pair scoring and evaluation on Spark DataFrames."""
