"""Market analytics on Spark DataFrames: bars, factors, research, ledgers and streams."""
