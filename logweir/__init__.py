"""Analytics over partitioned, append-only record logs, as Spark DataFrames."""
