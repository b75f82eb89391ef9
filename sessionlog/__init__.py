"""Analytics over coding-assistant session logs, as ordinary Spark DataFrames."""
