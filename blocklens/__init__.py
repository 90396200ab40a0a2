"""Analytics over block-storage metadata, expressed as Spark DataFrames."""
