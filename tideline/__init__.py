"""tideline: dense co-occurrence mining and event attribution on Spark DataFrames."""
