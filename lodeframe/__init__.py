"""lodeframe: dictionary-driven record recognition, lineage planning and time-ordered analytics on Spark DataFrames."""
