"""tastegrid: review-log analytics, retrieval indexes and ranking on Spark DataFrames."""
