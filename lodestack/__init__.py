"""lodestack: listing ingestion, change tracking and analytics on Spark DataFrames."""
