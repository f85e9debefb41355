"""Agent-history analytics on Spark: records, timelines, search, sessions and ingestion as DataFrames."""
