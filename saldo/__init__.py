"""Ledger analytics on Spark: envelope ingestion, merges and ledger queries as DataFrames."""
