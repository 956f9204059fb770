"""Batch ingest, mart building, serving and run-ledger analytics on Spark DataFrames."""
