"""Readers: relational tables, month-partitioned Parquet, job records, ledger tables."""
