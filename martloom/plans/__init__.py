"""Registered queries over the driver tables, each with the SQL that checks it."""

from martloom.plans import exports, ingest, intervals, ledger, mart, scalars, serving

MODULES = (serving, mart, intervals, ingest, ledger, scalars, exports)

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
