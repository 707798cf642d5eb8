"""Registered queries over the test tables, each with its SQL for DuckDB where SQL can say it."""
