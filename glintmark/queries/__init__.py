"""Registered queries: each a Spark function and, where SQL can say it, the same in SQL."""
