"""Registered queries: each has a Spark plan over the given tables and, where SQL can say it, an oracle."""
