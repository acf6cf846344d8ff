"""Cache analytics on Spark: a command log is the fact table, cache state is a query over it."""

__version__ = "0.1.0"
