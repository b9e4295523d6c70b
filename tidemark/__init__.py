"""Incremental table loads, run ledgers and training-data jobs as plain Spark DataFrame work."""
