"""Ledger analytics and data-quality engine on PySpark."""
