"""Spreadsheet-semantics analytics on Spark."""
