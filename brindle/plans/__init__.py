"""Queries over the driver's tables, each a thin use of the library's operators."""
