"""Attribute and function tables, and their Spark expressions."""
