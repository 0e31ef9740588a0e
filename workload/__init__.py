"""Queries over the generated test tables, and the SQL they are checked against."""
