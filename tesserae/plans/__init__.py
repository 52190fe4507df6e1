"""Queries over the test tables, each with SQL that it is held against."""
