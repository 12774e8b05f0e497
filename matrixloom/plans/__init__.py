"""Queries composed of the operators: all that are registered, by name, and their SQL."""

from . import large, queries, texts

QUERIES = queries.QUERIES | large.QUERIES | texts.QUERIES
SQL = queries.SQL | large.SQL | texts.SQL
