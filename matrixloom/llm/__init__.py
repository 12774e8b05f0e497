"""Operators of a training-data pipeline (dedup, scoring, mixing, encoding ...).

Nothing outside this subpackage imports it.
"""
