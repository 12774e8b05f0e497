"""matrixloom: combinatorial matrix analytics on Spark DataFrames.

A collection of small matrices is a pair of tables, ``dims(mid, m, n)`` and
``entries(mid, r, c, v)``; every operator takes such a collection and returns
DataFrames keyed by ``mid``.  See README.md for the layout.
"""
