"""Entry predicates and largest binary or ternary submatrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Dense, Matrices, per_matrix


def _verdict(ms: Matrices, bad: Column, name: str) -> DataFrame:
    """``mid, <name>, bad_r, bad_c``: whether no entry is bad, else the first in row
    order."""
    found = ms.entries.groupBy("mid").agg(F.min(F.when(bad, F.struct("r", "c"))).alias("w"))
    return ms.dims.select("mid").join(found, "mid", "left").select("mid", F.col("w").isNull().alias(name), F.col("w.r").alias("bad_r"), F.col("w.c").alias("bad_c"))


def is_binary(ms: Matrices, eps: float = 0.0) -> DataFrame:
    return _verdict(ms, (F.abs(F.col("v")) > eps) & (F.abs(F.col("v") - 1) > eps), "is_binary")


def is_ternary(ms: Matrices, eps: float = 0.0) -> DataFrame:
    return _verdict(ms, (F.abs(F.col("v")) > eps) & (F.abs(F.abs("v") - 1) > eps), "is_ternary")


def is_integer(ms: Matrices, eps: float = 1e-9) -> DataFrame:
    return _verdict(ms, F.abs(F.col("v") - F.round("v")) > eps, "is_integer")


def shrink(matrix: Dense, bad: Callable[[float], bool]) -> tuple[list[int], list[int]]:
    """Drop the row or column with the most bad entries until none is left; a row goes
    before a column with as many, and of equals the first."""
    rows = {i: sum(map(bad, row)) for i, row in enumerate(matrix)}
    cols = {j: sum(bad(row[j]) for row in matrix) for j in range(len(matrix[0]) if matrix else 0)}
    while any(rows.values()):
        i, j = max(rows, key=lambda x: (rows[x], -x)), max(cols, key=lambda x: (cols[x], -x))
        if rows[i] >= cols[j]:
            del rows[i]
            for x in cols:
                cols[x] -= bad(matrix[i][x])
        else:
            del cols[j]
            for x in rows:
                rows[x] -= bad(matrix[x][j])
    return sorted(rows), sorted(cols)


def large_submatrix(ms: Matrices, ternary: bool = False, eps: float = 1e-9) -> DataFrame:
    """``mid, rows, cols`` of a large binary (or ternary) submatrix."""

    def bad(v: float) -> bool:
        return min(abs(v), abs(v - 1), abs(v + 1) if ternary else 2.0) > eps

    return per_matrix(ms, lambda mid, a: [(mid, *shrink(a, bad))], "mid long, rows array<int>, cols array<int>")
