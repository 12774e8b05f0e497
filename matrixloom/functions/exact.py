"""Exact arithmetic on single dense matrices (lists of rows)."""

from __future__ import annotations

from fractions import Fraction

Dense = list[list[int]]


def transposed(a: Dense) -> Dense:
    return [list(c) for c in zip(*a)]


def determinant(a: Dense) -> int:
    """By fraction-free elimination."""
    a, n, sign, last = [list(map(int, r)) for r in a], len(a), 1, 1
    for k in range(n - 1):
        if not a[k][k]:
            other = next((i for i in range(k + 1, n) if a[i][k]), None)
            if other is None:
                return 0
            a[k], a[other], sign = a[other], a[k], -sign
        for i in range(k + 1, n):
            for j in range(k + 1, n):
                a[i][j] = (a[i][j] * a[k][k] - a[i][k] * a[k][j]) // last
            a[i][k] = 0
        last = a[k][k]
    return sign * a[-1][-1] if n else 1


def upper_diagonal(a: Dense) -> list[int]:
    """Pivots of an echelon form that whole-number row operations of determinant 1
    reach (Euclid's algorithm in each column)."""
    a, top, out = [list(map(int, r)) for r in a], 0, []
    for j in range(len(a[0]) if a else 0):
        while True:
            live = [i for i in range(top, len(a)) if a[i][j]]
            if not live:
                break
            low = min(live, key=lambda i: abs(a[i][j]))
            a[top], a[low] = a[low], a[top]
            rest = [i for i in range(top + 1, len(a)) if a[i][j]]
            if not rest:
                out.append(a[top][j])
                top += 1
                break
            for i in rest:
                f = a[i][j] // a[top][j]
                a[i] = [x - f * y for x, y in zip(a[i], a[top])]
    return out


def independent(a: Dense) -> tuple[list[int], list[int]]:
    """Rows and columns of a nonsingular submatrix of full rank, greedily."""
    rows, basis, cols = [], [], []
    for i, row in enumerate(a):
        x = [Fraction(v) for v in row]
        for j, b in zip(cols, basis):
            if x[j]:
                x = [u - x[j] * w for u, w in zip(x, b)]
        lead = next((j for j, v in enumerate(x) if v), None)
        if lead is not None:
            x = [v / x[lead] for v in x]
            basis = [[u - b[lead] * w for u, w in zip(b, x)] for b in basis] + [x]
            cols.append(lead)
            rows.append(i)
    return rows, cols


def solve(basis: Dense, right: Dense) -> list[list[Fraction]] | None:
    """X with ``basis`` X = ``right``, or None if ``basis``' columns are dependent or
    there is none."""
    m, k = len(basis), len(basis[0]) if basis else 0
    a = [[Fraction(v) for v in (*basis[i], *right[i])] for i in range(m)]
    top = 0
    for j in range(k):
        p = next((i for i in range(top, m) if a[i][j]), None)
        if p is None:
            return None
        a[top], a[p] = a[p], a[top]
        a[top] = [v / a[top][j] for v in a[top]]
        for i in range(m):
            if i != top and a[i][j]:
                f = a[i][j]
                a[i] = [u - f * w for u, w in zip(a[i], a[top])]
        top += 1
    if any(any(row[k:]) for row in a[top:]):
        return None
    return [row[k:] for row in a[:k]]


def rank_mod2(rows: list[int]) -> int:
    """Rank over the field of two of rows given as bits."""
    basis: list[int] = []
    for x in rows:
        for b in basis:
            x = min(x, x ^ b)
        if x:
            basis.append(x)
    return len(basis)
