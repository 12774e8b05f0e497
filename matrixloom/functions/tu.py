"""Total unimodularity of single matrices by enumeration."""

from __future__ import annotations

from functools import cache
from itertools import combinations

from .exact import Dense, transposed


def ternary_witness(a: Dense) -> tuple[int, int] | None:
    return next(((i, j) for i, row in enumerate(a) for j, v in enumerate(row) if v not in (-1, 0, 1)), None)


def by_partition(a: Dense) -> bool:
    """Ghouila-Houri: each set of rows splits in two with column sums that differ by at
    most one.  A search over signs, set by set, on the smaller side."""
    if not a or not a[0]:
        return True
    if ternary_witness(a):
        return False
    if len(a) > len(a[0]):
        a = transposed(a)
    n = len(a[0])

    def splits(rows: list[list[int]], sums: list[int], todo: int) -> bool:
        if todo == len(rows):
            return all(-1 <= s <= 1 for s in sums)
        for sign in (1, -1) if todo else (1,):
            new = [s + sign * v for s, v in zip(sums, rows[todo])]
            if all(abs(s) <= 1 + left[todo + 1][j] for j, s in enumerate(new)) and splits(rows, new, todo + 1):
                return True
        return False

    for mask in range(1, 1 << len(a)):
        rows = [a[i] for i in range(len(a)) if mask >> i & 1]
        left = [[sum(abs(r[j]) for r in rows[k:]) for j in range(n)] for k in range(len(rows) + 1)]
        if not splits(rows, [0] * n, 0):
            return False
    return True


@cache
def _parts(p: int, q: int) -> list[int]:
    """For a column with 1 in the rows ``p`` and -1 in ``q`` (of five): of each set of rows the
    parts, as bits, over which and over the rest of it its sums differ by at most one."""
    total = lambda x: (p & x).bit_count() - (q & x).bit_count()
    return [sum(1 << h for h in range(32) if h & s == h and abs(total(s & ~h) - total(h)) <= 1) for s in range(32)]


def by_masks(a: Dense) -> bool:
    """As :func:`by_partition`, of -1, 0 and 1 with at most five rows or columns, by tables."""
    if len(a) > len(a[0]):
        a = transposed(a)
    columns = [_parts(p, q) for p, q in {tuple(sum(1 << i for i, v in enumerate(c) if v == x) for x in (1, -1)) for c in zip(*a)}]
    for s in range(1, 1 << len(a)):
        fit = -1
        for parts in columns:
            fit &= parts[s]
        if not fit:
            return False
    return True


def eulerian_violator(a: Dense) -> tuple[list[int], list[int]] | None:
    """Rows and columns of a submatrix of least order with an even number of nonzeros in
    each row and column whose sum isn't a multiple of four, or None (Camion)."""
    if w := ternary_witness(a):
        return [w[0]], [w[1]]
    m, n = len(a), len(a[0]) if a else 0
    for k in range(2, min(m, n) + 1):
        for rows in combinations(range(m), k):
            cols = [j for j in range(n) if 0 < sum(a[i][j] != 0 for i in rows) and sum(a[i][j] != 0 for i in rows) % 2 == 0]
            for some in combinations(cols, k):
                if all(sum(a[i][j] != 0 for j in some) % 2 == 0 for i in rows) and sum(a[i][j] for i in rows for j in some) % 4:
                    return list(rows), list(some)
    return None


def by_eulerian(a: Dense) -> bool:
    return eulerian_violator(a) is None


def minimal_violator(a: Dense, holds) -> tuple[list[int], list[int]] | None:
    """A submatrix for which the hereditary property ``holds`` fails and whose own
    submatrices all have it: chunks are tried first, then single lines, last to first
    and rows before columns.  None if the property holds."""
    rows, cols = list(range(len(a))), list(range(len(a[0]) if a else 0))

    def fails(r: list[int], c: list[int]) -> bool:
        return bool(r and c) and not holds([[a[i][j] for j in c] for i in r])

    if not fails(rows, cols):
        return None
    for parts in (16, 8, 4):
        for axis in (0, 1):
            side = (rows, cols)[axis]
            size = -(-len(side) // parts)
            for k in range(0, len(side), size) if len(side) > 8 else ():
                piece = side[k : k + size]
                if fails(*((piece, cols) if axis == 0 else (rows, piece))):
                    rows, cols = (piece, cols) if axis == 0 else (rows, piece)
                    break
    for i in reversed(list(rows)):
        if fails(less := [x for x in rows if x != i], cols):
            rows = less
    for j in reversed(list(cols)):
        if fails(rows, less := [x for x in cols if x != j]):
            cols = less
    return rows, cols
