"""Taking matrices apart along 3-separations: delta-sums, Y-sums and 3-sums.

A part is given by the rows and columns of the first matrix; the matrix is then
[A B; C D] with A the first part's.
"""

from __future__ import annotations

from itertools import combinations

from .exact import Dense, transposed
from .sums import path_sum
from .tu import by_partition


def _rest(a: Dense, rows: list[int], cols: list[int]) -> tuple[list[int], list[int]]:
    return [i for i in range(len(a)) if i not in rows], [j for j in range(len(a[0])) if j not in cols]


def _representatives(a: Dense, rows: list[int], cols: list[int]) -> tuple[int, int]:
    """A row of C and a column of B that aren't zero."""
    r2, c2 = _rest(a, rows, cols)
    low = next((i for i in r2 if any(a[i][j] for j in cols)), None)
    right = next((j for j in c2 if any(a[i][j] for i in rows)), None)
    if low is None or right is None:
        raise ValueError("INPUT: an off-diagonal block is zero")
    return low, right


def delta_epsilon(a: Dense, rows: list[int], cols: list[int]) -> int:
    """The sign that closes a cycle through the first part to a multiple of four."""
    low, right = _representatives(a, rows, cols)
    start, end = [-1 - i for i in rows if a[i][right]], [1 + j for j in cols if a[low][j]]
    found = path_sum(a, rows, cols, start, end)
    if found is None:
        raise ValueError("INPUT: the first part isn't connected")
    total, x, y = found
    best = total + a[-1 - x][right] + a[low][y - 1]
    return -1 if best % 4 == 1 else 1


def delta_parts(a: Dense, rows: list[int], cols: list[int], epsilon: int | None = None) -> tuple[Dense, Dense]:
    """[A a a; c 0 e] and [e 0 b; d d D] for B = a b and C = d c, whose delta-sum is the
    matrix (special lines: the first's last row and last two columns, the second's first)."""
    epsilon = delta_epsilon(a, rows, cols) if epsilon is None else epsilon
    r2, c2 = _rest(a, rows, cols)
    low, right = _representatives(a, rows, cols)
    column, row = [a[i][right] for i in rows], [a[low][j] for j in cols]
    i0, j0 = next(k for k, v in enumerate(column) if v), next(k for k, v in enumerate(row) if v)
    b = [a[rows[i0]][j] * column[i0] for j in c2]
    d = [a[i][cols[j0]] * row[j0] for i in r2]
    first = [[*(a[i][j] for j in cols), x, x] for i, x in zip(rows, column)] + [[*row, 0, epsilon]]
    second = [[epsilon, 0, *b]] + [[x, x, *(a[i][j] for j in c2)] for i, x in zip(r2, d)]
    return first, second


def y_parts(a: Dense, rows: list[int], cols: list[int], epsilon: int | None = None) -> tuple[Dense, Dense]:
    """The parts of the transpose's delta-sum, transposed."""
    first, second = delta_parts(transposed(a), cols, rows, epsilon)
    return transposed(first), transposed(second)


def three_connecting(a: Dense, rows: list[int], cols: list[int]) -> tuple[tuple[int, int], tuple[int, int], int, int]:
    """Rows i, j and columns k, l of C with a regular 2 x 2 block, and the signs beta and
    gamma for which the connecting matrix is totally unimodular."""
    r2, c2 = _rest(a, rows, cols)
    if any(a[i][j] for i in rows for j in c2):
        raise ValueError("INPUT: the top right block isn't zero")
    for i, j in combinations(r2, 2):
        across = path_sum(a, [*rows, i, j], cols, [-1 - i], [-1 - j])
        for k, l in combinations(cols, 2):
            if abs(a[i][k] * a[j][l] - a[i][l] * a[j][k]) != 1:
                continue
            along = path_sum(a, r2, [*c2, k, l], [1 + k], [1 + l])
            if across is None or along is None:
                continue
            beta, gamma = (1 if (x[0] + 2) % 4 == 0 else -1 for x in (across, along))
            if by_partition([[gamma, 1, 0], [a[i][k], a[i][l], 1], [a[j][k], a[j][l], beta]]):
                return (i, j), (k, l), beta, gamma
    raise ValueError("STRUCTURE: there is no connecting matrix")


def three_parts(a: Dense, rows: list[int], cols: list[int]) -> tuple[Dense, Dense, tuple, tuple, tuple, tuple]:
    """[A 0; C_ij 1 beta] and [gamma 1 0; C_kl D] and their special lines, in the order in
    which :func:`.sums.three_sum` takes them."""
    r2, c2 = _rest(a, rows, cols)
    (i, j), (k, l), beta, gamma = three_connecting(a, rows, cols)
    first = [[*(a[x][y] for y in cols), 0] for x in rows] + [[*(a[x][y] for y in cols), s] for x, s in ((i, 1), (j, beta))]
    second = [[gamma, 1, *[0] * len(c2)]] + [[a[x][k], a[x][l], *(a[x][y] for y in c2)] for x in r2]
    m = len(rows)
    return first, second, (m, m + 1), (cols.index(k), cols.index(l), len(cols)), (0, 1 + r2.index(i), 1 + r2.index(j)), (0, 1)
