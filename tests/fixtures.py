"""Matrices with known answers, as rows of numbers.  Fixed values."""

from matrixloom.model import parse_dense as D

PIVOT_2 = D("""10 10
1 1 0 0 0 1 0 1 0 0  1 0 0 0 0 1 1 0 1 0  0 0 0 0 1 1 0 0 0 0  0 0 0 1 1 0 0 0 0 0  0 0 1 1 0 0 0 0 0 0
0 1 1 0 0 0 0 0 0 0  0 0 0 0 0 0 0 0 1 0  0 0 0 0 0 1 0 0 0 1  1 0 0 0 0 0 1 0 1 1  1 1 0 0 0 1 0 0 0 0""")
PIVOTED_2 = D("""10 10
1 1 0 0 0 1 0 1 0 0  1 1 0 0 0 0 1 1 1 0  0 0 0 0 1 1 0 0 0 0  0 0 0 1 1 0 0 0 0 0  0 0 1 1 0 0 0 0 0 0
0 1 1 0 0 0 0 0 0 0  0 0 0 0 0 0 0 0 1 0  0 0 0 0 0 1 0 0 0 1  1 1 0 0 0 1 1 1 1 1  1 0 0 0 0 0 0 1 0 0""")
PIVOT_3 = D("""10 10
1 1 0 0 0 -1 0 1 0 0  -1 0 0 0 0 1 1 0 1 0  0 0 0 0 1 1 0 0 0 0  0 0 0 1 1 0 0 0 0 0  0 0 1 1 0 0 0 0 0 0
0 1 1 0 0 0 0 0 0 0  0 0 0 0 0 0 0 0 1 0  0 0 0 0 0 1 0 0 0 1  1 0 0 0 0 0 1 0 1 1  1 1 0 0 0 1 0 0 0 0""")
PIVOTED_3 = D("""10 10
-1 1 0 0 0 -1 0 1 0 0  -1 1 0 0 0 0 1 1 1 0  0 0 0 0 1 1 0 0 0 0  0 0 0 1 1 0 0 0 0 0  0 0 1 1 0 0 0 0 0 0
0 1 1 0 0 0 0 0 0 0  0 0 0 0 0 0 0 0 1 0  0 0 0 0 0 1 0 0 0 1  1 -1 0 0 0 1 1 -1 1 1  1 0 0 0 0 -1 0 -1 0 0""")
CAMION = D("""10 10
1 -1 0 0 0 0 0 0 0 0  -1 1 0 0 0 0 0 0 0 0  0 0 1 0 0 0 0 -1 0 0  0 0 0 0 -1 0 1 0 0 0  0 0 0 0 0 0 -1 -1 -1 0
0 0 0 -1 0 1 0 0 0 0  0 0 0 0 1 -1 0 0 0 0  0 0 -1 1 0 0 0 0 0 0  0 0 0 0 0 0 0 0 1 -1  0 0 0 0 0 0 0 -1 0 1""")
CAMION_SIGNED = D("""10 10
1 -1 0 0 0 0 0 0 0 0  -1 1 0 0 0 0 0 0 0 0  0 0 1 0 0 0 0 -1 0 0  0 0 0 0 -1 0 1 0 0 0  0 0 0 0 0 0 -1 -1 -1 0
0 0 0 -1 0 1 0 0 0 0  0 0 0 0 1 -1 0 0 0 0  0 0 -1 -1 0 0 0 0 0 0  0 0 0 0 0 0 0 0 -1 -1  0 0 0 0 0 0 0 -1 0 1""")
CAMION_VIOLATOR = D("3 3  -1 -1 0  0 1 -1  -1 0 1")
CAMION_4 = D("4 4  1 1 0 0  1 0 1 1  0 1 1 0  0 0 1 1")
CAMION_4_SIGNED = D("4 4  1 1 0 0  1 0 -1 1  0 1 1 0  0 0 1 -1")
TWO_FIRST = D("5 5  1 1 0 0 0  1 0 1 -1 1  0 -1 1 0 -1  0 0 -1 1 0  0 1 1 0 1")
TWO_SECOND = D("5 5  1 -1 1 0 0  1 1 1 1 -1  0 0 -1 0 1  1 0 0 -1 0  0 1 0 0 1")
TWO_BY_ROW = D("""9 9
1 1 0 0 0 0 0 0 0  0 -1 1 0 -1 0 0 0 0  0 0 -1 1 0 0 0 0 0  0 1 1 0 1 0 0 0 0  1 0 1 -1 1 1 -1 0 0
1 0 1 -1 1 1 1 1 -1  -1 0 -1 1 -1 0 0 0 1  0 0 0 0 0 1 0 -1 0  0 0 0 0 0 0 1 0 1""")
TWO_BY_COLUMN = D("""9 9
1 1 0 0 0 0 0 0 0  1 0 1 -1 1 -1 1 0 0  0 -1 1 0 -1 1 -1 0 0  0 0 -1 1 0 0 0 0 0  0 1 1 0 1 -1 1 0 0
0 0 0 0 1 1 1 1 -1  0 0 0 0 0 0 -1 0 1  0 0 0 0 1 0 0 -1 0  0 0 0 0 0 1 0 0 1""")
# the two-sum by column has lost the first's last column, which is special
DELTA = [
    (D("3 4  1 1 0 0  1 0 1 1  0 1 0 -1"), D("3 4  -1 0 1 0  1 1 0 1  0 0 1 1")),
    (D("3 4  1 1 0 0  1 0 1 1  0 1 0 1"), D("3 4  1 0 1 0  1 1 0 1  0 0 1 1")),
]
DELTA_SUM = D("4 4  1 1 0 0  1 0 1 0  0 1 0 1  0 0 1 1")
THREE = [
    (
        D("4 5  1 0 1 1 0  0 1 1 1 0  1 0 1 0 1  0 -1 0 -1 1"),
        D("5 4  1 1 0 0  1 0 1 1  0 -1 1 1  1 0 1 0  0 -1 0 1"),
        D("6 6  1 0 1 1 0 0  0 1 1 1 0 0  1 0 1 0 1 1  0 -1 0 -1 1 1  1 0 1 0 1 0  0 -1 0 -1 0 1"),
    ),
    (
        D("4 5  1 0 -1 1 0  0 1 -1 1 0  1 0 1 0 1  0 -1 1 -1 1"),
        D("5 4  -1 1 0 0  1 0 1 1  1 -1 1 1  1 0 1 0  0 -1 0 1"),
        D("6 6  1 0 -1 1 0 0  0 1 -1 1 0 0  1 0 1 0 1 1  0 -1 1 -1 1 1  1 0 1 0 1 0  -1 -1 0 -1 0 1"),
    ),
]
THREE_BAD = (D("4 5  1 0 1 1 0  0 1 1 1 0  1 0 1 0 1  0 -1 1 -1 1"), THREE[0][1])
BLOCKS = D("""10 10
0 1 0 2 0 0 0 0 0 0  0 0 0 0 0 0 0 1 0 0  0 0 2 0 0 0 0 3 0 0  0 0 0 0 0 0 0 0 0 0  1 0 0 0 0 0 0 0 0 0
0 3 0 4 0 0 0 0 0 0  0 0 0 5 0 0 0 0 6 0  0 0 0 0 1 0 0 0 0 0  0 0 0 0 2 3 4 0 0 0  0 0 0 0 0 0 5 0 0 0""")
BALANCED = [
    (D("4 4  1 0 0 1  1 1 0 0  0 1 1 0  0 0 1 1"), True),
    (D("4 4  1 0 0 1  1 1 0 0  0 1 1 0  0 0 1 -1"), False),
    (D("5 5  1 0 0 0 1  1 1 0 0 0  0 1 1 0 0  0 0 1 1 0  0 0 0 1 1"), False),
    (D("5 5  1 0 0 0 0  1 1 1 0 0  0 0 0 1 1  0 0 0 0 0  1 1 0 0 0"), True),
]
EQUIMODULAR = [
    (D("5 9  -2 -1 1 5 -3 -2 -7 5 6  1 0 1 7 1 2 -6 8 8  -3 -1 1 4 -4 -3 -7 4 5  6 2 0 4 8 8 2 6 4  4 2 -2 -9 6 4 13 -9 -11"), 1),
    (D("5 9  -2 -1 1 5 -3 -2 -7 5 6  1 0 1 7 1 2 -6 8 8  -3 -1 1 4 -4 -3 -7 4 5  6 2 0 4 8 8 2 6 4  4 2 -2 -9 6 4 13 -9 -12"), 0),
    (D("4 4  1 1 1 1  1 1 0 0  1 0 1 0  1 0 0 1"), 2),
]
CTU_YES = D("4 5  1 0 0 1 1  1 1 0 0 1  0 1 1 0 1  0 0 1 1 1")
CTU_NO = D("5 5  0 1 0 1 0  1 1 1 0 1  0 1 0 0 1  1 0 0 0 1  0 1 1 1 1")
NETWORK = D("6 7  -1 0 0 0 1 -1 0  1 0 0 1 -1 1 0  0 -1 0 -1 1 -1 0  0 1 0 0 0 0 1  0 0 1 -1 1 0 1  0 0 -1 1 -1 0 0")
NOT_NETWORK = D("6 7  -1 0 0 0 1 -1 0  1 0 0 1 -1 1 0  0 -1 0 -1 1 -1 0  0 1 0 0 0 0 -1  0 0 1 -1 1 0 1  0 0 -1 1 -1 0 0")
NOT_GRAPHIC = D("5 10  1 0 1 1 1 0 1 0 0 0  0 0 1 0 0 1 1 0 0 0  0 1 0 1 0 0 1 1 0 0  0 0 0 0 1 0 1 1 0 0  0 0 1 0 0 0 1 0 1 1")
FANO = D("3 4  1 1 0 1  0 1 1 1  1 0 1 1")
K33 = D("5 4  1 1 0 0  1 1 1 0  1 0 0 -1  0 1 1 1  0 0 1 1")
SP_TERNARY = D("""10 10
0 -1 0 0 1 1 0 1 0 1  1 0 0 1 0 0 0 0 0 0  -1 0 0 -1 0 0 0 0 0 0  -1 1 0 -1 -1 0 1 -1 -1 -1  0 0 -1 0 0 0 0 0 0 0
0 0 0 0 0 0 0 -1 0 0  0 -1 0 0 0 0 0 0 0 1  0 1 0 0 0 0 0 0 0 -1  1 -1 0 1 1 0 -1 1 1 1  0 0 -1 0 0 0 0 0 0 0""")
SP_NOT = D("""10 10
1 1 1 1 1 0 1 0 1 1  0 1 0 0 0 0 0 0 0 0  1 1 1 1 1 0 1 1 0 1  1 1 -1 1 1 0 1 1 0 1  1 1 1 1 -1 0 -1 1 0 1
1 0 1 0 0 1 0 0 0 0  1 1 1 1 1 0 1 0 0 1  0 1 0 0 0 0 0 0 0 0  1 1 -1 1 1 0 1 1 0 1  1 1 1 1 1 0 1 1 0 1""")


def same_up_to_scaling(a, b):
    """Whether ``a`` becomes ``b`` (both ``{(r, c): v}``) when lines are multiplied by -1."""
    if {x: abs(v) for x, v in a.items()} != {x: abs(v) for x, v in b.items()}:
        return False
    near = {}
    for r, c in a:
        near.setdefault(("r", r), []).append(("c", c))
        near.setdefault(("c", c), []).append(("r", r))
    at = lambda x, y: (x[1], y[1]) if x[0] == "r" else (y[1], x[1])
    scale = {}
    for start in near:
        queue = [] if start in scale else [start]
        scale.setdefault(start, 1)
        while queue:
            x = queue.pop()
            for y in near[x]:
                if y not in scale:
                    scale[y] = scale[x] * (1 if a[at(x, y)] == b[at(x, y)] else -1)
                    queue.append(y)
    return all(v * scale["r", r] * scale["c", c] == b[r, c] for (r, c), v in a.items())
