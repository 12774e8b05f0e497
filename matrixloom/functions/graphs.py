"""Graphs of graphic and network matrices: representation and realisation."""

from __future__ import annotations

from collections import defaultdict, deque

from .exact import Dense, transposed
from .structure import camion
from .tu import ternary_witness

Edge = tuple[int, int]


def forest_paths(tree: dict[int, Edge]) -> dict[int, list[tuple[int, int]]]:
    """For each node the forest edges on its way from its root, as (edge, sign): +1
    along the edge's direction."""
    near = defaultdict(list)
    for e, (u, w) in tree.items():
        near[u].append((w, e, 1))
        near[w].append((u, e, -1))
    paths: dict[int, list[tuple[int, int]]] = {}
    for root in near:
        if root in paths:
            continue
        paths[root] = []
        queue = deque([root])
        while queue:
            x = queue.popleft()
            for y, e, sign in near[x]:
                if y not in paths:
                    paths[y] = [*paths[x], (e, sign)]
                    queue.append(y)
    return paths


def represented(tree: dict[int, Edge], others: dict[int, Edge], signed: bool = False) -> Dense | None:
    """Rows: forest edges, columns: other edges, in the order of their numbers; a column
    has the forest path between its edge's ends, with signs against (-1) or along (+1)
    the way from its tail to its head.  None if ``tree`` has a cycle or doesn't join a
    column's ends."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for u, w in tree.values():
        if find(u) == find(w):
            return None
        top[find(u)] = find(w)
    paths, rows = forest_paths(tree), {e: i for i, e in enumerate(sorted(tree))}
    columns = []
    for _, (u, w) in sorted(others.items()):
        column = [0] * len(rows)
        if u != w:
            if find(u) != find(w) or u not in paths or w not in paths:
                return None
            for e, sign in paths[w]:
                column[rows[e]] += sign
            for e, sign in paths[u]:
                column[rows[e]] -= sign
        columns.append([v if signed else abs(v) for v in column])
    return [list(r) for r in zip(*columns)] if columns else [[] for _ in rows]


def realise(a: Dense) -> tuple[dict[int, Edge], dict[int, Edge]] | None:
    """A graph whose matrix for the forest of the first edges is the 0/1 matrix ``a``:
    the ends of each row's and of each column's edge, or None if there is none."""
    if any(v not in (0, 1) for r in a for v in r):
        return None
    m, n = len(a), len(a[0]) if a else 0
    columns = [frozenset(i for i in range(m) if a[i][j]) for j in range(n)]
    tree = _tree(frozenset(range(m)), columns)
    if tree is None:
        return None
    others = {}
    for j, path in enumerate(columns):
        ends = _ends(tree, path)
        if ends is None:
            return None
        others[j] = ends
    return tree, others


def _ends(tree: dict[int, Edge], path: frozenset) -> Edge | None:
    """The ends of the path that these edges make, if they do."""
    if not path:
        return (0, 0)
    degree: dict[int, int] = defaultdict(int)
    near = defaultdict(list)
    for e in path:
        u, w = tree[e]
        degree[u] += 1
        degree[w] += 1
        near[u].append(w)
        near[w].append(u)
    ends = [x for x, d in degree.items() if d == 1]
    if len(ends) != 2 or any(d > 2 for d in degree.values()):
        return None
    seen, stack = {ends[0]}, [ends[0]]
    while stack:
        for y in near[stack.pop()]:
            if y not in seen:
                seen.add(y)
                stack.append(y)
    return (ends[0], ends[1]) if len(seen) == len(degree) else None


def _tree(rows: frozenset, columns: list[frozenset]) -> dict[int, Edge] | None:
    """Ends of tree edges such that each column's rows are a path (Tutte's method).

    If no column has three rows, a star does it.  Otherwise some row of such a column
    divides the others: without it, and joining the rows of columns that don't have it,
    they fall into components.  Each lies on one side of the row's edge; those that
    can't share a side must go to different ones.  Each is realised together with the
    row alone, and the parts of a side are hung on one another.
    """
    columns = list({c & rows for c in columns if len(c & rows) > 1})
    wide = next((c for c in columns if len(c) > 2), None)
    if wide is None:
        return {e: (0, i + 1) for i, e in enumerate(sorted(rows))}
    for i in sorted(wide)[:3]:
        parts = _components(rows - {i}, [c for c in columns if i not in c])
        part_of = {x: k for k, p in enumerate(parts) for x in p}
        two = [x for x in sorted(wide)[:3] if x != i]
        if part_of[two[0]] != part_of[two[1]]:
            break
    else:
        return None
    through = [(k, c) for k, c in enumerate(columns) if i in c]
    of_row = {x: frozenset(k for k, c in through if x in c) for x in rows}
    of_part = [frozenset().union(*(of_row[x] for x in p)) for p in parts]

    def nests(k: int, other: int) -> bool:
        """Part ``other`` can hang on part ``k``: each of its rows has all or none of it."""
        return all(not (of_row[x] & of_part[other]) or of_part[other] <= of_row[x] for x in parts[k])

    side = {}
    apart = {k: [x for x in range(len(parts)) if x != k and not nests(k, x) and not nests(x, k)] for k in range(len(parts))}
    for k in range(len(parts)):
        if k in side:
            continue
        side[k], stack = 0, [k]
        while stack:
            x = stack.pop()
            for y in apart[x]:
                if y not in side:
                    side[y] = 1 - side[x]
                    stack.append(y)
                elif side[y] == side[x]:
                    return None
    whole: dict[int, Edge] = {i: (0, 1)}
    fresh = 2
    for s in (0, 1):
        # larger first, so that what hangs on a part comes after it
        mine = sorted((k for k in range(len(parts)) if side[k] == s), key=lambda k: -len(of_part[k]))
        mine = _hanging_order(mine, of_row, of_part, parts, nests)
        placed: list[int] = []
        for k in mine:
            inner = _tree(parts[k] | {i}, [c & (parts[k] | {i}) for c in columns])
            if inner is None:
                return None
            u, w = inner[i]
            used = {x for e, ends in inner.items() if e != i for x in ends}
            root = u if u in used else w
            at = s
            path = frozenset(x for p in placed for x in parts[p] if of_part[k] and of_part[k] <= of_row[x])
            if path:
                ends = _ends(whole, path | {i})
                if ends is None:
                    return None
                at = ends[0] if ends[1] == 1 - s else ends[1]
            names = {root: at}
            for e, (x, y) in inner.items():
                if e != i:
                    for z in (x, y):
                        if z not in names:
                            names[z] = fresh
                            fresh += 1
                    whole[e] = (names[x], names[y])
            placed.append(k)
    return whole


def _hanging_order(mine, of_row, of_part, parts, nests) -> list[int]:
    """Parts before those that hang on them."""
    hangs = {k: {p for p in mine if p != k and of_part[k] and nests(p, k) and any(of_part[k] <= of_row[x] for x in parts[p])} for k in mine}
    out: list[int] = []
    left = list(mine)
    while left:
        k = next((k for k in left if not (hangs[k] - set(out) - {x for x in hangs[k] if k in hangs[x]})), left[0])
        out.append(k)
        left.remove(k)
    return out


def _components(rows: frozenset, columns: list[frozenset]) -> list[frozenset]:
    top = {x: x for x in rows}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for c in columns:
        first = None
        for x in c:
            if x in top:
                if first is None:
                    first = x
                else:
                    top[find(x)] = find(first)
    groups = defaultdict(set)
    for x in rows:
        groups[find(x)].add(x)
    return [frozenset(g) for _, g in sorted(groups.items(), key=lambda kv: min(kv[1]))]


def is_graphic(a: Dense) -> bool:
    return realise(a) is not None


def is_cographic(a: Dense) -> bool:
    return realise(transposed(a) if a and a[0] else a) is not None


def network(a: Dense) -> tuple[dict[int, Edge], dict[int, Edge]] | None:
    """A directed graph whose network matrix is ``a``, or None: a graph of the support,
    its edges directed along the signs."""
    if ternary_witness(a) or camion(a)[1] is not None:
        return None
    found = realise([[abs(v) for v in r] for r in a])
    if found is None:
        return None
    tree, others = found
    m = len(a)
    # the sign of each row's edge relative to a column's way from tail to head
    need: dict[int, int] = {}
    ways = {}
    for j, (u, w) in others.items():
        plain = represented(tree, {0: (u, w)}, signed=True)
        ways[j] = [plain[i][0] for i in range(m)] if plain else [0] * m
    near = defaultdict(list)
    for j, way in ways.items():
        rows = [i for i in range(m) if a[i][j]]
        for i in rows[1:]:
            same = (a[rows[0]][j] * way[rows[0]]) * (a[i][j] * way[i])
            near[rows[0]].append((i, same))
            near[i].append((rows[0], same))
    for start in range(m):
        if start in need:
            continue
        need[start], stack = 1, [start]
        while stack:
            x = stack.pop()
            for y, same in near[x]:
                if y not in need:
                    need[y] = need[x] * same
                    stack.append(y)
                elif need[y] != need[x] * same:
                    return None
    turned = {i: (e if need[i] == 1 else e[::-1]) for i, e in tree.items()}
    arcs = {}
    for j, (u, w) in others.items():
        i = next((i for i in range(m) if a[i][j]), None)
        arcs[j] = (u, w) if i is None or a[i][j] == ways[j][i] * need[i] else (w, u)
    return turned, arcs


def is_network(a: Dense) -> bool:
    return network(a) is not None


def is_conetwork(a: Dense) -> bool:
    return network(transposed(a) if a and a[0] else a) is not None


def greedy_graphic_columns(a: Dense, order: list[int] | None = None) -> list[int]:
    """Columns, taken in order, of which each keeps the submatrix graphic."""
    kept: list[int] = []
    for j in range(len(a[0]) if a else 0) if order is None else order:
        if is_graphic([[r[x] for x in [*kept, j]] for r in a]):
            kept.append(j)
    return kept
