"""Searches on the entries of one matrix that one task holds: what the operators on entries do in
rounds of joins for larger ones, with the same results.

``near`` maps each line that has nonzeros to the lines that it meets, with the entries there."""

from __future__ import annotations

from collections.abc import Iterator

Near = dict[int, dict[int, int]]
LIMIT = 10**38


def near_of(cells: list[tuple[int, int, int]]) -> Near:
    near: Near = {}
    for r, c, v in cells:
        near.setdefault(-1 - r, {})[1 + c] = v
        near.setdefault(1 + c, {})[-1 - r] = v
    return near


def place(element: int) -> tuple[bool, int]:
    return element > 0, abs(element)


def sides(elements) -> tuple[list[int], list[int]]:
    return sorted({-1 - x for x in elements if x < 0}), sorted({x - 1 for x in elements if x > 0})


# --- series-parallel reductions -----------------------------------------------------


def reduced(near: Near, ternary: bool) -> list[tuple[int, int, int]]:
    """``(step, element, mate)`` of the lines that go, round by round; ``near`` keeps the rest.

    A line that hasn't changed since the last round is neither single nor a copy of another such
    line, so a round looks at those that have; the others are known by their entries."""
    out: list[tuple[int, int, int]] = []
    due, keys, known, step = set(near), {}, {}, 0
    while due:
        gone, groups = [], {}
        for a in due:
            line = near[a]
            if len(line) == 1:
                (b,) = line
                if a < 0 or len(near[b]) > 1:  # of a row and a column with only their common entry the row goes
                    gone.append((a, b))
                continue
            items = sorted(line.items())
            if ternary and items[0][1] < 0:
                items = [(b, -v) for b, v in items]
            keys[a] = key = tuple(items)  # rows' and columns' differ
            groups.setdefault(key, []).append(a)
        for key, same in groups.items():
            if key in known:
                same.append(known[key])
            known[key] = first = min(same, key=place) if len(same) > 1 else same[0]
            gone += [(a, first) for a in same if a != first]
        due = set()
        for a, mate in sorted(gone, key=lambda x: place(x[0])):
            out.append((step, a, mate))
            keys.pop(a, None)
            for b in near.pop(a, ()):
                if b in near:
                    key = keys.pop(b, None)
                    if known.get(key) == b:
                        del known[key]
                    del near[b][a]
                    due.add(b)
                    if not near[b]:
                        del near[b]
        due &= near.keys()
        step += 1
    return out


def wrong(near: Near, steps: list[tuple[int, int, int]], ternary: bool) -> int:
    """How many ``steps``, gone through one after the other, don't hold by then; ``near`` keeps the rest."""
    out = 0
    for _, a, mate in steps:
        line = near.pop(a, {})
        if not mate:
            holds = not line
        elif (mate < 0) != (a < 0):
            holds = line.keys() == {mate}
        else:
            other = near.get(mate, {})
            holds = line == other or ternary and line == {b: -v for b, v in other.items()}
        out += not holds
        for b in line:
            del near[b][a]
    return out


# --- holes --------------------------------------------------------------------------


class TooMany(Exception):
    """More chordless paths than may be held."""


def odd_hole(near: Near, most: float = float("inf")) -> list[int] | None:
    """The least of the shortest holes whose entries don't sum up to a multiple of four;
    ``most``: paths held at a time, beyond which the search is given up."""
    paths = [([a], 0) for a in near if a < 0]
    while paths:
        grown, bad = [], []
        for path, total in paths:
            first, earlier = path[0], path[len(path) % 2 ^ 1 : -1 : 2]
            for b, v in near[path[-1]].items():
                if b in path or b < 0 and b > first:
                    continue
                touched = [a for a in earlier if a in near[b]]
                if not touched:
                    grown.append((path + [b], total + v))
                    if len(grown) > most:
                        raise TooMany
                elif touched == [first] and b > path[1] and (total + v + near[b][first]) % 4:
                    bad.append(path + [b])
        if bad:
            return min(bad)
        paths = grown
    return None


# --- Camion's signs -----------------------------------------------------------------


def cycles(near: Near) -> Iterator[tuple[int, list[tuple], dict[int, int | None]]]:
    """Of each row that has cycles through the rows above: the row, what is taken of them
    ``(p, q, a, b, total)`` in the tree's order, and each line's parent.  Rows are searched one
    after the other, with the entries that ``near`` has by then."""
    for row in sorted((a for a in near if a < 0), reverse=True):
        due = [c for c in near[row] if max(near[c]) > row]
        if len(due) < 2:
            continue
        level: dict[int, tuple] = {c: (None, c, 0) for c in due}
        before: dict[int, tuple] = {}
        parents: dict[int, int | None] = dict.fromkeys(due)
        met: dict[tuple[int, int], tuple] = {}
        depth = 0
        while level:
            depth += 1
            reached: dict[int, dict[int, tuple]] = {}
            for a, (_, cell, total) in level.items():
                for b, v in near[a].items():
                    if b > row and b not in before:
                        ways = reached.setdefault(b, {})
                        way = (abs(a), a, total + v)
                        if cell not in ways or way < ways[cell]:
                            ways[cell] = way
            before, level = level, {}
            for b, ways in reached.items():
                p = min(ways)
                _, a, total = ways.pop(p)
                level[b], parents[b] = (a, p, total), a
                for q, (_, a, t) in ways.items():
                    way = (2 * depth, place(b), place(a), a, b, t + total)
                    if (p, q) not in met or way < met[p, q]:
                        met[p, q] = way
        if met:
            yield row, _tree(met), parents


def _tree(met: dict[tuple[int, int], tuple]) -> list[tuple]:
    """Of the cells that meet a tree for each connected part, from its least cell."""
    ways: dict[int, dict[int, tuple]] = {}
    for (p, q), (length, pb, pa, a, b, total) in met.items():
        ways.setdefault(p, {})[q] = ways.setdefault(q, {})[p] = (length, pb, pa, a, b, total)
    out: list[tuple] = []
    seen: set[int] = set()
    for root in sorted(ways):
        if root in seen:
            continue
        seen.add(root)
        level = [root]
        while level:
            best: dict[int, tuple] = {}
            for p in level:
                for q, (length, *rest) in ways[p].items():
                    if q not in seen:
                        best[q] = min(best.get(q, (length, p, *rest)), (length, p, *rest))
            out += [(p, q, a, b, total) for q, (_, p, _, _, a, b, total) in best.items()]
            seen |= best.keys()
            level = list(best)
    return out


def camion_violator(near: Near) -> set[int] | None:
    """The lines of a chordless cycle whose sum isn't a multiple of four, of the first row
    that has one."""
    for row, tree, parents in cycles(near):
        bad = [(q, p, a, b) for p, q, a, b, total in tree if (total + near[row][p] + near[row][q]) % 4]
        if bad:
            lines = {row}
            for x in min(bad)[2:]:
                while x is not None:
                    lines.add(x)
                    x = parents[x]
            return lines
    return None


def camion_signed(near: Near) -> None:
    """Gives the entries of -1 and 1 Camion's signs, row after row."""
    for row, tree, _ in cycles(near):
        for p, q, _, _, total in tree:
            if (total + near[row][p] + near[row][q]) % 4:
                near[row][q] = near[q][row] = -near[row][q]


# --- elimination --------------------------------------------------------------------


class Overflow(Exception):
    """A number of more than 38 digits."""


def _fits(x: int) -> int:
    if abs(x) >= LIMIT:
        raise Overflow
    return x


def _quotient(v: int, p: int) -> int:
    """As decimals divide: half up at six places, which must fit, then half up."""
    x = _fits((2 * abs(v) * 10**6 + abs(p)) // (2 * abs(p)))
    return (x + 500_000) // 10**6 * (1 if (v > 0) == (p > 0) else -1)


def _taken_from(rows: dict[int, dict], r: int, f: int, pivot: dict) -> None:
    row = rows[r]
    for c, w in pivot.items():
        row[c] = _fits(row.get(c, 0) - _fits(f * w))
    rows[r] = {c: v for c, v in row.items() if v}


def column_echelon(cells: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(c, r, v)``: the rows' first entries when no two of them stand in one column."""
    rows: dict[int, dict] = {}
    for r, c, v in cells:
        rows.setdefault(r, {})[c] = v
    while True:
        first: dict[int, list] = {}
        for r, row in rows.items():
            if row:
                c = min(row)
                first.setdefault(c, []).append((abs(row[c]), r, row[c]))
        if all(len(x) == 1 for x in first.values()):
            return sorted((c, r, v) for c, ((_, r, v),) in first.items())
        for c, x in first.items():
            _, pr, p = min(x)
            for _, r, v in x:
                if r != pr:
                    _taken_from(rows, r, _quotient(v, p), rows[pr])


def product(pivots: list[tuple[int, int, int]]) -> tuple[int | None, int]:
    """The product of the pivots ``(c, r, v)`` (None if it is too long) and the sign of the order that
    they put rows and columns in."""
    out: int | None = 1
    for _, _, v in pivots:
        out = None if out is None or abs(out * v) >= LIMIT else out * v
    turned = sum(b[1] < a[1] for i, a in enumerate(pivots) for b in pivots[i + 1 :])
    return out, -1 if turned % 2 else 1


def echelon(own: dict[int, dict], units: dict[int, dict], lots: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """``(k, r, c, v)``: the pivots of each round; ``own``'s rows become the echelon form and those of
    ``units`` the transformation.  ``lots`` settle which of equal entries come first."""
    live, out, k = dict.fromkeys(r for r, row in own.items() if row), [], 0
    while live:
        named = {r: min((abs(v), lots[r], c, v) for c, v in own[r].items()) for r in live}
        rank = {r: (x[0], x[1], r) for r, x in named.items()}
        late = set()
        for pr, x in named.items():
            late |= {max(pr, r, key=rank.get) for r in live if r != pr and x[2] in own[r]}
        taken = {r: (x[2], x[3]) for r, x in named.items() if r not in late}
        changes = [(r, pr, _quotient(own[r][c], p), own[r][c] - _quotient(own[r][c], p) * p) for pr, (c, p) in taken.items() for r in live if r != pr and c in own[r]]
        left = {pr for _, pr, _, rest in changes if rest}
        for r, pr, f, _ in changes:
            for part in (own, units):
                if part:
                    _taken_from(part, r, f, part[pr])
        for pr, (c, p) in taken.items():
            if pr not in left:
                out.append((k, pr, c, p))
                live.pop(pr)
        live = dict.fromkeys(r for r in live if own[r])
        k += 1
    return out
