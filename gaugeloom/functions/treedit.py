"""Edit scripts between two nested schemas: least-cost add, remove, rename, move and retype steps.

A schema is a dict from dotted leaf path to type. Children of a node are an unordered set, so
the distance is the constrained tree edit distance for unordered trees: the children of two
matched nodes are paired by a least-cost assignment. Whether a leaf may stand for another is
decided by evidence handed in (do records present in both files hold the same values there?),
never by likeness of names; names only break ties.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

ADD = REMOVE = 1.0
RENAME = 1.0  # less than one removal and one addition
RETYPE = 1.0
NEVER = 1e6


def build_tree(fields: dict[str, str | None]) -> dict:
    """Nested dicts from dotted paths; a leaf is the pair (path, type)."""
    root: dict = {}
    for path in sorted(fields):
        *up, last = path.split(".")
        node = root
        for p in up:
            node = node.setdefault((p, "node"), {})
        node[(last, "leaf")] = (path, fields[path])
    return root


def leaves(tree: dict) -> list[tuple[str, str | None]]:
    out = []
    for (_, kind), v in tree.items():
        out += leaves(v) if kind == "node" else [v]
    return out


def assign(cost: list[list[float]]) -> list[int]:
    """Least-cost assignment of rows to columns of a square matrix (shortest augmenting paths); column of each row."""
    n = len(cost)
    u, v, match, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            match[j0] = match[j1]
            j0 = j1
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def _pair_off(left: list, right: list, cost: Callable) -> tuple[list, list, list]:
    """Least-cost pairing where an entry may also stay alone: pairs, lone left, lone right."""
    n, m = len(left), len(right)
    if not n or not m:
        return [], list(left), list(right)
    size = n + m
    matrix = [[0.0] * size for _ in range(size)]
    for i in range(size):
        for j in range(size):
            if i < n and j < m:
                matrix[i][j] = cost(left[i], right[j])
            elif i < n:
                matrix[i][j] = cost(left[i], None) if j - m == i else NEVER
            elif j < m:
                matrix[i][j] = cost(None, right[j]) if i - n == j else NEVER
    col = assign(matrix)
    pairs = [(left[i], right[col[i]]) for i in range(n) if col[i] < m and matrix[i][col[i]] < NEVER]
    done = {id(a) for a, _ in pairs}, {id(b) for _, b in pairs}
    return pairs, [a for a in left if id(a) not in done[0]], [b for b in right if id(b) not in done[1]]


def edit_script(old: dict[str, str | None], new: dict[str, str | None], same: Callable[[str, str], bool]) -> list[tuple[str, str, str]]:
    """Steps (change, old path, new path) that turn one schema into the other at least cost.

    change: renamed (also a move to another parent), added, removed, retyped. same(p, q) says
    whether the values of p in the old file are those of q in the new one; it is asked for
    leaves of equal type only that are in one of the schemas each. A path in both schemas is
    matched with itself; it is retyped if both types are known and differ.
    """
    may = {}

    def leaf_cost(a, b) -> float:
        if a is None or b is None:
            return ADD
        (p, s), (q, t) = a, b
        if p == q:
            return RETYPE * (s is not None and t is not None and s != t)
        if p in new or q in old or s != t:
            return NEVER
        if (p, q) not in may:
            may[p, q] = same(p, q)
        return RENAME - 0.4 * SequenceMatcher(None, p, q).ratio() if may[p, q] else NEVER

    memo: dict = {}

    def distance(a, b) -> tuple[float, list]:
        """Cost and leaf pairs of two inner nodes."""
        k = id(a), id(b)
        if k not in memo:
            total, found = 0.0, []
            for kind in ("leaf", "node"):
                left = [(x, v) for x, v in a.items() if x[1] == kind]
                right = [(x, v) for x, v in b.items() if x[1] == kind]

                def cost(x, y, kind=kind):
                    if kind == "leaf":
                        return leaf_cost(x and x[1], y and y[1])
                    if x is None or y is None:
                        return float(len(leaves((x or y)[1])))
                    c, f = distance(x[1], y[1])
                    return c if f else len(leaves(x[1])) + len(leaves(y[1])) + 0.5

                pairs, _, _ = _pair_off(left, right, cost)
                alone = {id(x) for x in left} | {id(y) for y in right}
                for x, y in pairs:
                    alone -= {id(x), id(y)}
                    total += cost(x, y)
                    found += [(x[1], y[1])] if kind == "leaf" else distance(x[1], y[1])[1]
                total += sum(cost(x, None) for x in left if id(x) in alone) + sum(cost(None, y) for y in right if id(y) in alone)
            memo[k] = total, found
        return memo[k]

    a, b = build_tree(old), build_tree(new)
    pairs = distance(a, b)[1]
    lone_old = sorted(set(leaves(a)) - {x for x, _ in pairs}, key=str)
    lone_new = sorted(set(leaves(b)) - {y for _, y in pairs}, key=str)
    moved, lone_old, lone_new = _pair_off([[x] for x in lone_old], [[y] for y in lone_new], lambda x, y: leaf_cost(x and x[0], y and y[0]))
    steps = []
    for (p, s), (q, t) in [*pairs, *((x[0], y[0]) for x, y in moved)]:
        if p != q:
            steps.append(("renamed", p, q))
        elif s is not None and t is not None and s != t:
            steps.append(("retyped", p, q))
    return sorted(steps + [("removed", x[0][0], "") for x in lone_old] + [("added", "", y[0][0]) for y in lone_new])
