"""Error-correcting Earley parsing of rows of roles.

The grammar says which roles may follow each other, and its error productions delete a row, change its role or insert a row.
An item of the chart is a production, a dot and an origin, and retains the least (cost, audit) of all ways to it; the audit has one letter for
each edit. Nonterminals stand at the left of their productions only, so a column of the chart has a bounded number of items, all with origin 0.

A long sequence is parsed in blocks, each from every nonterminal that may come before it; ``Path`` composes the blocks.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Sequence
from functools import lru_cache
from heapq import heappop, heappush

#: What has been put out so far: nothing, a system row, a user row last, an assistant row last.
EMPTY, SYSTEM, OPEN, DONE = range(4)
NONTERMINALS = range(4)
FINAL = (EMPTY, DONE)
#: Terminals: the initial of the role that is wanted, and any row that is deleted.
DELETED = "-"
GRAMMAR: dict[int, list[tuple]] = {x: [(x, DELETED)] for x in NONTERMINALS}
GRAMMAR[SYSTEM] += [(EMPTY, "s")]
GRAMMAR[OPEN] += [(EMPTY, "u"), (SYSTEM, "u"), (DONE, "u")]
GRAMMAR[DONE] += [(OPEN, "a")]
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Symbols of rows: the initial of the role, ``o`` for others; capitals for truncated rows; ``x`` for rows that must go.
MUST_GO = "x"

Weight = tuple[int, str]


def scanned(symbol: str, wanted: str) -> Weight | None:
    """What it costs that a row stands for a terminal."""
    if wanted == DELETED:
        return DELETE, "D"
    if symbol == MUST_GO:
        return None
    extra = TRUNCATED if symbol.isupper() else 0
    if symbol.lower() == wanted:
        return extra, "K"
    return (REROLE + extra, "R") if wanted in ROLES else None


def parse(symbols: str, entry: int = EMPTY) -> dict[int, Weight]:
    """The least (cost, audit) of every nonterminal that derives all symbols, where ``entry`` derives what came before them."""
    waiting: dict[int, list[tuple]] = {}  # the items of column 0 before a nonterminal
    none = {x: None for x in NONTERMINALS}
    column: dict[tuple, Weight] = {}
    heap: list[tuple] = []

    def add(item: tuple, weight: Weight) -> None:
        if item not in column or weight < column[item]:
            column[item] = weight
            heappush(heap, (weight, item))

    def close(first: bool, symbol: str | None, best: dict[int, Weight | None], following: dict[tuple, Weight]) -> None:
        """Complete, predict and insert, cheapest items first; scan into the next column."""
        while heap:
            weight, item = heappop(heap)
            if column[item] < weight:
                continue
            left, right, dot = item
            if dot == len(right):  # completer
                if best[left] is None:
                    best[left] = weight
                    for parent in waiting.get(left, ()):
                        add((parent[0], parent[1], 1), weight)
            elif dot == 0 and first:  # predictor
                known = right[0] in waiting
                waiting.setdefault(right[0], []).append(item)
                if not known:
                    for production in GRAMMAR[right[0]]:
                        add((right[0], production, 0), (0, ""))
                if best[right[0]] is not None:
                    add((left, right, 1), best[right[0]])
            else:
                wanted = right[dot]
                if wanted in ROLES:  # inserted row
                    add((left, right, dot + 1), (weight[0] + INSERT, weight[1] + "I"))
                step = scanned(symbol, wanted) if symbol is not None else None
                if step is not None:  # scanner
                    to, total = (left, right, dot + 1), (weight[0] + step[0], weight[1] + step[1])
                    if to not in following or total < following[to]:
                        following[to] = total

    for goal in NONTERMINALS:
        for production in GRAMMAR[goal]:
            add((goal, production, 0), (0, ""))
    add((entry, (), 0), (0, ""))
    best: dict[int, Weight | None] = dict(none)
    for at in range(len(symbols) + 1):
        following: dict[tuple, Weight] = {}
        close(at == 0, symbols[at] if at < len(symbols) else None, best, following)
        if at < len(symbols):
            column.clear()
            best = dict(none)
            for item, weight in following.items():
                add(item, weight)
    return {x: w for x, w in best.items() if w is not None}


parsed = lru_cache(maxsize=1 << 14)(parse)


def _order(a: tuple[str, str] | int, x: str, y: str) -> tuple[str, str] | int:
    """How two audits compare when they go on with x and y: -1, 1, or what is left of each behind their common start."""
    if isinstance(a, int):
        return a
    x, y = a[0] + x, a[1] + y
    for k, (c, d) in enumerate(zip(x, y)):
        if c != d:
            return -1 if c < d else 1
    n = min(len(x), len(y))
    return x[n:], y[n:]


class Path:
    """The cheapest way through a sequence of blocks, least audit first among equals.

    Audits are never held whole: of each two nonterminals it is known whose audit is less, or what follows their common start. One of the two is
    then a start of the other and has as many rows, so what follows are insertions, of which a cheapest way has three in a row at most.
    """

    def __init__(self) -> None:
        self.cost: dict[int, int] = {EMPTY: 0}
        self.order: dict[tuple[int, int], tuple[str, str] | int] = {(EMPTY, EMPTY): ("", "")}
        self.back = array("b")

    def add(self, block: dict[int, dict[int, Weight]]) -> None:
        """``block``: for each nonterminal before it, what ``parse`` gives."""
        chosen: dict[int, tuple[int, int, str]] = {}
        for p, cost in self.cost.items():
            for q, (more, audit) in block.get(p, {}).items():
                way = (cost + more, p, audit)
                if q not in chosen or way[0] < chosen[q][0] or way[0] == chosen[q][0] and self._less(way, chosen[q]):
                    chosen[q] = way
        self.order = {(a, b): _order(self.order[chosen[a][1], chosen[b][1]], chosen[a][2], chosen[b][2]) for a in chosen for b in chosen}
        self.cost = {q: way[0] for q, way in chosen.items()}
        self.back.extend(chosen[q][1] if q in chosen else -1 for q in NONTERMINALS)

    def _less(self, way: tuple[int, int, str], other: tuple[int, int, str]) -> bool:
        order = _order(self.order[way[1], other[1]], way[2], other[2])
        return order == -1 or not isinstance(order, int) and order[0] < order[1]

    def end(self) -> tuple[int, list[tuple[int, int]]]:
        """The cost, and before and after which nonterminal each block stands."""
        ends = [q for q in FINAL if q in self.cost]
        last = ends[0]
        for q in ends[1:]:
            if self.cost[q] < self.cost[last] or self.cost[q] == self.cost[last] and self._less((0, q, ""), (0, last, "")):
                last = q
        cost, at, steps = self.cost[last], last, []
        for k in range(len(self.back) - 4, -1, -4):
            steps.append((self.back[k + at], at))
            at = self.back[k + at]
        return cost, steps[::-1]


def maps(symbols: str) -> dict[int, dict[int, Weight]]:
    return {p: parsed(symbols, p) for p in NONTERMINALS}


def repair(symbols: str, block: int = 256) -> Weight:
    """Cost and audit of the cheapest repair of a whole sequence."""
    blocks = [symbols[k : k + block] for k in range(0, len(symbols), block)]
    if len(blocks) < 2:
        found = parsed(symbols, EMPTY)
        return min(found[q] for q in FINAL if q in found)
    path = Path()
    for b in blocks:
        path.add(maps(b))
    cost, steps = path.end()
    return cost, "".join(maps(b)[p][q][1] for b, (p, q) in zip(blocks, steps))


def applied(audit: str, rows: Iterable[Sequence], entry: int = EMPTY) -> list[tuple[str, str]]:
    """Role and text of the rows that an audit leaves, changes or inserts."""
    source, state, out = iter(rows), entry, []
    for letter in audit:
        if letter == "D":
            next(source)
            continue
        wanted = "a" if state == OPEN else "u"
        if letter == "I":
            out.append((ROLES[wanted], ""))
        else:
            role, text = next(source)
            out.append((role if letter == "K" else ROLES[wanted], text))
            if letter == "K":
                wanted = role[0]
        state = {"s": SYSTEM, "u": OPEN, "a": DONE}[wanted]
    return out
