"""Cheapest structure repairs of fault strings, evaluated over a grammar.

A conversation is a string of symbols, one per row: `s`, `u`, `a` for a sound row whose role starts
with that letter, `x` for any other sound row, a capital for a truncated one, `d` for a row that
has to go. Re-Pair replaces the most frequent pair of symbols by a new one until no pair repeats.
Every symbol, given or new, has one min-plus matrix over the states of the wanted role pattern
`(s?(ua)+)?`; that of a new one is the product of its two parts. A cell holds the least cost and the
ASCII-least audit of that cost, as a rope.

Audits of one string with equal costs are never prefixes of each other: such a prefix would lack
insertions only, and each costs something. So the least of all is found from the least of the parts.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Sequence

STATES = 4
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(STATES)
STEP = {
    (START, "s"): AFTER_SYSTEM,
    (START, "u"): AFTER_USER,
    (AFTER_SYSTEM, "u"): AFTER_USER,
    (AFTER_ASSISTANT, "u"): AFTER_USER,
    (AFTER_USER, "a"): AFTER_ASSISTANT,
}
ENDS = (START, AFTER_ASSISTANT)
SYMBOLS = "suaxSUAXd"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1


class Rope:
    """A text that is put together only when it is looked at."""

    __slots__ = ("left", "right", "text")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right

    def flat(self) -> str:
        if self.text is None:
            pieces, work = [], [self]
            while work:
                rope = work.pop()
                if rope.text is None:
                    work += (rope.right, rope.left)
                else:
                    pieces.append(rope.text)
            self.text, self.left, self.right = "".join(pieces), None, None
        return self.text


Cell = tuple[int, Rope]
Matrix = list[Cell | None]  # STATES x STATES, by row; None: cannot be reached


def _better(one: Cell | None, two: Cell | None) -> Cell | None:
    if one is None or two is None:
        return one or two
    if one[0] != two[0]:
        return one if one[0] < two[0] else two
    return one if one[1].flat() <= two[1].flat() else two


def product(one: Matrix, two: Matrix) -> Matrix:
    found: Matrix = [None] * (STATES * STATES)
    for i in range(STATES):
        for k in range(STATES):
            first = one[i * STATES + k]
            if first is None:
                continue
            for j in range(STATES):
                second = two[k * STATES + j]
                if second is None:
                    continue
                place, cost = i * STATES + j, first[0] + second[0]
                known = found[place]
                if known is None or cost <= known[0]:
                    found[place] = _better(known, (cost, Rope(None, first[1], second[1])))
    return found


def _insertions() -> Matrix:
    """Any number of inserted rows, none included."""
    found: Matrix = [None] * (STATES * STATES)
    for i in range(STATES):
        state, audit = i, ""
        while found[i * STATES + state] is None:
            found[i * STATES + state] = (INSERT * len(audit), Rope(audit))
            state = next(j for (k, role), j in STEP.items() if k == state and role in "ua")
            audit += "I"
    return found


def _one_row(symbol: str) -> Matrix:
    """What may become of one row, without insertions."""
    found: Matrix = [None] * (STATES * STATES)

    def offer(i: int, j: int, cost: int, edit: str) -> None:
        found[i * STATES + j] = _better(found[i * STATES + j], (cost, Rope(edit)))

    extra = TRUNCATED if symbol.isupper() else 0
    for i in range(STATES):
        offer(i, i, DELETE, "D")
        if symbol == "d":
            continue
        for role, cost, edit in ((symbol.lower(), KEEP, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
            if (i, role) in STEP:
                offer(i, STEP[i, role], cost + extra, edit)
    return found


INSERTIONS = _insertions()
GIVEN = [product(INSERTIONS, _one_row(symbol)) for symbol in SYMBOLS]
UNIT: Matrix = [(0, Rope("")) if i // STATES == i % STATES else None for i in range(STATES * STATES)]


def re_pair(strings: Sequence[str]) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """The strings over given and new symbols, and the rules: rule k makes symbol len(SYMBOLS) + k.

    The most frequent pair of neighbours is replaced first, of equally frequent ones the smallest,
    until every pair occurs once.
    """
    code = {symbol: k for k, symbol in enumerate(SYMBOLS)}
    border, gone = -1, -2
    symbols: list[int] = [border]
    for string in strings:
        symbols += [code[c] for c in string]
        symbols.append(border)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i in range(n - 1):
        if symbols[i] != border and symbols[i + 1] != border:
            places[symbols[i], symbols[i + 1]].add(i)
    heap = [(-len(found), pair) for pair, found in places.items() if len(found) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        now = len(places[pair])
        if now < 2:
            continue
        if now != -count:
            heapq.heappush(heap, (-now, pair))
            continue
        new, touched = len(SYMBOLS) + len(rules), set()
        rules.append(pair)
        for i in sorted(places.pop(pair)):
            j = after[i]
            if symbols[i] != pair[0] or j >= n or symbols[j] != pair[1]:
                continue  # taken by the replacement before it
            left, right = before[i], after[j]
            if symbols[left] != border:
                places[symbols[left], pair[0]].discard(left)
                places[symbols[left], new].add(left)
                touched.add((symbols[left], new))
            if symbols[right] != border:
                places[pair[1], symbols[right]].discard(j)
                places[new, symbols[right]].add(i)
                touched.add((new, symbols[right]))
            symbols[i], symbols[j] = new, gone
            after[i], before[right] = right, i
        for other in touched:
            if len(places[other]) > 1:
                heapq.heappush(heap, (-len(places[other]), other))
    found, i = [], 1
    for _ in strings:
        sequence = []
        while symbols[i] != border:
            sequence.append(symbols[i])
            i = after[i]
        found.append(sequence)
        i = after[i]
    return found, rules


def matrices(strings: Sequence[str]) -> list[Matrix]:
    """The matrix of every string: one product per rule, shared by all strings that use it."""
    sequences, rules = re_pair(strings)
    known = list(GIVEN)
    for left, right in rules:
        known.append(product(known[left], known[right]))
    found = []
    for sequence in sequences:
        total = UNIT
        for place, symbol in enumerate(sequence):
            total = product(total, known[symbol]) if place else known[symbol]
        found.append(total)
    return found


class _Link:
    """The audit of one piece, behind those of the pieces before it."""

    __slots__ = ("parent", "text", "state")

    def __init__(self, parent: _Link | None, text: str, state: int):
        self.parent, self.text, self.state = parent, text, state


def _reads_less(one: _Link, two: _Link) -> bool:
    """Compares two audits over the same pieces back to where they part."""
    a, b = [], []
    while one is not two:
        a.append(one.text)
        b.append(two.text)
        one, two = one.parent, two.parent
    return "".join(reversed(a)) < "".join(reversed(b))


class Fold:
    """Takes the matrices of a conversation's pieces in order; keeps a cost and an audit per state."""

    def __init__(self):
        root = _Link(None, "", START)
        self.cells: list[tuple[int, _Link] | None] = [(0, root), None, None, None]
        self.root = root

    def add(self, matrix: Sequence[tuple[int, str] | None]) -> None:
        found: list[tuple[int, _Link] | None] = [None] * STATES
        for i, cell in enumerate(self.cells):
            if cell is None:
                continue
            for j in range(STATES):
                step = matrix[i * STATES + j]
                if step is None:
                    continue
                cost, known = cell[0] + step[0], found[j]
                if known is not None and cost > known[0]:
                    continue
                link = _Link(cell[1], step[1], j)
                if known is None or cost < known[0] or _reads_less(link, known[1]):
                    found[j] = (cost, link)
        self.cells = found

    def result(self) -> tuple[int, list[tuple[int, str]]]:
        """Cost, and per piece the state before it and its audit; insertions at the end of the
        conversation belong to the last piece."""
        self.add([cell and (cell[0], cell[1].flat()) for cell in INSERTIONS])
        cost, link = self.cells[ENDS[0]], None
        for end in ENDS:
            cell = self.cells[end]
            if cell and (link is None or cell[0] < cost or cell[0] == cost and _reads_less(cell[1], link)):
                cost, link = cell
        audits = []
        while link is not self.root:
            audits.append((link.parent.state, link.text))
            link = link.parent
        audits.reverse()
        if len(audits) > 1:
            (state, text), (_, tail) = audits[-2:]
            audits[-2:] = [(state, text + tail)]
        return cost, audits


def edits(audit: str, state: int, symbols: str) -> Iterable[tuple[str, int | None, str | None]]:
    """Every edit of a piece with the place of its row (None: inserted) and, where the edit sets the
    role, the letter of that role."""
    row = 0
    for edit in audit:
        role = None
        if edit in "IR":
            role = "a" if state == AFTER_USER else "u"
        if edit == "I":
            yield edit, None, role
        else:
            yield edit, row, role
            row += 1
        if edit != "D":
            state = STEP[state, role or symbols[row - 1].lower()]
