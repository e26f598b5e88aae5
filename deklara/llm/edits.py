"""Whether two texts lie within an edit distance."""

from __future__ import annotations

import numpy as np

#: Characters are counted by their code modulo this number; in tables modulo the other one.
_BINS, FEW_BINS = 128, 32
#: Pairs side by side, at least and at most, and their characters at most; others, and longer texts, go one by one.
LEAST, SIDE, CELLS, LONG = 16, 1024, 1 << 21, 20_000
#: Steps between two looks at what is done, and the share of pairs from which on these are left out.
LOOK, KEEP = 16, 0.7


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def counts_of(codes: np.ndarray, bins: int = _BINS) -> np.ndarray:
    return np.bincount(codes % bins, minlength=bins)


def may_be_within(counts: np.ndarray, other: np.ndarray, most: int) -> bool:
    """An edit takes one character away and gives one at most."""
    change = counts - other
    more = int(change[change > 0].sum())
    return max(more, more - int(change.sum())) <= most


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and replacements turn ``a`` into ``b`` (code points).

    Bit-parallel: a column of the distance matrix is two long integers of vertical differences.  Equal
    beginnings and ends are left out, and it stops when the bound is out of reach.
    """
    n = min(len(a), len(b))
    apart = a[:n] != b[:n]
    first = int(apart.argmax()) if apart.any() else n
    a, b, n = a[first:], b[first:], n - first
    if n:
        apart = a[len(a) - n :][::-1] != b[len(b) - n :][::-1]
        last = int(apart.argmax()) if apart.any() else n
        a, b = a[: len(a) - last], b[: len(b) - last]
    if not len(a) or not len(b):
        return max(len(a), len(b)) <= most
    places = {int(c): int.from_bytes(np.packbits(a == c, bitorder="little").tobytes(), "little") for c in np.unique(a)}
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance, left = full, 0, len(a), len(b)
    for c in b.tolist():
        equal = places.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        distance += bool(up & top) - bool(down & top)
        left -= 1
        if distance - left > most:
            return False
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return distance <= most


def all_within(pairs: list[tuple[np.ndarray, np.ndarray]], most: list[int]) -> np.ndarray:
    """``within`` of many pairs, which are put together by length and walk through their matrices side by side."""
    found = np.zeros(len(pairs), bool)
    sizes = np.array([max(len(a), len(b)) for a, b in pairs], np.int64)
    order, at = np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        # The longest of the next ones decides how many fit and how much is filled.
        some = order[at : at + SIDE]
        some = some[sizes[some] <= 1.25 * sizes[some[0]] + 16]
        some = some[: max(1, CELLS // max(1, int(sizes[some[-1]])))]
        at += len(some)
        if len(some) < LEAST or sizes[some[-1]] > LONG:
            found[some] = [within(*pairs[i], most[i]) for i in some.tolist()]
        else:
            sides = [pairs[i] if len(pairs[i][0]) >= len(pairs[i][1]) else pairs[i][::-1] for i in some.tolist()]
            found[some] = _side_by_side(sides, np.array([most[i] for i in some.tolist()], np.int64))
    return found


def _columns(texts: list[np.ndarray], rows: int) -> np.ndarray:
    """The texts as columns."""
    filled = np.zeros((len(texts), rows), np.uint32)
    for row, text in zip(filled, texts, strict=True):
        row[: len(text)] = text
    return np.ascontiguousarray(filled.T)


def _side_by_side(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Whether the pairs, the longer text first, are within their bounds.

    A step is an anti-diagonal of all matrices: cell i of step s is the distance of i characters of the one to s - i of the
    other.  A way with ``most`` edits strays from the diagonals between the two corners by half of what the
    lengths leave, so only these are filled.  Distances never fall along the diagonal that ends in the result:
    pairs whose bound is exceeded on it are done.
    """
    n, m = (np.array([len(p[side]) for p in pairs], np.int64) for side in (0, 1))
    met = np.zeros(len(pairs), bool)
    open_ = np.flatnonzero(n - m <= most)
    if not len(open_):
        return met
    n, m, most = n[open_], m[open_], most[open_]
    rows, columns, stray = int(n.max()), int(m.max()), int(((most - (n - m)) // 2).max())
    wide = int((n - m + (most - (n - m)) // 2).max())
    kind, top = (np.uint8, 220) if int(most.max()) < 200 else (np.int16, 30_000)
    one, two = _columns([pairs[i][0] for i in open_.tolist()], rows), _columns([pairs[i][1] for i in open_.tolist()], columns)
    highest = int(max(one.max(initial=0), two.max(initial=0)))
    codes = np.uint8 if highest < 1 << 8 else np.uint16 if highest < 1 << 16 else np.uint32
    one, two = one.astype(codes), two[::-1].astype(codes)
    # Row i + 1 holds cell i; the rows beside the filled ones are out of reach.
    last, before, now = (np.full((rows + 3, len(n)), top, kind) for _ in range(3))
    before[1] = 0
    met[open_[n + m == 0]] = True
    for step in range(1, rows + columns + 1):
        low, high = max(0, step - columns, (step - stray + 1) // 2), min(rows, step, (step + wide) // 2)
        first, final = max(low, 1), min(high, step - 1)
        if first <= final:
            cells = now[first + 1 : final + 2]
            np.minimum(before[first : final + 1], before[first + 1 : final + 2], out=cells)
            cells += 1
            differ = one[first - 1 : final] != two[columns - step + first : columns - step + final + 1]
            np.minimum(cells, last[first : final + 1] + differ.view(np.uint8), out=cells)
        if low == 0:
            now[1] = min(step, top)
        if high == step:
            now[step + 1] = min(step, top)
        now[low], now[high + 2] = top, top
        ends = np.flatnonzero(n + m == step)
        met[open_[ends]] = now[n[ends] + 1, ends] <= most[ends]
        if step % LOOK == 0:
            np.minimum(now, top, out=now)
            row = (step + n - m) // 2  # on the diagonal; of odd sums it was the step before
            at = np.arange(len(n))
            reached = np.where((step + n - m) % 2 == 0, now[np.minimum(row, rows) + 1, at], before[np.minimum(row, rows) + 1, at])
            going = np.flatnonzero((n + m > step) & ((reached <= most) | (step <= n - m)))
            if not len(going):
                break
            if len(going) < KEEP * len(n):
                n, m, most, open_ = n[going], m[going], most[going], open_[going]
                one, two, last, before, now = (np.ascontiguousarray(x[:, going]) for x in (one, two, last, before, now))
        last, before, now = before, now, last
    return met
