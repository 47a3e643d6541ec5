"""Suffix order and common prefixes by external induced sorting in numpy.

A monotone priority queue holds suffix tuples, (start, length of the prefix shared with the suffix before), by first symbol;
beyond `limit` bytes it lives in a temporary file (`Queue`). The suffixes that are popped, together with the leftmost-S
ones, in order, put their left neighbours into the queue; a neighbour's common prefix is one more than the least of those
between the two suffixes that pushed it and the one before it. Leftmost-S substrings are named after a first induction; where
names repeat the string of names is sorted by the same procedure, one level down, and gives order and common prefixes of
the leftmost-S suffixes, from which a second induction gives all. A string of names that fits into memory (`BASE`) ends
the recursion: it is sorted there, by doubling.

Popping one suffix at a time would be slow, so a window of symbols is popped at once, as far as nothing that it pushes
falls into the window itself; such windows hold about the square root of the symbols even where all names differ.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of queued tuples beyond which a queue moves to a temporary file.
QUEUE_BYTES = 4 << 20
#: Tuples popped at once, at most.
POPPED = 1 << 18
#: Names that are sorted in memory: about 100 MB.
BASE = 2 << 20


def range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of x[a..b], both ends included, for each pair (a <= b)."""
    out = np.empty(len(a), x.dtype)
    if not len(a):
        return out
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(x[a[at]], x[b[at] - (1 << k) + 1])
        x = np.minimum(x[: -(1 << k)], x[1 << k :]) if len(x) > 1 << k else x
    return out


class Queue:
    """Tuples by symbol, in the order in which they came; how many each symbol gets is known."""

    def __init__(self, counts: np.ndarray, limit: int):
        self.begin = np.concatenate([[0], np.cumsum(counts)])
        self.head, self.tail = self.begin[:-1].copy(), self.begin[:-1].copy()
        n = int(self.begin[-1])
        self.on_disk = 8 * n > limit
        if self.on_disk:
            self.file = tempfile.TemporaryFile()
            self.file.truncate(8 * n)
            self.items = np.memmap(self.file, np.int32, "r+", shape=(n, 2))
        else:
            self.items = np.zeros((n, 2), np.int32)

    def push(self, symbol: np.ndarray, start: np.ndarray, common: np.ndarray | None) -> None:
        """Tuples sorted by symbol."""
        edge = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        size = np.diff(np.append(edge, len(symbol)))
        at = self.head[symbol] + np.arange(len(symbol)) - np.repeat(edge, size)
        self.items[at, 0] = start
        if common is not None:
            self.items[at, 1] = common
        self.head[symbol[edge]] += size

    def window(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, start and common prefix of what symbols low to high - 1 hold and wasn't taken."""
        n = self.head[low:high] - self.tail[low:high]
        symbol = np.repeat(np.arange(low, high), n)
        at = np.arange(len(symbol)) + np.repeat(self.tail[low:high] - np.cumsum(n) + n, n)
        found = self.items[at]
        return symbol, found[:, 0], found[:, 1]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        found = np.array(self.items)
        return found[:, 0], found[:, 1]


def types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than its right neighbour (S); the end is less than every symbol."""
    n = len(t)
    s = np.zeros(n, bool)
    if n < 2:
        return s
    up, same = t[:-1] < t[1:], t[:-1] == t[1:]
    # a symbol equal to the next takes the type of the run's end
    end = np.where(same, n - 1, np.arange(n - 1))
    end = np.minimum.accumulate(end[::-1])[::-1]
    s[:-1] = np.where(end < n - 1, up[np.minimum(end, n - 2)], False)
    return s


def run_lengths(t: np.ndarray) -> np.ndarray:
    """Length of the run of equal symbols that starts at each place."""
    last = np.append(np.flatnonzero(t[1:] != t[:-1]), len(t) - 1)
    return (last[np.searchsorted(last, np.arange(len(t)))] - np.arange(len(t)) + 1).astype(np.int32)


def induce(symbol: np.ndarray, kinds: int, pushed: np.ndarray, length: np.ndarray, seeds: np.ndarray, shared: np.ndarray | None, first: int | None, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and common prefixes, in order, of the suffixes that `pushed` marks.

    `seeds` (in order) stand after the pushed suffixes of their symbol; `shared` are their common prefixes, each with the
    seed before it (None: common prefixes aren't asked for). `length`: `run_lengths`. `first` is pushed before all.
    """
    counts = np.bincount(symbol[pushed], minlength=kinds)
    queue = Queue(counts, limit)
    # what each suffix pushes: the symbol of its left neighbour, `kinds` for none; small numbers sort faster
    pushes = np.full(len(symbol), kinds, np.uint16 if kinds < 65_535 else np.int32)
    pushes[1:][pushed[:-1]] = symbol[:-1][pushed[:-1]]
    if first is not None:
        queue.push(symbol[first : first + 1], np.array([first]), np.array([0]))
    seed_symbol = symbol[seeds]
    seed_at = np.searchsorted(seed_symbol, np.arange(kinds + 1))
    last_from = np.full(kinds, -1, np.int64)  # the symbol whose suffix pushed last into each symbol
    since = np.zeros(kinds, np.int32)  # the least common prefix since then, if that symbol is still popped
    active, before = np.zeros(0, np.int64), (-1, 0, False)  # the suffix popped last: symbol, start, seed
    sources = np.cumsum(counts + np.diff(seed_at))
    low, most = 0, 1024
    while low < kinds:
        done = sources[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sources, done + most, side="right")))
        sym, start, common = queue.window(low, high)
        a, b = seed_at[low], seed_at[high]
        seed = np.zeros(len(sym) + b - a, bool)
        seed[len(sym) :] = True
        if shared is not None:
            common = np.concatenate([common, shared[a:b]])
        sym, start = np.concatenate([sym, seed_symbol[a:b]]), np.concatenate([start, seeds[a:b]])
        if high > low + 1 and b > a:
            order = np.argsort(2 * sym + seed, kind="stable")
            sym, start, seed, common = sym[order], start[order], seed[order], common[order] if shared is not None else common
        target = pushes[start]
        stop = int(target.min(initial=kinds))  # what is pushed into `stop` comes after what is there
        if stop < high:
            n = int(np.searchsorted(2 * sym + seed, 2 * stop, side="right"))
            sym, start, seed, target, common = sym[:n], start[:n], seed[:n], target[:n], common[:n]
            queue.tail[low:stop] = queue.head[low:stop]
            queue.tail[stop] = queue.head[stop]
            most = max(256, most // 2)
            low = stop
        else:
            queue.tail[low:high] = queue.head[low:high]
            most, low = min(POPPED, 2 * most), high
        if not len(sym):
            continue
        at = np.flatnonzero(target < kinds)
        at = at[np.argsort(target[at], kind="stable")]
        to = target[at].astype(np.int64)
        if shared is None:
            if len(at):
                queue.push(to, start[at] - 1, None)
            continue
        value = common.astype(np.int32)
        # a seed after a pushed suffix of its symbol shares the shorter run of that symbol
        was_sym, was_start, was_seed = (np.concatenate([[x], y[:-1]]) for x, y in zip(before, (sym, start, seed)))
        edge = seed & ((was_sym != sym) | (was_seed == 0))
        value[edge] = np.where(was_sym == sym, np.minimum(length[was_start], length[start]), 0)[edge]
        value[was_sym != sym] = 0
        if len(at):
            origin = sym[at]
            leads = np.concatenate([[True], to[1:] != to[:-1]])
            out = np.ones(len(at), np.int32)
            same = np.flatnonzero(~leads & (np.concatenate([[-1], origin[:-1]]) == origin))
            out[same] = 1 + range_min(value, at[same - 1] + 1, at[same])
            lead = np.flatnonzero(leads)
            goes_on = lead[(last_from[to[lead]] == origin[lead]) & (origin[lead] == before[0])]
            out[goes_on] = 1 + np.minimum(since[to[goes_on]], np.minimum.accumulate(value)[at[goes_on]])
            out[lead[queue.head[to[lead]] == queue.begin[to[lead]]]] = 0
            queue.push(to, start[at] - 1, out)
        # what the last symbol has pushed so far, for the windows that go on with it
        end = sym[-1]
        if end == before[0]:
            since[active] = np.minimum(since[active], value.min())
        else:
            active = np.zeros(0, np.int64)
        if len(at):
            final = np.flatnonzero(np.append(to[1:] != to[:-1], True))
            last_from[to[final]] = origin[final]
            final = final[origin[final] == end]
            rest = np.append(np.minimum.accumulate(value[::-1])[::-1], np.int32(np.iinfo(np.int32).max))
            since[to[final]] = rest[at[final] + 1]
            active = np.union1d(active, to[final])
        before = (int(sym[-1]), int(start[-1]), bool(seed[-1]))
    return queue.all()


def common_substrings(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of t[a..] and t[b..], up to `most`."""
    out, live, at = np.zeros(len(a), np.int64), np.flatnonzero(most > 0), 0
    while len(live):
        live = live[t[a[live] + at] == t[b[live] + at]]
        at += 1
        out[live] = at
        live = live[most[live] > at]
    return out


def sorted_in_memory(names: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same as `sorted_suffixes`, as far as `most` symbols reach, by doubling."""
    n, k = len(names), 1
    order = np.argsort(names, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(names[order]) != 0]))
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)  # where the group of equals begins
    rank[order] = np.repeat(first, size)
    live = order[np.repeat(size > 1, size)]  # in groups of more than one, in order
    while len(live) and k < most:
        after = np.where(live + k < n, rank[np.minimum(live + k, n - 1)] + 1, 0)
        key = rank[live] * (n + 1) + after
        o = np.argsort(key, kind="stable")
        live, key = live[o], key[o]
        group = rank[live]
        edge = np.concatenate([[True], group[1:] != group[:-1]])
        place = np.arange(len(live))
        slot = group + place - np.maximum.accumulate(np.where(edge, place, 0))
        order[slot] = live
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(live)))
        rank[live] = np.repeat(slot[start], size)
        live = live[np.repeat(size > 1, size)]
        k *= 2
    a, b = order[:-1], order[1:]
    return order, np.concatenate([[0], common_substrings(names, a, b, np.minimum(len(names) - np.maximum(a, b), most))])


def sorted_suffixes(t: np.ndarray, kinds: int, limit: int = QUEUE_BYTES, base: int = BASE, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes of `t` (symbols under `kinds`), sorted, and each one's common prefix with the one before.

    With `depth` suffixes may stand in any order where so many symbols are common, and common prefixes of so many may come out less,
    but not under `depth`. Up to `base` names are sorted in memory.
    """
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    t = t.astype(np.int32)
    s, length, mirrored = types(t), run_lengths(t), kinds - 1 - t
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1

    def both(seeds: np.ndarray, shared: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes from the leftmost-S ones; without common prefixes the S ones alone."""
        large, near = induce(t, kinds, ~s, length, seeds, shared, n - 1, limit)
        # downwards: the larger of two neighbours has their common prefix, so values move on by one
        down = None if shared is None else np.concatenate([[0], near[:0:-1]])
        small, far = induce(mirrored, kinds, s, length, large[::-1], down, None, limit)
        small = small[::-1]
        if shared is None:
            return small, np.zeros(0, np.int32)
        # of a symbol the L ones come first
        of_large, of_small = t[large], t[small]
        n_large, n_small = (np.cumsum(np.bincount(x, minlength=kinds)) for x in (of_large, of_small))
        sa, lcp = np.empty(n, np.int32), np.empty(n, np.int32)
        at_large = np.arange(len(large)) + np.concatenate([[0], n_small])[of_large]
        at_small = np.arange(len(small)) + n_large[of_small]
        sa[at_large], sa[at_small] = large, small
        up = np.append(far[1:], 0)[::-1]  # with the next smaller one of the same symbol
        lcp[at_large], lcp[at_small] = near, up
        turn = at_small[np.concatenate([[True], of_small[1:] != of_small[:-1]])] if len(small) else at_small
        turn = turn[turn > 0]
        lcp[turn] = np.where(t[sa[turn - 1]] == t[sa[turn]], np.minimum(length[sa[turn - 1]], length[sa[turn]]), 0)
        lcp[at_large[np.concatenate([[True], of_large[1:] != of_large[:-1]])]] = 0
        return sa, lcp

    if len(lms) < 2:
        return both(lms, np.zeros(len(lms), np.int32))
    # names of the leftmost-S substrings, which reach to the next leftmost-S place
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    found = both(lms[np.argsort(t[lms], kind="stable")], None)[0]
    found = found[is_lms[found]].astype(np.int64)
    place = np.empty(n, np.int64)
    place[lms] = np.arange(len(lms))
    size = np.append(np.diff(lms) + 1, n - lms[-1])
    a, b = found[:-1], found[1:]
    la, lb = size[place[a]], size[place[b]]
    prefix = common_substrings(t, a, b, np.minimum(la, lb))
    same = (la == lb) & (prefix == la) & (a + la < n) & (b + lb < n)
    name = np.concatenate([[0], np.cumsum(~same)])
    names = np.empty(len(lms), np.int64)
    names[place[found]] = name
    apart = np.concatenate([[0], prefix[~same]])  # of each name and the one before
    most = -(-(depth or n) // 2)  # a name spans two symbols at least
    if len(names) <= base:
        below, common = sorted_in_memory(names, most)
    else:
        below, common = sorted_suffixes(names, int(name[-1]) + 1, limit, base, most)
    # common names, and what the first names that differ have in common
    x, y, k = below[:-1].astype(np.int64), below[1:].astype(np.int64), common[1:].astype(np.int64)
    p, q = lms[x + k], lms[y + k]
    u, v = names[x + k], names[y + k]
    differ = np.flatnonzero(u != v)  # beyond `most` they may be equal, or stand in any order
    rest = np.zeros(len(x), np.int64)
    rest[differ] = range_min(apart, np.minimum(u, v)[differ] + 1, np.maximum(u, v)[differ])
    lp, lq = size[x + k], size[y + k]
    # one is the other's prefix: its end begins a run that rises, the other's one that falls
    short = np.minimum(lp, lq)
    whole = (rest == short) & (u != v) & (p + short < n) & (q + short < n)
    at = np.minimum(short - 1, n - 1 - np.maximum(p, q))
    rest = np.where(whole, short - 1 + np.minimum(length[p + at], length[q + at]), rest)
    return both(lms[below], np.concatenate([[0], q - lms[y] + rest]).astype(np.int32))


def repeated(t: np.ndarray, valid: np.ndarray, depth: int, limit: int = QUEUE_BYTES, base: int = BASE) -> np.ndarray:
    """Marks the starts of the bytes `t`, of those that `valid` marks, whose first `depth` bytes also start at another."""
    hit = np.zeros(len(t), bool)
    sa, lcp = sorted_suffixes(t, 256, limit, base, depth)
    at = np.flatnonzero(valid[sa])
    if len(at) > 1:
        near = range_min(lcp, at[:-1] + 1, at[1:]) >= depth
        hit[sa[at[:-1][near]]] = True
        hit[sa[at[1:][near]]] = True
    return hit
