"""Suffix sorting by external induction, with capped common-prefix values.

Suffixes are sorted from the seeds (positions where a rising stretch begins): seeds are
ordered by their next symbols, and recursively those that a level leaves equal; then falling (L) suffixes are induced from left to right and rising
(S) ones from right to left. Both passes draw tuples (position, common prefix with the
tuple before) from a monotone priority queue keyed by first symbol: induced tuples
never go back, so the queue keeps one run a symbol, in memory up to a budget and
beyond it in an unnamed scratch file that goes with the task. A symbol's tuples are
drawn a wave at a time, as arrays.

Common prefixes travel with the tuples: two suffixes induced by a pair have one symbol
more in common than the least value between their inducers. Order and values are
exact up to ``depth`` symbols, which is all that a search for repeats of that length asks.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples that a queue holds in memory (9 bytes each) before it goes to its scratch file. A sort of
#: 4 MB has some 3 million of them in a pass, so that its queues do go there.
IN_MEMORY = 1 << 18


class SymbolQueue:
    """A monotone priority queue of tuples (position, common prefix), keyed by symbol."""

    def __init__(self, symbols: int, in_memory: int = IN_MEMORY) -> None:
        self.runs: list[list] = [[] for _ in range(symbols)]
        self.held, self.most, self.file = 0, in_memory, None

    def put(self, symbol: int, where: np.ndarray, prefix: np.ndarray) -> None:
        self.runs[symbol].append((where, prefix))
        self.held += len(where)
        if self.held > self.most:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for run in self.runs:
            for i, part in enumerate(run):
                if len(part) == 2:
                    at = self.file.seek(0, 2)
                    self.file.write(part[0].tobytes())
                    self.file.write(part[1].tobytes())
                    run[i] = (at, len(part[0]), part[0].dtype, part[1].dtype)
        self.held = 0

    def take(self, symbol: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """All tuples that wait for a symbol, in the order of their arrival."""
        out, self.runs[symbol] = [], (run := self.runs[symbol])[:0]
        for part in run:
            if len(part) == 4:
                at, n, kind, small = part
                self.file.seek(at)
                part = (np.frombuffer(self.file.read(n * kind.itemsize), kind), np.frombuffer(self.file.read(n * small.itemsize), small))
            else:
                self.held -= len(part[0])
            out.append(part)
        return out

    def close(self) -> None:
        if self.file:
            self.file.close()


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to ``depth`` symbols."""
    out = np.full(len(a), depth, np.int64)
    live, n = np.arange(len(a)), len(text)
    for k in range(depth):
        p, q = a[live] + k, b[live] + k
        inside = (p < n) & (q < n)
        same = inside & (text[np.minimum(p, n - 1)] == text[np.minimum(q, n - 1)])
        out[live[~same]] = k
        live = live[same]
        if not len(live):
            break
    return out


def rising(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it (S); the last is."""
    n = len(text)
    out = np.ones(n, bool)
    if n < 2:
        return out
    up = text[1:] > text[:-1]  # the next symbol is larger
    differs = np.flatnonzero(text[1:] != text[:-1])
    # a run of one symbol goes as its last does; a run up to the end falls
    runs = np.diff(differs, prepend=-1, append=n - 2)
    out[:-1] = np.repeat(np.append(up[differs], False), runs)
    return out


def sorted_seeds(text: np.ndarray, seeds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds in the order of their suffixes' first ``depth`` symbols, and their common prefixes.

    A level orders the seeds that the levels before left equal by their next symbols,
    recursively, until all differ or the depth is reached. Symbols are packed by their rank in
    the text; the group that a seed is in stands in the upper bits of its key, so that one
    sort of nearly ordered numbers makes a level."""
    there = np.zeros(int(text.max()) + 1, bool)
    there[text] = True
    bits = int(np.count_nonzero(there)).bit_length()
    width = 8 if bits <= 8 else 4
    symbols = np.zeros(len(text) + depth + 8, np.uint64)  # 0: beyond the end
    symbols[: len(text)] = np.cumsum(there).astype(np.uint64)[text]
    for k in (1, 2, 4)[: width.bit_length() - 1]:
        after = symbols[k:].copy()
        symbols <<= np.uint64(bits * k)
        symbols[:-k] |= after
    order = seeds.copy()
    prefix = np.full(len(order), depth, np.int64)
    prefix[:1] = 0
    live, group, done = np.arange(len(order)), np.zeros(len(order), np.uint64), 0
    while len(live) and done < depth:
        above = int(group[-1]).bit_length()
        most = min(width, (64 - above) // bits)
        key = symbols[order[live] + done]
        key >>= np.uint64(bits * (width - most))
        if above:
            key |= group << np.uint64(64 - above)
        by = np.argsort(key, kind="stable")
        order[live], key = order[live][by], key[by]
        at = np.flatnonzero((key[1:] != key[:-1]) & (group[1:] == group[:-1])) + 1
        differ = key[at] ^ key[at - 1]
        same = sum((differ >> np.uint64(bits * (most - 1 - k))) == 0 for k in range(most))
        prefix[live[at]] = np.minimum(done + same, depth)
        tied = np.append(key[1:] == key[:-1], False)
        tied[1:] |= tied[:-1]
        live, key, done = live[tied], key[tied], done + most
        group = np.cumsum(np.append(np.zeros(min(1, len(key)), bool), key[1:] != key[:-1])).astype(np.uint64)
    return order, prefix


def least_between(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of ``prefix[a+1 .. b]`` for many pairs a < b, by tables of doubling reach."""
    out = np.empty(len(a), prefix.dtype)
    reach = np.frexp(b - a)[1] - 1  # floor of the binary logarithm
    table, level = prefix, 0
    for most in range(int(reach.max()) + 1 if len(a) else 0):
        pick = np.flatnonzero(reach == most)
        if len(pick):
            out[pick] = np.minimum(table[a[pick] + 1], table[b[pick] - (1 << most) + 1])
        if len(table) > 1 << level:
            table = np.minimum(table[: len(table) - (1 << level)], table[1 << level :])
        level += 1
    return out


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return parts[0] if len(parts) == 1 else tuple(np.concatenate([p[i] for p in parts]) for i in (0, 1))


def induce(text: np.ndarray, start: list, types: np.ndarray, want: bool, depth: int, symbols: int, in_memory: int) -> list:
    """One pass. ``start[c]``: sorted tuples of the other type with first symbol c (or None).

    ``want``: the type that is induced; rising ones go from the largest symbol down, and
    a tuple's value is then that with the tuple before it in the pass, which is the larger."""
    queue = SymbolQueue(symbols, in_memory)
    pending = np.full(symbols, depth, np.int64)  # least value since a symbol got its last tuple
    fresh = np.ones(symbols, bool)
    out: list = [None] * symbols

    def feed(where: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Induce from a stretch of sorted tuples; returns what stays in the same symbol."""
        if not len(where):
            return None
        before = where - 1
        ok = (where > 0) & (types[before] == want)
        at = np.flatnonzero(ok)
        here = None
        c = text[before[at]]
        order = np.argsort(c, kind="stable")
        at, c = at[order], c[order]
        cut = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
        value = np.empty(len(at), prefix.dtype)
        inner = np.ones(len(at), bool)
        inner[cut] = False
        k = np.flatnonzero(inner)
        value[k] = least_between(prefix, at[k - 1], at[k])
        heads = np.minimum.accumulate(prefix)
        tails = np.minimum.accumulate(prefix[::-1])[::-1]
        got = np.zeros(symbols, bool)
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(at)] if len(cut) else []):
            s = int(c[i])
            value[i] = min(int(pending[s]), int(heads[at[i]]))
            new = np.minimum(value[i:j].astype(np.int64) + 1, depth).astype(prefix.dtype)
            if fresh[s]:
                new[0], fresh[s] = 0, False
            last = int(at[j - 1])
            pending[s] = int(tails[last + 1]) if last + 1 < len(prefix) else depth
            got[s] = True
            part = (before[at[i:j]], new)
            if s == symbol:
                here = part
            else:
                queue.put(s, *part)
        rest = ~got
        pending[rest] = np.minimum(pending[rest], int(heads[-1]))
        return here

    turns = range(symbols - 1, -1, -1) if want else range(symbols)
    for symbol in turns:
        own = []
        waiting = queue.take(symbol)
        wave = joined(waiting) if waiting else None
        while wave is not None:
            own.append(wave)
            wave = feed(*wave)
        if own:
            out[symbol] = joined(own)
        seeds = start[symbol]
        if seeds is not None and len(seeds[0]):
            where, prefix = seeds
            if own:  # where the types meet, the value is found by comparison
                prefix = prefix.copy()
                prefix[0] = common_prefix(text, out[symbol][0][-1:], where[:1], depth)[0]
            feed(where, prefix)
        # between two symbols nothing is common
        pending[:] = 0
    queue.close()
    return out


def by_symbol(text: np.ndarray, order: np.ndarray, prefix: np.ndarray, symbols: int) -> list:
    c = text[order]
    ends = np.searchsorted(c, np.arange(symbols), "right")
    begins = np.searchsorted(c, np.arange(symbols), "left")
    return [(order[a:b], prefix[a:b]) if b > a else None for a, b in zip(begins.tolist(), ends.tolist())]


def suffix_order(text: np.ndarray, depth: int, symbols: int = 257, in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order of their first ``depth`` symbols, and the common prefix of
    each with the one before (capped at ``depth``, 0 at a symbol's first).

    The text must end in a symbol 0 that occurs nowhere else."""
    n = len(text)
    kind = np.uint8 if depth < 256 else np.int32
    types = rising(text)
    seeds = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    order, prefix = sorted_seeds(text, seeds, depth) if len(seeds) else (np.array([n - 1]), np.zeros(1, np.int64))
    prefix = prefix.astype(kind)
    falling = induce(text, by_symbol(text, order, prefix, symbols), types, False, depth, symbols, in_memory)
    # the second pass reads backwards: a tuple's value is then with its neighbour above
    turned = [None if x is None else (x[0][::-1].copy(), np.append(x[1][1:], x[1][:1])[::-1].copy()) for x in falling]
    for x in turned:
        if x is not None:
            x[1][0] = 0
    raised = induce(text, turned, types, True, depth, symbols, in_memory)
    whole, values, last = [], [], None
    for c in range(symbols):
        for x, backwards in ((falling[c], False), (raised[c], True)):
            if c == 0 and not backwards:
                whole.append(np.array([n - 1])), values.append(np.zeros(1, kind))
                continue
            if x is None:
                continue
            where, value = x
            if backwards:
                where, value = where[::-1], np.append(value[:1] * 0, value[::-1][:-1])
            value = value.copy()
            value[0] = common_prefix(text, np.array([last]), where[:1], depth)[0] if last is not None else 0
            whole.append(where), values.append(value)
            last = where[-1]
    return np.concatenate(whole), np.concatenate(values)
