"""Suffix and common-prefix arrays of one shard by induced sorting with its queue in files.

The classic scheme: suffixes are of type L or S by the comparison with their right neighbour; the sorted LMS suffixes (S after
L) induce all L suffixes in one ascending sweep and those induce all S suffixes in one descending sweep. The LMS suffixes are
sorted by naming their substrings (which the same two sweeps sort) and recursion on the string of names.

A sweep is a priority queue keyed by the first symbol. Entries of one key are taken in the order they were put in, so the
queue is one file region per symbol with a write head: entries are appended at the heads and read front to back. The regions
and their prefix values are ``numpy.memmap`` files of a temporary folder of the machine as soon as the shard is longer than
``memory`` symbols. Text, packed words, ranks, names and results are arrays in memory, so memory bounds the shard. Entries are suffix positions; with them goes the common-prefix value with
the entry before, which a sweep derives as one plus the smallest value between the two sources.

Entries are moved in batches: a batch is a range of symbols whose entries put nothing back into the range, so it is final
when it is read. A single symbol that feeds itself (runs of one symbol) is read in waves.
"""

import os
import tempfile

import numpy as np

PASSES = 30  # words looked at before names are given; longer equal prefixes are left to the recursion
CAP = 255  # common-prefix values are exact below this and stop here


class Space:
    """Arrays in memory, or in files of a folder that is removed at the end."""

    def __init__(self, memory: int):
        self.memory, self.folder, self.count = memory, None, 0

    def full(self, size: int, value, kind) -> np.ndarray:
        if size <= self.memory:
            return np.full(size, value, kind)
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="induced-")
        self.count += 1
        array = np.memmap(os.path.join(self.folder.name, str(self.count)), kind, "w+", shape=(size,))
        array[:] = value
        return array

    def close(self):
        if self.folder is not None:
            self.folder.cleanup()


def types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last symbol is the unique smallest one and of type S."""
    turns = np.flatnonzero(text[:-1] != text[1:])
    out = np.empty(len(text), bool)
    out[:-1] = np.repeat(text[turns] < text[turns + 1], np.diff(turns, prepend=-1))
    out[-1] = True
    return out


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last], both inclusive, by a table of powers of two."""
    span = last - first + 1
    level = np.frexp(span)[1] - 1
    out, table = np.empty(len(span), values.dtype), values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[first[at]], table[last[at] - (1 << k) + 1])
    return out


class Sweep:
    """One pass: ``seeds`` are sorted entries, ``wanted`` tells which suffixes are put into the queue.

    Symbols are visited in ascending order; of each, queue entries come before seeds. With ``values`` (common prefixes of
    each seed with the seed before) and ``runs`` (run length of the symbol at each position) the common prefixes of the queue
    are derived too.
    """

    def __init__(self, space, text, seeds, wanted, symbols, values=None, runs=None):
        self.text, self.seeds, self.wanted, self.values, self.runs = text, seeds, wanted, values, runs
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(text[wanted], minlength=symbols))])
        self.head = self.begin[:-1].copy()
        self.seed_begin = np.searchsorted(text[seeds], np.arange(symbols + 1))
        self.queue = space.full(int(self.begin[-1]), -1, np.int32)
        self.prefix = space.full(len(self.queue), 0, np.uint8) if values is not None else None
        # Per symbol: smallest common prefix since its last entry was put in; -1 before the first.
        self.since = np.full(symbols, -1, np.int16)
        self.run(symbols)

    def run(self, symbols: int):
        work = self.begin + self.seed_begin
        symbol, want = 0, 4096
        while symbol < symbols:
            if work[symbol] == work[-1]:
                break
            end = min(symbols, max(symbol + 1, int(np.searchsorted(work, work[symbol] + want, "right")) - 1))
            entries = self._entries(symbol, end)
            targets = self._targets(entries)
            lowest = int(targets.min()) if len(targets) else symbols
            if lowest >= end:
                want = min(want * 2, 1 << 20)
            elif lowest > symbol:
                size = work[lowest] - work[symbol]
                want, end = max(1024, int(size) * 2), lowest
                entries = self._entries(symbol, end)
            else:
                end = symbol + 1
                self._waves(symbol)
                entries = self._entries(symbol, end)
            self._put(entries, symbol, end, skip=symbol if lowest == symbol else -1)
            symbol = end

    def _entries(self, symbol: int, end: int):
        queued = np.asarray(self.queue[self.begin[symbol]: self.begin[end]])
        seeds = np.asarray(self.seeds[self.seed_begin[symbol]: self.seed_begin[end]])
        if end == symbol + 1:
            queued = queued[: self.head[symbol] - self.begin[symbol]]
            return np.concatenate([queued, seeds])
        queued = queued[queued >= 0]
        both = np.concatenate([queued, seeds])
        key = self.text[both].astype(np.int64) * 2
        key[len(queued):] += 1
        return both[np.argsort(key, kind="stable")]

    def _targets(self, entries):
        before = entries[entries > 0] - 1
        return self.text[before[self.wanted[before]]]

    def _values_of(self, entries, symbol: int, end: int):
        """Common prefix of each entry of complete symbols with the entry before; 0 for the first of a symbol."""
        queued = np.asarray(self.prefix[self.begin[symbol]: self.begin[end]])
        seeds = np.asarray(self.values[self.seed_begin[symbol]: self.seed_begin[end]])
        letters = self.text[entries]
        if end == symbol + 1:
            out = np.concatenate([queued[: len(entries) - len(seeds)], seeds])
            of_seed = np.arange(len(entries)) >= len(entries) - len(seeds)
        else:
            of_seed = ~self.wanted[entries]
            out = np.empty(len(entries), np.uint8)
            out[of_seed], out[~of_seed] = seeds, queued
        border = np.flatnonzero(of_seed[1:] & ~of_seed[:-1]) + 1
        out[border] = np.minimum(np.minimum(self.runs[entries[border]], self.runs[entries[border - 1]]), CAP)
        out[np.flatnonzero(np.diff(letters, prepend=letters[:1] + 1))] = 0
        return out

    def _waves(self, symbol: int):
        done = self.begin[symbol]
        while done < self.head[symbol]:
            stop = self.head[symbol]
            entries = np.asarray(self.queue[done:stop])
            before = entries - 1
            at = np.flatnonzero((entries > 0) & self.wanted[before] & (self.text[before] == symbol))
            if self.prefix is not None:
                values = np.asarray(self.prefix[done:stop]).copy()
                if done == self.begin[symbol]:
                    values[0] = 0
                self._derive(values, at, np.full(len(at), symbol))
            self.queue[stop: stop + len(at)] = before[at]
            self.head[symbol] = stop + len(at)
            done = stop

    def _put(self, entries, symbol: int, end: int, skip: int):
        before = entries - 1
        ok = entries > 0
        ok[ok] = self.wanted[before[ok]]
        if skip >= 0:
            ok[ok] = self.text[before[ok]] != skip
        at = np.flatnonzero(ok)
        values = self._values_of(entries, symbol, end) if self.prefix is not None and len(entries) else None
        if not len(at):
            if values is not None:
                self.since = np.where(self.since < 0, self.since, np.minimum(self.since, values.min()))
            return
        targets = self.text[before[at]]
        order = np.argsort(targets, kind="stable")
        at, targets = at[order], targets[order].astype(np.int64)
        if values is not None:
            self._derive(values, at, targets)
        first = np.flatnonzero(np.diff(targets, prepend=-1))
        counts = np.diff(np.append(first, len(targets)))
        place = np.repeat(self.head[targets[first]] - first, counts) + np.arange(len(targets))
        self.queue[place] = before[at]
        self.head[targets[first]] += counts

    def _derive(self, values, at, targets):
        """Values of the entries that the sources ``at`` (grouped by target) put at the heads, and what is pending afterwards."""
        if len(at):
            first = np.flatnonzero(np.diff(targets, prepend=-1))
            start = np.empty(len(at), np.int64)
            start[1:] = at[:-1] + 1
            start[first] = 0
            lowest = _range_min(values, start, at).astype(np.int16)
            lowest[first] = np.minimum(lowest[first], self.since[targets[first]])
            counts = np.diff(np.append(first, len(at)))
            place = np.repeat(self.head[targets[first]] - first, counts) + np.arange(len(at))
            self.prefix[place] = np.minimum(lowest + 1, CAP).astype(np.uint8)
            last = at[first + counts - 1]
        self.since = np.where(self.since < 0, self.since, np.minimum(self.since, values.min()))
        if len(at):
            rest = np.append(np.minimum.accumulate(values[::-1])[::-1], CAP)
            self.since[targets[first]] = rest[last + 1]


def _both_sweeps(space, text, kinds, symbols, lms, values=None, runs=None):
    """L entries and S entries in ascending order from sorted LMS entries, with common prefixes if wanted."""
    up = Sweep(space, text, lms, ~kinds, symbols, values, runs)
    mirrored = symbols - 1 - text
    shifted = None
    if values is not None:
        shifted = np.zeros(len(up.queue), np.uint8)
        shifted[1:] = up.prefix[1:][::-1]
    induced = kinds.copy()
    induced[-1] = False  # the last suffix is no neighbour of another
    down = Sweep(space, mirrored, up.queue[::-1], induced, symbols, shifted, runs)
    small = np.concatenate([[len(text) - 1], down.queue[::-1]]).astype(np.int32)
    if values is None:
        return up.queue, small, None, None
    back = np.zeros(len(small), np.uint8)
    back[2:] = down.prefix[1:][::-1]
    return up.queue, small, up.prefix, back


def _words(text, symbols):
    """As many symbols as fit into 63 bits from every position on; bits of a symbol and symbols of a word."""
    bits = max(1, int(symbols - 1).bit_length())
    width = 63 // bits
    padded = np.concatenate([text, np.zeros(width, text.dtype)])
    words = np.zeros(len(text) + 1, np.int64)
    for k in range(width):
        words[:-1] = (words[:-1] << bits) | padded[k: k + len(text)]
    return words, bits, width


def _ranked(text, symbols, lms, passes):
    """LMS positions sorted by a prefix that holds their LMS substring, and the name (rank) of each by that prefix.

    As many symbols as fit are packed into a word; a pass orders the positions that are still tied by their next word. At least
    ``passes`` words are looked at, and more while a substring is longer, so equal names mean equal substrings.
    """
    words, bits, width = _words(text, symbols)
    length = np.diff(np.append(lms, len(text) - 1)) + 1
    order = np.argsort(words[lms], kind="stable")
    key = words[lms[order]]
    new = np.ones(len(lms), bool)
    new[1:] = key[1:] != key[:-1]
    slots, covered, done = np.arange(len(lms)), width, 1
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        if done >= passes:
            group = np.cumsum(new) - 1
            far = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
            far[group[tied & (length[order] > covered)]] = True
            slots = np.flatnonzero(tied & far[group]) if len(far) else slots[:0]
        else:
            group = None
            slots = np.flatnonzero(tied)
        if not len(slots):
            break
        group = np.cumsum(new)[slots] if group is None else group[slots]
        own = order[slots]
        key = words[np.minimum(lms[own] + covered, len(text))]
        again = np.lexsort((key, group))
        order[slots], key = own[again], key[again]
        new[slots[1:]] |= (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        covered += width
        done += 1
    names = np.empty(len(lms), np.int32)
    names[order] = np.cumsum(new) - 1
    return order, names, int(new.sum()), covered


def _sorted_lms(space, text, kinds, symbols, depth):
    """LMS positions in the order of their suffixes, by recursion on the string of their names."""
    lms = np.flatnonzero(kinds[1:] & ~kinds[:-1]) + 1
    order, names, count, covered = _ranked(text, symbols, lms, PASSES)
    if count == len(lms) or covered >= depth:
        return lms[order].astype(np.int32)
    inner_kinds = types(names)
    inner = _sorted_lms(space, names, inner_kinds, count, len(names))
    large, small, _, _ = _both_sweeps(space, names, inner_kinds, count, inner)
    return lms[_woven(names, large, small)].astype(np.int32)


def _woven(text, large, small):
    """L entries before S entries of each symbol."""
    both = np.concatenate([large, small])
    key = text[both].astype(np.int64) * 2
    key[len(large):] += 1
    return both[np.argsort(key, kind="stable")]


def _common(text, symbols, left, right):
    """Common prefix of suffix pairs, up to CAP, word by word over the pairs still equal."""
    words, bits, width = _words(text, symbols)
    out = np.full(len(left), CAP, np.int32)
    open_, step = np.arange(len(left)), 0
    while len(open_) and step < CAP:
        other = words[np.minimum(left[open_] + step, len(text))] ^ words[np.minimum(right[open_] + step, len(text))]
        ended = other != 0
        at, other = open_[ended], other[ended]
        equal = np.zeros(len(at), np.int32)
        for k in range(1, width):
            equal += other >> (bits * (width - k)) == 0
        out[at] = step + equal
        open_ = open_[~ended]
        step += width
    return np.minimum(out, CAP).astype(np.uint8)


def suffix_array(text: np.ndarray, symbols: int, memory: int = 1 << 23, depth: int = None):
    """Suffix positions in order and the common prefix (up to CAP) of each with the one before.

    ``text`` holds values below ``symbols`` and ends with a 0 that occurs nowhere else. With ``depth``, suffixes need to be
    ordered by that many symbols only: where names reach so far, there is no recursion.
    """
    space = Space(memory)
    try:
        kinds = types(text)
        lms = _sorted_lms(space, text, kinds, symbols, depth or len(text))
        values = np.zeros(len(lms), np.uint8)
        values[1:] = _common(text, symbols, lms[1:].astype(np.int64), lms[:-1].astype(np.int64))
        turns = np.append(np.flatnonzero(text[:-1] != text[1:]), len(text) - 1)
        runs = np.repeat(turns, np.diff(turns, prepend=-1)) + 1 - np.arange(len(text))
        large, small, large_values, small_values = _both_sweeps(space, text, kinds, symbols, lms, values, runs)
        both, known = np.concatenate([large, small]), np.concatenate([large_values, small_values])
        key = text[both].astype(np.int64) * 2
        key[len(large):] += 1
        order = np.argsort(key, kind="stable")
        sa, prefix, key = both[order], known[order], key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        prefix[first] = 0
        border = first[1:][(key[first[1:]] & 1 == 1) & (key[first[1:] - 1] == key[first[1:]] - 1)]
        prefix[border] = np.minimum(np.minimum(runs[sa[border]], runs[sa[border - 1]]), CAP)
        return sa, prefix
    finally:
        space.close()
