"""Run-length indexes over many small groups of strings, with matching statistics.

All groups' suffixes are sorted in one array, group by group, so every group has
a Burrows-Wheeler transform of its own in a stretch of rows. Only its runs are
kept: head, first row, where the head's rows map to, and the text positions of
the run's first and last row. Matching statistics are streamed for all patterns
side by side, from their ends to their beginnings: a symbol equal to the head of
the row's run follows the mapping; any other jumps to the nearest run with that
head above or below, whose sampled end gives a text position, and comparing the
text there with the current match tells how much of it is left.
"""

from __future__ import annotations

import numpy as np

TERMINAL = 256


def _sorted_suffixes(symbols: np.ndarray, group: np.ndarray, string: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Suffixes in the order of (group, content, string); ``stop`` is where a suffix's string ends."""
    n = len(symbols)
    place = np.arange(n)

    def ahead(values: np.ndarray, h: int) -> np.ndarray:
        return np.where(place + h <= stop, values[np.minimum(place + h, n - 1)], 0)

    packed = group.astype(np.int64)
    for h in range(3):  # terminals are 0, so what follows them is, too
        packed = packed << 9 | ahead(symbols, h)
    order = np.argsort(packed, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[False, packed[order][1:] != packed[order][:-1]])
    h = 3
    while rank[order[-1]] < n - 1:
        # a suffix that ends within h symbols differs from equal ones by its string alone
        following = np.where(place + h <= stop, ahead(rank, h), string)
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
        h *= 2
    return order


class RunIndex:
    """Indexes of groups 0, 1, ... of strings; ``group`` ascends."""

    def __init__(self, strings: list[bytes], group: np.ndarray):
        lengths = np.array([len(s) for s in strings], np.int64)
        first = np.cumsum(lengths + 1) - lengths - 1
        total = int((lengths + 1).sum())
        self.text = np.zeros(total + 16, np.uint8)
        self.words = np.ndarray((total + 8,), "<u8", self.text, strides=(1,))  # the eight bytes from each place on
        self.text[:total] = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
        string = np.repeat(np.arange(len(strings)), lengths + 1)
        self.stop = (first + lengths)[string]
        symbols = self.text[:total].astype(np.int64) + 1
        symbols[first + lengths] = 0
        own = np.asarray(group, np.int64)[string]
        rows = _sorted_suffixes(symbols, own, string, self.stop)
        before = np.where(np.isin(rows, first), TERMINAL, self.text[rows - 1].astype(np.int64))
        of = own[rows]
        change = np.r_[True, (before[1:] != before[:-1]) | (of[1:] != of[:-1])]
        self.start = np.flatnonzero(change)
        length = np.diff(np.r_[self.start, total])
        self.head, run_group = before[self.start], of[self.start]
        self.first_at, self.last_at = rows[self.start], rows[self.start + length - 1]
        self.group_row = np.searchsorted(of, np.arange(int(of[-1]) + 1))
        # rows that begin with a symbol lie together in their group; runs fill them in their own order
        begins = np.sort(own << 9 | symbols)
        runs = np.lexsort((np.arange(len(self.start)), self.head, run_group))
        head_key = run_group[runs] << 9 | self.head[runs] + 1
        earlier = np.cumsum(length[runs]) - length[runs]
        leads = np.r_[True, head_key[1:] != head_key[:-1]]
        earlier -= np.repeat(earlier[leads], np.diff(np.r_[np.flatnonzero(leads), len(runs)]))
        self.to = np.empty(len(runs), np.int64)
        self.to[runs] = np.searchsorted(begins, head_key) + earlier
        self.by_head = head_key * len(runs) + runs  # ascends

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes two text positions share, up to ``most``."""
        most = np.minimum(most, np.minimum(self.stop[a] - a, self.stop[b] - b))
        shared = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):  # eight bytes at once; the lowest differing one ends the match
            at = shared[live]
            differ = self.words[a[live] + at] ^ self.words[b[live] + at]
            equal = np.where(differ == 0, 8, np.bitwise_count((differ & -differ) - np.uint64(1)) >> 3)
            shared[live] = at + equal
            live = live[(equal == 8) & (shared[live] < most[live])]
        return np.minimum(shared, most)

    def statistics(self, patterns: list[bytes], group: np.ndarray) -> np.ndarray:
        """For each pattern (a row, padded with 0) and place: the longest match in its group that begins there."""
        lengths = np.array([len(p) for p in patterns], np.int64)
        width = int(lengths.max())
        symbol = np.zeros((len(patterns), width), np.uint8)
        for i, p in enumerate(patterns):
            symbol[i, width - len(p) :] = np.frombuffer(p, np.uint8)  # all patterns end in one column
        found = np.zeros((len(patterns), width), np.int32)
        group = np.asarray(group, np.int64)
        row = self.group_row[group]
        at = self.first_at[np.searchsorted(self.start, row, "right") - 1]
        length = np.zeros(len(patterns), np.int64)
        runs = len(self.start)
        for column in range(width - 1, -1, -1):
            live = np.flatnonzero(lengths > width - 1 - column)
            c, q = symbol[live, column].astype(np.int64), row[live]
            run = np.searchsorted(self.start, q, "right") - 1
            key = (group[live] << 9 | c + 1) * runs
            step = self.head[run] == c
            # the nearest runs of that head in the group
            nearest = np.searchsorted(self.by_head, key + run)
            jump = np.flatnonzero(~step)
            if len(jump):
                below = nearest[jump]
                low = np.searchsorted(self.by_head, key[jump])
                high = np.searchsorted(self.by_head, key[jump] + runs)
                here, kept = at[live][jump], length[live][jump]
                best = np.full(len(jump), -1)
                to_row, to_at = q[jump].copy(), here.copy()
                for there, side in ((below - 1, below > low), (below, below < high)):
                    some = np.flatnonzero(side)
                    other = self.by_head[there[some]] % runs
                    above = there[some] < below[some]
                    sample = np.where(above, self.last_at[other], self.first_at[other])
                    end = np.where(other + 1 < runs, self.start[np.minimum(other + 1, runs - 1)], self.stop.size) - 1
                    place = np.where(above, end, self.start[other])
                    shared = self._common(sample, here[some], kept[some])
                    better = shared > best[some]
                    chosen = some[better]
                    best[chosen], to_row[chosen], to_at[chosen] = shared[better], place[better], sample[better]
                missing = best < 0
                length[live[jump]] = np.where(missing, -1, best)
                q[jump], run[jump] = to_row, np.searchsorted(self.start, to_row, "right") - 1
                at[live[jump]] = to_at
            gone = length[live] < 0  # the group has no such symbol: begin anew
            moved = self.to[run] + q - self.start[run]
            fresh = self.group_row[group[live]]
            row[live] = np.where(gone, fresh, moved)
            at[live] = np.where(gone, self.first_at[np.searchsorted(self.start, fresh, "right") - 1], at[live] - 1)
            length[live] = np.where(gone, 0, length[live] + 1)
            found[live, column] = length[live]
        out = np.zeros_like(found)
        for i, n in enumerate(lengths):
            out[i, :n] = found[i, width - n :]
        return out
