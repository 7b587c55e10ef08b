"""A run-length index of many strings, and matching statistics streamed against it, on numpy arrays.

Strings carry a tag; those of one tag are indexed together and apart from all others, in one pass over the arrays.
"""

from __future__ import annotations

import numpy as np


class RunIndex:
    """Run-length Burrows-Wheeler transform of the strings of each tag, with sampled ends of runs.

    Rows are the suffixes by tag, then in order, equal ones by string. Kept are: the symbols (``text``, a string's bytes
    plus one and an end mark), the first row, symbol and LF target of each run, and the text places of its first and last row.
    """

    def __init__(self, strings: np.ndarray, lengths: np.ndarray, tags: np.ndarray):
        """``strings``: bytes (none is 255) end to end; ``lengths`` and ``tags`` of each string; tags do not fall."""
        stops = np.cumsum(lengths + 1)
        n = int(stops[-1])
        self.text = np.zeros(n + 1, np.uint8)
        keep = np.ones(n, bool)
        keep[stops - 1] = False
        self.text[:n][keep] = strings + np.uint8(1)
        tag_of = np.repeat(tags, lengths + 1)
        order = self._sorted(np.repeat(stops, lengths + 1) - np.arange(n), int(lengths.max()) + 1, tag_of)
        before, tag = self.text[order - 1], tag_of[order]
        heads = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (tag[1:] != tag[:-1]))))
        self.starts, self.chars = heads, before[heads].astype(np.int64)
        sizes = np.diff(np.append(heads, n))
        self.samples, self.ends, self.lasts = order[heads], order[heads + sizes - 1], heads + sizes - 1
        # Rows that one symbol precedes go, in their order, to the rows that begin with it: LF by runs.
        kind = tag[heads].astype(np.int64) * 256 + self.chars
        by_kind = np.argsort(kind, kind="stable")
        self.targets = np.empty(len(heads), np.int64)
        self.targets[by_kind] = np.cumsum(sizes[by_kind]) - sizes[by_kind]
        # Runs of a tag and symbol in order, to find the ones next to a row.
        self.ordered = kind[by_kind] * len(heads) + by_kind
        self.tag_rows = np.searchsorted(tag, np.arange(int(tags[-1]) + 2))

    def _sorted(self, left: np.ndarray, longest: int, tag_of: np.ndarray) -> np.ndarray:
        """Suffix order by doubled prefixes; ``left``: symbols up to the end of the string, the end mark included."""
        n = len(left)
        key = self.text[:n].astype(np.uint64)
        for size in (1, 2, 4):
            rest = np.zeros(n, np.uint64)
            rest[: max(0, n - size)] = key[size:]
            key = (key << np.uint64(8 * size)) | rest
        key &= ~np.uint64(0) << (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
        size = 8
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            if size >= longest:
                return np.lexsort((rank, tag_of))
            rest = np.zeros(n, np.int64)
            rest[: max(0, n - size)] = rank[size:] + 1
            rest[left <= size] = 0
            key = (rank.astype(np.uint64) << np.uint64(32)) | rest.astype(np.uint64)
            size *= 2

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the text at ``a`` and at ``b``, up to ``most``."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        last = len(self.text) - 1
        while len(live):
            at = out[live, None] + np.arange(16)
            same = self.text[np.minimum(a[live, None] + at, last)] == self.text[np.minimum(b[live, None] + at, last)]
            run = np.where(same.all(1), 16, np.argmin(same, 1))
            out[live] = np.minimum(out[live] + run, most[live])
            live = live[(run == 16) & (out[live] < most[live])]
        return out

    def statistics(self, patterns: np.ndarray, lengths: np.ndarray, tags: np.ndarray):
        """Streams the patterns backwards, all at once, and yields (patterns, places, lengths, text places): the longest
        match of each pattern from each place on with a string of its tag, and where one such match stands."""
        stops = np.cumsum(lengths)
        first = stops - lengths
        runs = len(self.starts)
        row = self.tag_rows[tags]
        at = self.samples[np.searchsorted(self.starts, row, "right") - 1]
        match = np.zeros(len(lengths), np.int64)
        active = np.arange(len(lengths))
        for done in range(1, int(lengths.max()) + 1):
            active = active[lengths[active] >= done]
            place = lengths[active] - done
            char = patterns[first[active] + place].astype(np.int64) + 1
            q, here, known = row[active], at[active], match[active]
            run = np.searchsorted(self.starts, q, "right") - 1
            other = np.flatnonzero(self.chars[run] != char)
            known = known + 1
            here = here - 1
            if len(other):
                # The symbol does not precede the row: go on from the end of a run next to it that it does precede,
                # the one whose suffix has more in common with what is matched.
                kind = tags[active[other]] * 256 + char[other]
                k = np.searchsorted(self.ordered, kind * runs + run[other])
                below = self.ordered[np.minimum(k, runs - 1)]
                above = self.ordered[np.maximum(k - 1, 0)]
                has = np.stack(((k < runs) & (below // runs == kind), (k > 0) & (above // runs == kind)))
                near = np.stack((below, above)) % runs
                samples = np.stack((self.samples[near[0]], self.ends[near[1]]))
                shared = np.full(has.shape, -1, np.int64)
                for side in (0, 1):
                    some = np.flatnonzero(has[side])
                    shared[side, some] = self.common(samples[side, some], here[other[some]] + 1, known[other[some]] - 1)
                side = (shared[1] > shared[0]).astype(np.int64)
                each = np.arange(len(other))
                found = shared[side, each] >= 0
                chosen = near[side, each]
                rows = np.where(side == 0, self.starts[chosen], self.lasts[chosen])
                start = self.tag_rows[tags[active[other]]]
                run[other] = np.where(found, chosen, run[other])
                q[other] = np.where(found, rows, q[other])
                here[other] = np.where(found, samples[side, each] - 1, self.samples[np.searchsorted(self.starts, start, "right") - 1])
                known[other] = np.where(found, shared[side, each] + 1, 0)
            row[active] = self.targets[run] + q - self.starts[run]
            if len(other):
                lost = other[~found]
                row[active[lost]] = start[~found]
            at[active], match[active] = here, known
            yield active, place, known, here


def later_windows(strings: np.ndarray, lengths: np.ndarray, groups: np.ndarray, documents: np.ndarray, width: int, symbols_an_index: int = 1 << 20) -> np.ndarray:
    """Masks: bit k of string i is set if a string of its group and of a smaller document holds its window k.

    The documents of a group are numbered. Two numbers differ first in one bit: at each bit the strings that have it not
    are indexed, by group and by what comes before the bit, and those that have it are streamed through, so each pair of
    documents is compared once and only the larger one is marked. ``strings``: bytes end to end; groups do not fall.
    """
    first = np.cumsum(lengths) - lengths
    order = np.lexsort((documents, groups))
    g, d = groups[order], documents[order]
    new_group = np.concatenate(([True], g[1:] != g[:-1]))
    new = new_group | np.concatenate(([True], d[1:] != d[:-1]))
    count = np.cumsum(new) - 1
    number = np.empty(len(lengths), np.int64)
    number[order] = count - np.maximum.accumulate(np.where(new_group, count, 0))
    group = np.empty(len(lengths), np.int64)
    group[order] = np.cumsum(new_group) - 1
    masks = np.zeros(len(lengths), np.int64)
    for bit in range(int(number.max()).bit_length()) if len(lengths) else ():
        part = np.unique(np.stack((group, number >> (bit + 1))), axis=1, return_inverse=True)[1].ravel()
        has = (number >> bit) & 1
        both = (np.bincount(part, has, part.max() + 1) > 0) & (np.bincount(part, 1 - has, part.max() + 1) > 0)
        some = np.flatnonzero(both[part])
        some = some[np.argsort(part[some], kind="stable")]
        tag = np.concatenate(([0], np.cumsum(part[some][1:] != part[some][:-1]))) if len(some) else some
        # Tags in turn fill indexes of bounded size; one with more symbols has an index of its own.
        before = np.cumsum(lengths[some]) // symbols_an_index
        batch = before[np.searchsorted(tag, tag)] if len(some) else before
        for b in np.unique(batch):
            mine = batch == b
            own, t = some[mine], tag[mine] - tag[mine][0]
            low, high = own[has[own] == 0], own[has[own] == 1]
            take = lambda x: np.repeat(first[x], lengths[x]) + np.arange(int(lengths[x].sum())) - np.repeat(np.cumsum(lengths[x]) - lengths[x], lengths[x])
            index = RunIndex(strings[take(low)], lengths[low], t[has[own] == 0])
            for which, place, match, _ in index.statistics(strings[take(high)], lengths[high], t[has[own] == 1]):
                hit = match >= width
                masks[high[which[hit]]] |= np.int64(1) << place[hit]
    return masks
