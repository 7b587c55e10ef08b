"""Anchors of fixed-length windows, and hashes of runs, on numpy arrays: shared by the two operators on repeated spans.

Every window of ``width`` symbols chooses its anchor: the leftmost of the k-mers with the least hash in it. Equal
windows choose alike, so repeats are found by comparing anchors, of which there are far fewer than windows. Windows
that follow each other mostly share their anchor; the run of symbols that they cover together is the anchor's context.
"""

from __future__ import annotations

import numpy as np

from .common import mixed

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


_KNOWN: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_KEEP = 1 << 20


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k to n; those of short runs are kept."""
    known = _KNOWN.get(base)
    if known is None or len(known[0]) <= n:
        size = max(n, 1024) + 1 if n >= _KEEP else _KEEP
        out = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        known = out[0], out[1]
        if size <= _KEEP:
            _KNOWN[base] = known
    return known[0][:n], known[1][: n + 1]


class Rolling:
    """Hashes of any run of a sequence of 64-bit symbols: equal runs have equal hashes."""

    def __init__(self, symbols: np.ndarray, base: int = BASES[0]):
        n = len(symbols)
        power, self.back = powers(base, n)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(symbols * power, out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))

    def fixed(self, size: int) -> np.ndarray:
        """Hashes of all runs of ``size`` symbols."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mixed((self.sums[size:] - self.sums[:n]) * self.back[:n])


def least(keys: np.ndarray, size: int) -> np.ndarray:
    """Minima of all runs of ``size`` keys."""
    done, out = 1, keys
    while 2 * done <= size:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < size:
        rest = size - done
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def anchors(hashes: np.ndarray, lengths: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place of the anchor, first window, number of windows) for every run of windows with one anchor.

    ``hashes`` are those of all k-mers of the documents laid end to end, ``lengths`` the documents' numbers of symbols;
    places count from the start of the first document. Windows that reach over a document's end are left out.
    """
    total = int(lengths.sum())
    empty = np.zeros(0, np.int64)
    if total < width:
        return empty, empty, empty, empty
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    chosen = least(keys, width - k + 1) & np.uint64(0xFFFFFFFF)
    stops = np.cumsum(lengths)
    begins = stops - lengths
    # Runs of windows with one anchor, cut where documents begin; what reaches over a document's end is clipped off.
    first = np.unique(np.concatenate(([0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1, begins[begins < len(chosen)])))
    document = np.searchsorted(stops, first, "right")
    n = np.minimum(np.append(first[1:], len(chosen)), stops[document] - width + 1) - first
    good = n > 0
    first = first[good]
    return document[good], chosen[first].astype(np.int64), first, n[good]


def covered(length: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Boolean: which of ``length`` places lie in some [start, stop)."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, stops, -1)
    return np.cumsum(change[:-1]) > 0
