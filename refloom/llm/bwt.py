"""Burrows-Wheeler transform and common prefixes of a string collection, built column by column.

Round j inserts for each string the symbol before its suffix of length j - 1, at the place that the last-to-first mapping
of the transform so far names. The transform and the array of longest common prefixes lie in two external files, which a
round reads and writes from front to back; between rounds memory holds only a position and a symbol for each string. Within
a round the files and two arrays of places are in memory, about 30 bytes a symbol: the caller bounds a collection to a few
MB. The files are a task's scratch in its own folder; a task that runs again makes them anew.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


class Column:
    """An array of bytes in a file that is replaced as a whole. Each round has a file of its own, as file systems bring a
    file that is cut and written again to the disk at once, and one that is soon deleted not at all."""

    def __init__(self, folder: str, name: str, first: np.ndarray):
        self.path, self.turn = os.path.join(folder, name), 0
        first.tofile(f"{self.path}0")

    def read(self) -> np.ndarray:
        return np.fromfile(f"{self.path}{self.turn}", np.uint8)

    def write(self, a: np.ndarray) -> None:
        a.tofile(f"{self.path}{self.turn + 1}")
        os.unlink(f"{self.path}{self.turn}")
        self.turn += 1


def _range_min(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of a[lo:hi] for each pair (lo < hi); a has one more entry behind the last that counts."""
    order = np.argsort(-lo, kind="stable")
    pairs = np.empty(2 * len(lo), np.int64)
    pairs[0::2], pairs[1::2] = lo[order], hi[order]
    out = np.empty(len(lo), np.uint8)
    out[order] = np.minimum.reduceat(a, pairs)[0::2]
    return out


def _mapping(bwt: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places by symbol, the inverse, and what to add to an inverse entry to get where the longer suffix stands."""
    order = np.argsort(bwt, kind="stable")
    inverse = np.empty(len(bwt), np.int64)
    inverse[order] = np.arange(len(bwt))
    return order, inverse, n - int(np.count_nonzero(bwt == 0))


def build(text: np.ndarray, ends: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefixes) of the strings that lie in text one after another and end before ends.

    Symbols are bytes plus one, as 0xFF is in no UTF-8 text and 0 ends a string. Strings are shorter than 255.
    """
    n = len(ends)
    starts = np.concatenate([[0], ends[:-1]])
    lens = ends - starts
    symbols = text + np.uint8(1)
    at = np.arange(n)
    alive = np.arange(n)
    bwt, lcp = Column(folder, "bwt", symbols[ends - 1]), Column(folder, "lcp", np.zeros(n, np.uint8))
    for j in range(1, int(lens.max()) + 1):
        b, common = bwt.read(), lcp.read()
        keep = lens[alive] >= j
        alive, at = alive[keep], at[keep]
        order, inverse, shift = _mapping(b, n)
        k = inverse[at]
        place = k + shift
        padded = np.append(common, np.uint8(0))
        # the suffix before in sorted order starts alike only if the last equal symbol stands before
        before = order[np.maximum(k - 1, 0)]
        has = (k > 0) & (b[before] == b[at])
        own = np.zeros(len(at), np.uint8)
        if has.any():
            own[has] = _range_min(padded, before[has] + 1, at[has] + 1) + 1
        after = order[np.minimum(k + 1, len(b) - 1)]
        nxt = (k + 1 < len(b)) & (b[after] == b[at])
        nxt_val = _range_min(padded, at[nxt] + 1, after[nxt] + 1) + np.uint8(1) if nxt.any() else np.empty(0, np.uint8)
        new = np.zeros(len(b) + len(at), bool)
        new[place] = True
        b2, c2 = np.empty(len(new), np.uint8), np.empty(len(new), np.uint8)
        old = ~new
        b2[old], c2[old] = b, common
        more = lens[alive] > j
        sym = np.zeros(len(at), np.uint8)
        sym[more] = symbols[ends[alive[more]] - 1 - j]
        b2[place], c2[place] = sym, own
        c2[place[nxt] + 1] = nxt_val
        bwt.write(b2)
        lcp.write(c2)
        at = place
    return bwt.read(), lcp.read()


def least_owner(text: np.ndarray, ends: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """For each byte of text: the least owner of a string in which the width bytes from there occur; its own maximum
    value where fewer than width bytes are left in the string."""
    none = np.iinfo(np.int64).max
    n = len(ends)
    starts = np.concatenate([[0], ends[:-1]])
    lens = ends - starts
    with tempfile.TemporaryDirectory() as folder:
        b, common = build(text, ends, folder)
    _, inverse, shift = _mapping(b, n)
    rank = np.empty(len(text), np.int64)
    holder = np.full(len(b), none)
    at, alive = np.arange(n), np.arange(n)
    for j in range(1, int(lens.max()) + 1):
        keep = lens[alive] >= j
        alive, at = alive[keep], at[keep]
        at = inverse[at] + shift
        rank[ends[alive] - j] = at
        if j >= width:
            holder[at] = owner[alive]
    heads = np.flatnonzero(common < width)
    least = np.minimum.reduceat(holder, heads)
    group = np.cumsum(common < width) - 1
    left = np.repeat(ends, lens) - np.arange(len(text))
    return np.where(left >= width, least[group[rank]], none)
