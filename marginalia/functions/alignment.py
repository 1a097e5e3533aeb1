"""Word alignment of all rows of an Arrow batch at once, as the standard sequence matcher has it.

The matcher takes the longest common run of a rectangle (the first one of several), then those of the rectangles
before and behind it. A run keeps its length until a longer one cuts it, and what is left lies in one rectangle.
So the order of all runs by length gives the same blocks, and no rectangle is looked through again for each
of its blocks: long runs are found first, from hashes of neighbouring words, and short ones only in the gaps they leave.
"""

from __future__ import annotations

import difflib
import heapq
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.batches import SPACE, characters, chunks, unit_begins

#: Runs of so many words are looked for, longest first, and single words after them.
STEPS = (4, 2)
#: Rows that have more pairs of equal neighbours than fit here go through the standard matcher, the largest first.
PAIRS = 1 << 22
#: From this many words on, words that make up more than a hundredth start no block.
POPULAR_FROM = 200
_MIX, _GAP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

Blocks = tuple[np.ndarray, np.ndarray, np.ndarray]


def word_ids(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The units of all rows as numbers, where those of each row begin and the end, and the rows in need of a closer look."""
    whole, c, starts = characters(rows)
    begins, kinds, unsure = unit_begins(c, starts)
    held = kinds != SPACE
    inner = held & ~begins
    first = np.flatnonzero(begins)
    last = np.flatnonzero(held & ~np.append(inner[1:], False)) + 1 if len(c) else first
    edges = np.empty(2 * len(first), np.int64)
    edges[::2], edges[1::2] = first, last
    bytes_ = whole.encode()
    if len(bytes_) != len(c):
        at = np.zeros(len(c) + 1, np.int64)
        np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000), out=at[1:])
        edges = at[edges]
    if not len(first):
        return first, np.zeros(len(starts), np.int64), unsure
    # Units and the blanks between them in turn.
    cut = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(bytes_))
    ids = cut.dictionary_encode().indices.to_numpy()[::2].astype(np.int64)
    return ids, np.searchsorted(first, starts), unsure


def _popular(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which words make up too much of a long row."""
    out, sizes = np.zeros(len(ids), bool), np.diff(starts)
    for r in np.flatnonzero(sizes >= POPULAR_FROM).tolist():
        _, inverse, counts = np.unique(ids[starts[r] : starts[r + 1]], return_inverse=True, return_counts=True)
        out[starts[r] : starts[r + 1]] = (counts > sizes[r] // 100 + 1)[inverse]
    return out


def _ranges(low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``low[k], low[k] + 1, ...`` of each size, one after another."""
    return np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class _Batch:
    """Two sides of rows, and the blocks found so far: each row begins with an empty one, and one stands behind all."""

    def __init__(self, a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray):
        self.a, self.b, self.a_starts, self.b_starts = a, b, a_starts, b_starts
        self.i, self.j, self.k = a_starts, b_starts, np.zeros(len(a_starts), np.int64)
        self.words = a.tolist(), b.tolist()
        self.popular = _popular(b, b_starts)
        self.popular_before = np.append(0, np.cumsum(self.popular))
        self.whole_rows = np.zeros(len(a_starts) - 1, bool)

    def add(self, blocks: Blocks) -> None:
        i, j, k = (np.concatenate(x) for x in zip((self.i, self.j, self.k), blocks))
        order = np.lexsort((k, j, i))
        self.i, self.j, self.k = i[order], j[order], k[order]

    def gaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where the gap behind each block begins and ends, on both sides."""
        return self.i[:-1] + self.k[:-1], self.i[1:], self.j[:-1] + self.k[:-1], self.j[1:]

    def runs(self, m: int) -> tuple[np.ndarray, ...]:
        """Gap, begin on both sides and length of all common runs of ``m`` words or more in the gaps."""
        i1, i2, j1, j2 = self.gaps()
        rooms = np.flatnonzero((i2 - i1 >= m) & (j2 - j1 >= m))

        def side(ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sizes = high[rooms] - low[rooms] - m + 1
            places, gap = _ranges(low[rooms], sizes), np.repeat(rooms, sizes)
            key = gap.astype(np.uint64) * _GAP
            for x in range(m):
                key = key * _MIX + ids[places + x].astype(np.uint64)
            return places, gap, key ^ (key >> np.uint64(29))

        ia, ga, ka = side(self.a, i1, i2)
        jb, gb, kb = side(self.b, j1, j2)
        plain = self.popular_before[jb + m] == self.popular_before[jb]
        jb, gb, kb = jb[plain], gb[plain], kb[plain]
        order = np.argsort(kb)
        jb, gb, kb = jb[order], gb[order], kb[order]
        first = np.flatnonzero(np.append(True, kb[1:] != kb[:-1])) if len(kb) else order
        keys = np.append(kb[first], np.uint64(0))
        known = np.searchsorted(keys[:-1], ka)
        found = np.flatnonzero((keys[known] == ka) & (known < len(first)))
        ia, ga, known = ia[found], ga[found], known[found]
        low, sizes = first[known], np.diff(np.append(first, len(kb)))[known]
        if sizes.sum() > PAIRS:
            keep = self._few(np.searchsorted(self.a_starts, ia, "right") - 1, sizes)
            ia, ga, low, sizes = ia[keep], ga[keep], low[keep], sizes[keep]
        at = _ranges(low, sizes)
        i, j, gap = np.repeat(ia, sizes), jb[at], np.repeat(ga, sizes)
        same = gap == gb[at]
        for x in range(m):
            same &= self.a[i + x] == self.b[j + x]
        i, j, gap = i[same], j[same], gap[same]
        order = np.argsort((j - i) * (len(self.a) + 1) + i)
        i, j, gap = i[order], j[order], gap[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1) | (gap[1:] != gap[:-1])
        begin = np.flatnonzero(new)
        return gap[begin], i[begin], j[begin], np.diff(np.append(begin, len(i))) + m - 1

    def _few(self, row: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Leaves the rows with the most pairs to the standard matcher, until the others fit."""
        pairs = np.bincount(row, sizes, len(self.whole_rows))
        order = np.argsort(pairs)
        self.whole_rows[order[np.cumsum(pairs[order]) > PAIRS]] = True
        return ~self.whole_rows[row]

    def step(self, m: int) -> None:
        gap, i, j, k = self.runs(m)
        order = np.lexsort((j, i, gap))
        gap, i, j, k = gap[order], i[order], j[order], k[order]
        # Where no run of a gap stands in the way of another, all are blocks.
        next_to = gap[1:] == gap[:-1]
        cross = next_to & ((i[:-1] + k[:-1] > i[1:]) | (j[:-1] + k[:-1] > j[1:]))
        i1, i2, j1, j2 = self.gaps()
        hard = np.zeros(len(i1), bool)
        hard[gap[1:][cross]] = True
        hard[gap[self.popular_before[j2[gap]] > self.popular_before[j1[gap]]]] = True
        easy = ~hard[gap]
        hard = np.unique(gap[~easy])
        heap = list(zip((-k).tolist(), i.tolist(), j.tolist()))
        popular = self.popular_before[j2[hard]] > self.popular_before[j1[hard]]
        ends = (np.searchsorted(gap, hard, x) for x in ("left", "right"))
        taken: list[tuple[int, int, int]] = []
        for lo, hi, *room in zip(*[x.tolist() for x in (*ends, i1[hard], i2[hard], j1[hard], j2[hard], popular)]):
            self._longest_first(taken, heap[lo:hi], m, *room)
        rest = np.array(taken, np.int64).reshape(-1, 3)
        self.add(tuple(np.append(x[easy], y) for x, y in zip((i, j, k), rest.T)))

    def _longest_first(self, taken: list, heap: list, m: int, alo: int, ahi: int, blo: int, bhi: int, popular: bool) -> None:
        """Takes the blocks that runs of a gap give, longest first; one that has been cut waits for its new length."""
        heapq.heapify(heap)
        bi, ei, bj, ej = [alo, ahi], [alo, ahi], [blo, bhi], [blo, bhi]
        a, b = self.words
        while heap:
            size, i, j = heapq.heappop(heap)
            size = -size
            p = bisect_right(bi, i)
            s, e = 0, 0
            # It begins in one gap, or in a block, and may end behind the next block.
            for q in (p, p + 1):
                if q < len(bi):
                    s = max(0, ei[q - 1] - i, ej[q - 1] - j)
                    e = min(size, bi[q] - i, bj[q] - j)
                    if e > s:
                        break
            if e <= s:
                continue
            i, j, size, cut = i + s, j + s, e - s, e - s < size
            if cut:
                if size >= m:
                    heapq.heappush(heap, (-size, i, j))
                continue
            if popular:
                while i > ei[q - 1] and j > ej[q - 1] and a[i - 1] == b[j - 1]:
                    i, j, size = i - 1, j - 1, size + 1
                while i + size < bi[q] and j + size < bj[q] and a[i + size] == b[j + size]:
                    size += 1
            for kept, x in ((bi, i), (ei, i + size), (bj, j), (ej, j + size)):
                kept.insert(q, x)
            taken.append((i, j, size))

    def singles(self) -> None:
        """Blocks that begin with a single common word, when no longer run is left.

        The first word of a gap that the other side has is taken where that side has it first, and what is
        behind both is looked at next: nothing before them has a counterpart.
        """
        i1, i2, j1, j2 = self.gaps()
        rooms = np.flatnonzero((i1 < i2) & (j1 < j2))
        top = max(self.a.max(initial=0), self.b.max(initial=0)) + 1
        ia, ga = _ranges(i1[rooms], (i2 - i1)[rooms]), np.repeat(rooms, (i2 - i1)[rooms])
        jb, gb = _ranges(j1[rooms], (j2 - j1)[rooms]), np.repeat(rooms, (j2 - j1)[rooms])
        plain = ~self.popular[jb]
        ka, kb = ga * top + self.a[ia], (gb * top + self.b[jb])[plain]
        order = np.argsort(kb, kind="stable")
        jb, kb = jb[plain][order], kb[order]
        low, high = np.searchsorted(kb, ka), np.searchsorted(kb, ka, "right")
        some = np.flatnonzero(low < high)
        ga = ga[some]
        (a, b), places = self.words, jb.tolist()
        blocks: list[tuple[int, int, int]] = []
        last, ci, cj = -1, 0, 0
        columns = (ga, ia[some], low[some], high[some], i1[ga], i2[ga], j1[ga], j2[ga])
        for g, i, lo, hi, alo, ahi, blo, bhi in zip(*[x.tolist() for x in columns]):
            if g != last:
                last, ci, cj = g, alo, blo
            if i < ci or (p := bisect_left(places, cj, lo, hi)) == hi:
                continue
            j, size = places[p], 1
            while i > ci and j > cj and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                size += 1
            blocks.append((i, j, size))
            ci, cj = i + size, j + size
        if blocks:
            self.add(tuple(np.array(x, np.int64) for x in zip(*blocks)))

    def corners(self) -> None:
        """In gaps without a run, popular words at the very begin still count."""
        i1, i2, j1, j2 = self.gaps()
        room = np.flatnonzero((i1 < i2) & (j1 < j2))
        room = room[self.a[i1[room]] == self.b[j1[room]]]
        sizes = []
        for g in room.tolist():
            n = min(i2[g] - i1[g], j2[g] - j1[g])
            other = np.flatnonzero(self.a[i1[g] : i1[g] + n] != self.b[j1[g] : j1[g] + n])
            sizes.append(other[0] if len(other) else n)
        self.add((i1[room], j1[room], np.array(sizes, np.int64)))


def aligned(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, begin and end on both sides of all that differs between the words of each row, in order."""
    batch = _Batch(a, a_starts, b, b_starts)
    for m in STEPS:
        batch.step(m)
    batch.singles()
    batch.corners()
    i1, i2, j1, j2 = batch.gaps()
    some = (i1 < i2) | (j1 < j2)
    # The empty block at the begin of a row is the first one there.
    row = np.cumsum(_row_heads(batch))[:-1][some] - 1
    found = row, i1[some], i2[some], j1[some], j2[some]
    if not batch.whole_rows.any():
        return found
    rest = [tuple(x[~batch.whole_rows[row]] for x in found)]
    for r in np.flatnonzero(batch.whole_rows).tolist():
        i, j = a_starts[r], b_starts[r]
        codes = difflib.SequenceMatcher(None, a[i : a_starts[r + 1]].tolist(), b[j : b_starts[r + 1]].tolist()).get_opcodes()
        made = [(r, i + x, i + y, j + z, j + w) for op, x, y, z, w in codes if op != "equal"]
        rest.append(tuple(np.array(x, np.int64) for x in zip(*made)) if made else tuple(x[:0] for x in found))
    merged = [np.concatenate(x) for x in zip(*rest)]
    order = np.argsort(merged[0], kind="stable")
    return tuple(x[order] for x in merged)


def _row_heads(batch: _Batch) -> np.ndarray:
    """Which blocks are the empty ones that begin a row."""
    return batch.k == 0


def _shared(pred: tuple[np.ndarray, ...], gold: tuple[np.ndarray, ...], p: np.ndarray, g: np.ndarray, top: int) -> np.ndarray:
    """Rows of the edits both sides have: the same words of the source, and the same words for them."""
    _, x, y = np.intersect1d(*(e[0] * (top + 1) + e[1] for e in (pred, gold)), assume_unique=True, return_indices=True)
    sizes = pred[4][x] - pred[3][x]
    same = (pred[2][x] == gold[2][y]) & (sizes == gold[4][y] - gold[3][y])
    x, y, sizes = x[same], y[same], sizes[same]
    other = p[_ranges(pred[3][x], sizes)] != g[_ranges(gold[3][y], sizes)]
    return pred[0][x][np.bincount(np.repeat(np.arange(len(x)), sizes), other, len(x)) == 0]


def _plain_edits(source: list[str], target: list[str] | None) -> set[tuple[int, int, str]]:
    if target is None:
        return set()
    codes = difflib.SequenceMatcher(None, source, target).get_opcodes()
    return {(i, j, " ".join(target[k:m])) for op, i, j, k, m in codes if op != "equal"}


_COUNTS = ("p", "g", "both")


@F.arrow_udf(T.StructType([T.StructField(x, T.IntegerType()) for x in _COUNTS]))
def rewrite_counts(text: pa.Array, prediction: pa.Array, gold: pa.Array, units: pa.Array) -> pa.Array:
    """Word edits from a text to its prediction and to its gold text, and how many both have.

    A side that is null has no edits. Rows that ``unsure_pattern`` finds bring the units of all three along.
    """
    out = []
    for *sides, known in chunks(text, prediction, gold, units):
        n = len(sides[0])
        ids, starts, unsure = word_ids([x or "" for side in sides for x in side])
        parts = [(ids[starts[s * n] : starts[s * n + n]], starts[s * n : s * n + n + 1] - starts[s * n]) for s in range(3)]
        edits = []
        for s in (1, 2):
            found = aligned(*parts[0], *parts[s])
            # Without the other side there is nothing to align.
            has = np.array([x is not None for x in sides[s]], bool)[found[0]]
            edits.append(tuple(x[has] for x in found))
        both = _shared(*edits, parts[1][0], parts[2][0], len(parts[0][0]))
        counts = [np.bincount(rows, minlength=n).astype(np.int32) for rows in (edits[0][0], edits[1][0], both)]
        for r in np.flatnonzero(unsure.reshape(3, n).any(0)).tolist():
            p, g = (_plain_edits(known[r][0], known[r][s]) for s in (1, 2))
            for x, size in zip(counts, (len(p), len(g), len(p & g))):
                x[r] = size
        out.append(pa.StructArray.from_arrays([pa.array(x) for x in counts], list(_COUNTS)))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([(x, pa.int32()) for x in _COUNTS]))
