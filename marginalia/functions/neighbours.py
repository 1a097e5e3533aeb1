"""Pairs and triples of neighbouring words, told apart exactly within a task.

A word is numbered within its batch of rows, and what is compared are numbers. Number 0 is the empty
word: it stands as the third word of a pair that ends its text. ``packed`` gives each place's distinct
triples with the words they need, so that another task can number them anew.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What lies between the words of ``text.tokens``.
BETWEEN = "[^a-z0-9']+"
COUNTS = ["pairs", "triples", "distinct_pairs", "distinct_triples"]


def _numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each word, and the words by number; the empty word has number 0."""
    coded = pa.concat_arrays([pa.array([""], words.type), words]).dictionary_encode()
    return coded.indices.to_numpy()[1:], coded.dictionary


def _triples(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Place of the text and three word numbers of every two neighbours, and the words by number."""
    pieces = pc.split_pattern_regex(texts, BETWEEN)
    ids, words = _numbered(pieces.flatten())
    kept = ids > 0
    ids, of = ids[kept], pc.list_parent_indices(pieces).to_numpy()[kept].astype(np.int32)
    same = of[1:] == of[:-1]
    third = np.zeros(len(same), np.int32)
    third[:-1][same[1:]] = ids[2:][same[1:]]
    return of[:-1][same], np.stack([ids[:-1][same], ids[1:][same], third[same]]), words


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One number per row that orders the rows by both; a ``high`` too big for that is ranked first."""
    if not len(high):
        return high
    width = int(low.max()) + 1
    if int(high.max()) >= (1 << 63) // width - 1:
        high = np.unique(high, return_inverse=True)[1]
    return high.astype(np.int64) * width + low


def _distinct(place: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct triple of a place, by place, and whether it begins another pair."""
    pair = _joined(_joined(place, ids[0]), ids[1])
    triple = _joined(pair, ids[2])
    order = np.argsort(triple)
    at = order[np.diff(triple[order], prepend=-1) != 0]
    # Ranks keep the order of what they rank, so the triples of a pair lie together.
    return at, np.diff(pair[at], prepend=-1) != 0


def count_texts(table: pa.Table) -> pa.Table:
    """``COUNTS`` of every batch whose lower-cased texts all lie in ``table``."""
    table = table.combine_chunks()
    batches = table["batch_uid"].chunk(0).dictionary_encode(null_encoding="encode")
    of, ids, _ = _triples(table["text"].chunk(0))
    batch = batches.indices.to_numpy()[of]
    at, new_pair = _distinct(batch, ids)
    rows = [batch, batch[ids[2] > 0], batch[at][new_pair], batch[at][ids[2][at] > 0]]
    counts = [np.bincount(x, minlength=len(batches.dictionary)) for x in rows]
    return pa.table([batches.dictionary, *counts], ["batch_uid", *COUNTS])


def _pieces(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for some in rows:
        held.append(some)
        n += some.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _spots(words: pa.Array, first: np.ndarray, second: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A number below ``parts`` for every pair of words, the same in every task."""
    digest = np.array([zlib.crc32(w.encode()) for w in words.to_pylist()], np.uint64)
    mixed = digest[first] * np.uint64(0x9E3779B97F4A7C15) + digest[second]
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed >>= np.uint64(33)
    return (mixed % parts.astype(np.uint64)).astype(np.int32)


def packed(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``batch_uid, parts, text`` as distinct triples per batch and ``spot`` below ``parts``.

    A pair of words has one spot in its batch, whatever follows it and in whichever task it is found.
    About ``size`` bytes of text are looked at together.
    """

    def lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _pieces(rows, size):
            batches = table["batch_uid"].chunk(0).dictionary_encode(null_encoding="encode")
            batch = batches.indices.to_numpy()
            parts = np.zeros(len(batches.dictionary), np.int32)
            parts[batch] = table["parts"].to_numpy()
            of, ids, words = _triples(table["text"].chunk(0))
            if not len(of):
                continue
            batch = batch[of]
            spot = _spots(words, ids[0], ids[1], parts[batch])
            place = (np.cumsum(parts) - parts)[batch] + spot
            at, _ = _distinct(place, ids)
            cuts = np.concatenate([np.flatnonzero(np.diff(place[at], prepend=-1)), [len(at)]])
            used, again = [], np.empty((3, len(at)), np.int32)
            for a, b in zip(cuts, cuts[1:]):
                numbers, back = np.unique(ids[:, at[a:b]], return_inverse=True)
                used.append(numbers)
                again[:, a:b] = back.reshape(3, -1)
            first = at[cuts[:-1]]
            found = pa.record_batch(
                {
                    "batch_uid": batches.dictionary.take(pa.array(batch[first])),
                    "spot": pa.array(spot[first], pa.int32()),
                    "pairs": np.bincount(place)[place[first]],
                    "triples": np.bincount(place[ids[2] > 0], minlength=parts.sum())[place[first]],
                    "words": lists(words.take(pa.array(np.concatenate(used))), np.cumsum([len(x) for x in used])),
                    **{f"id{k}": lists(pa.array(again[k]), cuts[1:]) for k in range(3)},
                }
            )
            for k in range(0, len(found), 32):
                yield found.slice(k, 32)

    return pack


def count_packed(table: pa.Table) -> pa.Table:
    """``COUNTS`` of one spot of a batch from all that was packed for it."""
    table = table.combine_chunks()
    lists = [table[c].chunk(0) for c in ("words", "id0", "id1", "id2")]
    sizes = [pc.list_value_length(x).to_numpy() for x in lists[:2]]
    numbers, _ = _numbered(lists[0].flatten())
    shift = np.repeat(np.cumsum(sizes[0]) - sizes[0], sizes[1])
    ids = np.stack([numbers[shift + x.flatten().to_numpy()] for x in lists[1:]])
    at, new_pair = _distinct(np.zeros(len(shift), np.int32), ids)
    counts = [pc.sum(table[c]).as_py() for c in COUNTS[:2]] + [int(new_pair.sum()), int((ids[2][at] > 0).sum())]
    return pa.table([table["batch_uid"].slice(0, 1), *([c] for c in counts)], ["batch_uid", *COUNTS])
