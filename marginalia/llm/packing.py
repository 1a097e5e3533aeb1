"""Packing documents into windows with lexically similar neighbours.

A document's ids fill whole windows by themselves as far as they go. What remains is packed in
shards: a shard has a BM25 index over the whole texts of its remainders, with frequencies and
lengths of all documents, and each window is filled by a seed and the unused neighbours that share
any id with it, best first; the last one is cut where the window is full and its rest waits for
another window. What a shard has left in the end goes
into windows whose lengths are powers of two. So no window has padding.

Shards hold documents next to each other in an order by smallest hashes, first of the ids of the
whole text and then of its pairs of ids, so copies and documents on the same matter tend to share
a shard. The closing id is left out there, as every document has it.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import Scratch, tidy

WINDOW = 1024
#: Remainders in one index.
SHARD = 2048
#: Usual BM25 parameters.
K1, B = 1.2, 0.75
#: Ids in more than this share of a shard are kept as rows of a matrix.
DENSE = 1 / 8
#: Neighbours that are sorted first.
FEW = 64
#: Texts with other characters, or with what may be a special token, take the slower way.
UNUSUAL, SPECIAL = re.compile(r"[^\x00-\u024f]"), "<|"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _place(file: str) -> str:
    import public_tokenizers

    return file if "/" in file else public_tokenizers.path(file)


@lru_cache(maxsize=2)
def tokenizer_of(name: str):
    """The tokenizer of a vocabulary file; loaded only where a text asks for it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_place(name))


@lru_cache(maxsize=2)
def _fast(ranks: str):
    """The fast twin of a tokenizer, from its vocabulary as ranks."""
    import public_tokenizers
    import tiktoken

    with open(_place(ranks), "rb") as lines:
        order = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=order, special_tokens={})


def encode(text: str, name: str, ranks: str | None) -> np.ndarray:
    """Ids of a whole text.

    The same vocabulary as ranks gives the same ids four times as fast. Where the two could
    differ, on special tokens and on characters that the libraries may class by different
    editions of Unicode, the tokenizer itself is asked.
    """
    if ranks is None or SPECIAL in text or not text.isascii() and UNUSUAL.search(text):
        return np.array(tokenizer_of(name).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(_fast(ranks).encode_ordinary(text), np.uint32)


@lru_cache(maxsize=2)
def _hashes(size: int) -> np.ndarray:
    """A hash of every id below ``size``."""
    x = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return (x >> np.uint64(32)).astype(np.uint32)


def similarity_key(ids: np.ndarray, distinct: np.ndarray) -> int:
    """Sort key of a text by its ids without the closing one; 0 for an empty text.

    Two smallest hashes of its ids, then two of its pairs of neighbours, 16 bits of each: the more
    of them two texts share from the left, the more alike they are.
    """
    if not len(ids):
        return 0
    # The size does not change an id's hash; times an odd number it is in another order.
    table = _hashes(1 << max(16, int(distinct[-1]).bit_length()))
    once, all_ = table[distinct], table[ids]
    least = [once.min(), (once * np.uint32(0x9E3779B1)).min()]
    if len(ids) > 1:
        pairs = all_[:-1] * np.uint32(0x85EBCA6B) + all_[1:]
        least += [pairs.min(), (pairs * np.uint32(0x9E3779B1)).min()]
    key = 0
    for x in (least + least)[:4]:
        # The low bits: those at the top are nearly all 0 in a minimum.
        key = key << 16 | int(x) & 0xFFFF
    return key - (1 << 63)


def _texts(column: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, list[str]]]:
    """Slices of a text column of bounded size, as ``(first, texts)``."""
    first, held, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size > limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _described(text: str, name: str, ranks: str | None, window: int) -> tuple[tuple, np.ndarray]:
    """Number of ids, crc32 of each whole window, the remaining ids, what the whole windows hold
    (distinct ids, then how often each occurs) and a sort key; and the distinct ids of the text."""
    own = encode(text, name, ranks)
    ids = np.empty(len(own) + 1, np.uint32)
    ids[:-1], ids[-1] = own, 0
    whole = len(ids) // window * window
    distinct, head = distinct_of(own), b""
    if whole:
        head = np.concatenate(np.unique(own[:whole], return_counts=True)).astype("<u4").tobytes()
    crcs = [zlib.crc32(ids[i : i + window]) for i in range(0, whole, window)]
    return (len(ids), crcs, ids[whole:].tobytes(), head, similarity_key(own, distinct)), distinct


def distinct_of(ids: np.ndarray) -> np.ndarray:
    """The distinct ids in order."""
    if not len(ids):
        return ids
    ordered = np.sort(ids)
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))]


def _encoded(name: str, ranks: str | None, window: int):
    """A row of ``_described`` for each document; at the end of a task one row without a count, that
    tells in how many of its documents each id is (ids in ``tail``, counts in ``head``)."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for first, texts in _texts(batch.column(1)):
                rows, known = [], {}
                for text in texts:
                    # Repeated texts of a slice are encoded once.
                    if text not in known:
                        known[text] = _described(text, name, ranks, window)
                    row, distinct = known[text]
                    if len(distinct) and distinct[-1] >= len(seen):
                        seen = np.append(seen, np.zeros(max(int(distinct[-1]) + 1 - len(seen), len(seen)), np.int64))
                    seen[distinct] += 1
                    rows.append(row)
                yield _encoded_rows(batch.column(0).slice(first, len(texts)), rows)
        ids = np.flatnonzero(seen)
        yield _encoded_rows(pa.array([None], pa.int64()), [(None, [], ids.astype("<u4").tobytes(), seen[ids].astype("<i8").tobytes(), 0)])

    return encoded


def _encoded_rows(doc_id: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays([doc_id, *columns], names=["doc_id", "count", "crcs", "tail", "head", "near"])


def bag_of(tail: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of a whole text and how often each occurs, without the closing id."""
    if not len(head):
        return np.unique(tail[:-1], return_counts=True)
    ids, times = head.reshape(2, -1)
    ids, at = np.unique(np.concatenate([ids, tail[:-1]]), return_inverse=True)
    return ids, np.bincount(at, np.concatenate([times, np.ones(max(len(tail) - 1, 0))])).astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents each id is, from the counts of single tasks."""
    seen = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for tail, head in zip(batch.column(0), batch.column(1)):
            ids, times = np.frombuffer(tail.as_py(), "<u4"), np.frombuffer(head.as_py(), "<i8")
            if len(ids) and ids[-1] >= len(seen):
                seen = np.append(seen, np.zeros(max(int(ids[-1]) + 1 - len(seen), len(seen)), np.int64))
            seen[ids] += times
    ids = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seen[ids], pa.int64())], names=["id", "df"])


class Corpus(NamedTuple):
    """Number and mean length of all documents; the ids in them, sorted, and in how many each is."""

    n: int
    mean: float
    ids: np.ndarray
    df: np.ndarray


def corpus_of(bags: list[tuple[np.ndarray, np.ndarray]]) -> Corpus:
    ids, df = np.unique(np.concatenate([ids for ids, _ in bags]), return_counts=True)
    return Corpus(len(bags), sum(int(t.sum()) for _, t in bags) / len(bags), ids, df)


class Index:
    """BM25 index of the documents of one shard, given as distinct ids and how often each occurs."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], corpus: Corpus):
        n = len(bags)
        sizes = np.array([len(ids) for ids, _ in bags])
        doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
        terms, term = np.unique(np.concatenate([ids for ids, _ in bags]), return_inverse=True)
        tf = np.concatenate([t for _, t in bags]).astype(np.float32)
        df = corpus.df[np.searchsorted(corpus.ids, terms)]
        idf = np.log1p((corpus.n - df + 0.5) / (df + 0.5)).astype(np.float32)
        lengths = np.array([t.sum() for _, t in bags], np.float32)
        damp = K1 * (1 - B + B * lengths / np.float32(max(corpus.mean, 1.0)))
        weight = idf[term] * tf * np.float32(K1 + 1) / (tf + damp[doc])
        here = np.bincount(term, minlength=len(terms))
        # Scores add up alike either way: ids of many documents by rows, the others by postings.
        row = np.where(here > n * DENSE, np.cumsum(here > n * DENSE) - 1, -1)
        often = row[term] >= 0
        self.rows = np.zeros((int(row.max(initial=-1)) + 1, n), np.float32)
        self.rows[row[term[often]], doc[often]] = weight[often]
        order = np.argsort(term[~often], kind="stable")
        self.doc, self.weight = doc[~often][order], weight[~often][order]
        self.last = np.cumsum(np.where(row < 0, here, 0))
        self.first = self.last - np.where(row < 0, here, 0)
        self.row = row
        self.own = np.split(term, np.cumsum(sizes)[:-1])

    def near(self, seed: int, free: np.ndarray) -> Iterator[int]:
        """All free documents that share ids with the seed, best first."""
        own = self.own[seed]
        row = self.row[own]
        score = self.rows[row[row >= 0]].sum(0)
        own = own[row < 0]
        if len(own):
            size = self.last[own] - self.first[own]
            at = np.repeat(self.last[own] - np.cumsum(size), size) + np.arange(size.sum())
            score = score + np.bincount(self.doc[at], self.weight[at], len(free))
        some = np.flatnonzero(free & (score > 0))
        # Most windows are full after a few: the others are sorted where they are asked for.
        most = min(FEW, len(some))
        parts = np.split(some[np.argpartition(-score[some], most - 1)], [most]) if most else []
        for part in parts:
            yield from part[np.argsort(-score[part], kind="stable")].tolist()


def packed(
    tails: list[np.ndarray],
    window: int = WINDOW,
    bags: list[tuple[np.ndarray, np.ndarray]] | None = None,
    corpus: Corpus | None = None,
) -> Iterator[list[tuple[int, int, int]]]:
    """Windows over the remainders as lists of ``(remainder, start, length)``.

    ``bags`` has what the whole text of each remainder holds, and ``corpus`` the figures of all
    documents; without them the remainders count as whole texts, and as all there are.
    """
    if bags is None:
        bags = [np.unique(t, return_counts=True) for t in tails]
    at = np.zeros(len(tails), np.int64)
    left = np.array([len(t) for t in tails], np.int64)
    index = Index(bags, corpus or corpus_of(bags))
    free = left > 0
    room_left = int(left.sum())
    order = np.argsort(-left, kind="stable")
    place = 0

    def take(i: int, most: int) -> tuple[int, int, int]:
        n = min(int(left[i]), most)
        piece = (int(i), int(at[i]), n)
        at[i] += n
        left[i] -= n
        free[i] = left[i] > 0
        return piece

    def fill(size: int) -> list[tuple[int, int, int]]:
        nonlocal place
        pieces, room, waiting = [], size, iter(())
        while room:
            i = next(waiting, None)
            if i is None:
                while not free[order[place]]:
                    place += 1
                seed = int(order[place])
                pieces.append(take(seed, room))
                room -= pieces[-1][2]
                waiting = index.near(seed, free) if room else waiting
            elif free[i]:
                pieces.append(take(i, room))
                room -= pieces[-1][2]
        return pieces

    while room_left >= window:
        yield fill(window)
        room_left -= window
    while room_left:
        size = 1 << (room_left.bit_length() - 1)
        yield fill(size)
        room_left -= size


def _packed(window: int, shard: int, corpus: Corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        held: list[tuple] = []

        def pieces() -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            for doc, count, crcs, *_ in held:
                for i, crc in enumerate(crcs):
                    out.append((doc, i * window, window, crc, count, sequence, 0))
                    sequence += 1
            some = [(h[0], h[1], len(h[2]) * window, np.frombuffer(h[3], "<u4")) for h in held if len(h[3])]
            if some:
                heads = [np.frombuffer(h[4], "<u4") for h in held if len(h[3])]
                bags = [bag_of(h[3], head) for h, head in zip(some, heads)]
                for one in packed([h[3] for h in some], window, bags, corpus):
                    offset = 0
                    for i, start, length in one:
                        doc, count, base, ids = some[i]
                        out.append((doc, base + start, length, zlib.crc32(ids[start : start + length]), count, sequence, offset))
                        offset += length
                    sequence += 1
            held.clear()
            names = [f.split()[0] for f in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for row in zip(*cols):
                held.append(row)
                if len(held) >= shard:
                    yield pieces()
        if held:
            yield pieces()

    return run


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken",
    window: int = WINDOW,
    shard: int = SHARD,
) -> DataFrame:
    """Pieces of all documents of ``docs`` (``doc_id``, ``text``) in windows of ``window`` ids.

    A document is the ids of its text followed by id 0; a null text is empty. Gives ``doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset`` for every piece: each id is in
    exactly one piece, windows are full or, for what a shard has left, a power of two long.
    ``tokenizer`` is a file name of the installed vocabularies, or a path, and ``ranks`` the same
    vocabulary as ranks, if there is one. Repeated rows and null
    ids are packed like any other rows. An empty table gives an empty result; other columns are
    ignored.
    """
    scratch = Scratch(docs.sparkSession)
    made = scratch.save(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            tidy(_encoded(tokenizer, ranks, window)),
            "doc_id bigint, count bigint, crcs array<bigint>, tail binary, head binary, near bigint",
        )
    )
    rows = made.where(F.col("count").isNotNull())
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("ids")).first()
    shards = max(1, -(-total["n"] // shard))
    # One row for each id of the vocabulary at most.
    counted = made.where(F.col("count").isNull()).select("tail", "head").mapInArrow(tidy(_summed), "id bigint, df bigint")
    known = counted.groupBy("id").agg(F.sum("df").alias("df")).toArrow().sort_by("id")
    corpus = Corpus(
        total["n"], (total["ids"] - total["n"]) / max(total["n"], 1), *(known.column(c).to_numpy() for c in ("id", "df"))
    )
    # Rows with equal keys and ids, copies of one row, are dealt by their place in the table.
    return (
        rows.withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(shards, "near", F.xxhash64("doc_id"), "row")
        .sortWithinPartitions("near", "doc_id", "row")
        .drop("near", "row")
        .mapInArrow(tidy(_packed(window, shard, corpus)), PIECES)
    )
