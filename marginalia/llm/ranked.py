"""Ranked lexical search by norm buckets, with exact integer scores.

A document is the vector of its impacts on the terms that are asked for, an item the vector of the
weights of its terms; both are scaled by the root of the weight, so that frequent terms add little
length. Document vectors are ordered by length, longest first, and cut into buckets of neighbours.
With the tenth best score an item has so far:

* a bucket whose longest vector cannot reach it (Cauchy-Schwarz) is pruned; the same bound is a
  filter on the length when the table, which is written in that order, is read;
* inside a bucket the item's heaviest coordinates decide. A vector that reaches the score has, on
  such a coordinate, a value in an interval around the item's; and with what the coordinates add
  up to so far and the length that is left on both sides, the score has to be in reach;
* what survives is scored again in whole numbers, exactly as defined.

The longest vectors are searched first, in tasks of their own, and the scores found there are
where all other tasks start. Bounds are on doubles with slack, so they only ever keep more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import Scratch, tidy
from marginalia.operators.ranking import global_positions

#: Document vectors in a bucket, and how many of the longest are searched first.
BUCKET, HEAD = 2048, 1 << 14
#: Bytes of item texts, and items, that one scan of the documents serves.
ITEM_BYTES, ITEMS = 8 << 20, 4096
#: Heaviest coordinates of an item whose intervals are looked at.
FOCUS = 6
SLACK = 1e-6
LAST_ID = (1 << 63) - 1
#: A-Z to lower case; ASCII that is neither letter nor digit to blanks.
FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a whole UTF-8 text in order, repeats included."""
    return text.translate(FOLDED).split()


class Items(NamedTuple):
    """One block of items: their terms as places in ``words``, an item after the other."""

    row: np.ndarray
    first: np.ndarray
    term: np.ndarray
    words: dict[bytes, int]


def items_of(rows: list[int], texts: list[bytes | None]) -> Items:
    words: dict[bytes, int] = {}
    terms = [sorted({words.setdefault(w, len(words)) for w in terms_of(t or b"")}) for t in texts]
    first = np.cumsum([0, *map(len, terms)])
    return Items(np.array(rows, np.int64), first, np.array([t for ts in terms for t in ts], np.int64), words)


def _vectors(words: dict[bytes, int]):
    """Number of terms of each document, and how often it has each of ``words``."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.get
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                size, terms, times = [], [], []
                for text in part.column(1):
                    own = terms_of(text.as_py() or b"")
                    size.append(len(own))
                    found = np.array([w for w in map(known, own) if w is not None], np.int32)
                    term, tf = np.unique(found, return_counts=True)
                    terms.append(term)
                    times.append(tf)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(size, pa.int64()),
                        pa.array(terms, pa.list_(pa.int32())),
                        pa.array(times, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "terms", "tf"],
                )

    return vectors


class Corpus(NamedTuple):
    """Documents with a term, all their terms, and the weight of each word asked for."""

    n: int
    total: int
    weight: np.ndarray


def weight_of(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, size: np.ndarray, corpus: Corpus) -> np.ndarray:
    """Whole-number impact of a term that occurs ``tf`` times in a document of ``size`` terms."""
    m = 100 - 90 + (90 * size * corpus.n) // corpus.total
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and joined values of a list column."""
    return (
        column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
        column.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
    )


def _measured(corpus: Corpus):
    """Impacts in place of counts, and the length of each vector."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).to_numpy(zero_copy_only=False)
            count, term = _flat(batch.column(2))
            _, tf = _flat(batch.column(3))
            value = impacts(tf, np.repeat(size, count), corpus)
            square = corpus.weight[term] * value.astype(np.float64) ** 2
            length = np.sqrt(np.bincount(np.repeat(np.arange(len(count)), count), square, len(count)))
            ends = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.ListArray.from_arrays(ends, pa.array(value)), pa.array(length)],
                names=["doc_id", "terms", "impact", "length"],
            )

    return measured


class Bucket:
    """Vectors of neighbouring length with the postings of each coordinate."""

    def __init__(self, ids: np.ndarray, count: np.ndarray, term: np.ndarray, value: np.ndarray, length: np.ndarray, corpus: Corpus):
        self.ids, self.length = ids, length
        doc = np.repeat(np.arange(len(ids)), count)
        order = np.argsort(term, kind="stable")
        self.term, self.doc, self.value = term[order], doc[order], value[order]
        # Coordinates of the vector scaled to length one.
        root = np.sqrt(corpus.weight[self.term])
        self.share = root * self.value / np.maximum(length[self.doc], 1e-300)

    def posting(self, term: int) -> slice:
        return slice(*np.searchsorted(self.term, [term, term + 1]).tolist())

    def survivors(self, terms: np.ndarray, shares: np.ndarray, size: float, least: float) -> np.ndarray:
        """Vectors that can score ``least`` with the item of ``terms``, heaviest coordinate first.

        ``shares`` are the item's coordinates scaled to length one and ``size`` is its length.
        """
        n = len(self.ids)
        need = least * (1 - SLACK) / (size * np.maximum(self.length, 1e-300))
        fit = need <= 1.0
        done, seen = np.zeros(n), np.zeros(n)
        left = 1.0
        for term, q in zip(terms[:FOCUS].tolist(), shares[:FOCUS].tolist()):
            at = self.posting(term)
            here = np.zeros(n)
            here[self.doc[at]] = self.share[at]
            # An angle within arccos(need) of the item's leaves this interval on one coordinate.
            cosine = np.clip(need, 0.0, 1.0)
            wide = np.sqrt(max(0.0, 1 - q * q) * (1 - cosine**2)) + SLACK
            fit &= (here >= q * cosine - wide) & ((cosine <= q) | (here <= q * cosine + wide))
            done += q * here
            seen += here**2
            left -= q * q
            fit &= done + math.sqrt(max(left, 0.0)) * np.sqrt(np.maximum(1 - seen, 0.0)) + SLACK >= need
        return np.flatnonzero(fit)

    def scores(self, terms: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores of some vectors for one item."""
        out = np.zeros(len(self.ids), np.int64)
        wanted = np.zeros(len(self.ids), bool)
        wanted[rows] = True
        for term, weight in zip(terms.tolist(), weights.tolist()):
            at = self.posting(term)
            doc, value = self.doc[at], self.value[at]
            some = wanted[doc]
            out[doc[some]] += weight * value[some]
        return out[rows]


class Asked:
    """The items of a block with their running best scores in one task."""

    def __init__(self, items: Items, corpus: Corpus, k: int, floors: np.ndarray):
        self.k, self.items = k, items
        self.terms, self.weights, self.shares, self.sizes = [], [], [], []
        for a, b in zip(items.first, items.first[1:]):
            term = items.term[a:b]
            weight = corpus.weight[term]
            term, weight = term[weight > 0], weight[weight > 0]
            order = np.argsort(-weight, kind="stable")
            size = math.sqrt(float(weight.sum()))
            self.terms.append(term[order])
            self.weights.append(weight[order])
            self.shares.append(np.sqrt(weight[order]) / max(size, 1e-300))
            self.sizes.append(size)
        self.floor = floors.astype(np.int64).copy()
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.terms]

    def search(self, bucket: Bucket) -> None:
        longest = float(bucket.length.max(initial=0.0))
        for i, terms in enumerate(self.terms):
            if not len(terms) or self.sizes[i] * longest * (1 + SLACK) < self.floor[i]:
                continue
            rows = bucket.survivors(terms, self.shares[i], self.sizes[i], float(self.floor[i]))
            if not len(rows):
                continue
            score = bucket.scores(terms, self.weights[i], rows)
            good = (score > 0) & (score >= self.floor[i])
            if good.any():
                self._add(i, score[good], bucket.ids[rows[good]])

    def _add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = (np.concatenate(x) for x in zip(self.best[i], (score, ids)))
        order = np.lexsort((ids, -score))[: self.k]
        self.best[i] = score[order], ids[order]
        if len(order) == self.k:
            self.floor[i] = max(self.floor[i], score[order[-1]])


def _searched(items: Items, corpus: Corpus, k: int, floors: np.ndarray, bucket: int):
    """The best of a stream of vectors for every item; the longest vectors come first."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(items, corpus, k, floors)
        for batch in batches:
            for at in range(0, batch.num_rows, bucket):
                part = batch.slice(at, bucket)
                count, term = _flat(part.column(1))
                asked.search(
                    Bucket(
                        part.column(0).to_numpy(zero_copy_only=False), count, term, _flat(part.column(2))[1],
                        part.column(3).to_numpy(zero_copy_only=False), corpus,
                    )
                )
        row = np.repeat(items.row, [len(score) for score, _ in asked.best])
        score, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*asked.best, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids), pa.array(score)], names=["item", "doc_id", "score"])

    return searched


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, items: Items, scratch: Scratch, k: int, bucket: int, head: int) -> DataFrame | None:
    """``item, doc_id, score, rank`` for one block of items; none if no document has a term."""
    counted = scratch.save(
        docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
            tidy(_vectors(items.words)), "doc_id bigint, n bigint, terms array<int>, tf array<bigint>"
        )
    )
    size = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.sum("n").alias("total")).first()
    if not size["n"]:
        return None
    # One row for each word of the block at most.
    weight = np.zeros(max(len(items.words), 1), np.int64)
    for row in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        weight[row["term"]] = weight_of(size["n"], row["df"])
    corpus = Corpus(size["n"], size["total"], weight)
    schema = "doc_id bigint, terms array<int>, impact array<bigint>, length double"
    vectors = counted.where(F.size("terms") > 0).mapInArrow(tidy(_measured(corpus)), schema)
    # Longest first over all partitions, and inside each.
    vectors = scratch.save(vectors.repartitionByRange(F.desc("length"), F.col("doc_id")).sortWithinPartitions(F.desc("length"), "doc_id"))
    items = items._replace(words={})

    def search(rows: DataFrame, floors: np.ndarray) -> DataFrame:
        return rows.mapInArrow(tidy(_searched(items, corpus, k, floors, bucket)), "item bigint, doc_id bigint, score bigint")

    # The length that about ``head`` vectors have at least, from a histogram of bounded size.
    step = F.floor(F.log2(F.col("length") + 1) * 16).cast("int")
    reached, cut = 0, None
    for row in sorted(vectors.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("length").alias("low")).collect(), reverse=True):
        reached, cut = reached + row["n"], row["low"]
        if reached >= head:
            break
    none = np.zeros(len(items.row), np.int64)
    if cut is None:
        return None
    first = scratch.save(_best(search(vectors.where(F.col("length") >= cut), none), k))
    floors, place = none.copy(), {int(r): i for i, r in enumerate(items.row)}
    for row in first.where(F.col("rank") == k).select("item", "score").collect():
        floors[place[row["item"]]] = row["score"]
    sizes = np.array(Asked(items, corpus, k, none).sizes)
    # No shorter vector reaches any item's score.
    least = float(np.min(np.where(sizes > 0, floors / np.maximum(sizes, 1e-300), np.inf), initial=np.inf)) * (1 - SLACK)
    rest = vectors.where((F.col("length") < cut) & (F.col("length") >= least))
    return _best(first.drop("rank").unionByName(search(rest, floors)), k)


def ranked_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    bucket: int = BUCKET,
    head: int = HEAD,
    item_bytes: int = ITEM_BYTES,
    max_items: int = ITEMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items`` its ``k`` best rows of ``docs``.

    ``items`` has ``item_id`` and ``text``, ``docs`` has ``doc_id`` and ``text``. Terms are runs of
    ASCII letters, digits and all characters beyond ASCII, with A-Z in lower case. Scores are sums of
    whole numbers; equal ones ascend by ``doc_id``, a null id counts as larger than all others, and
    only scores above 0 are listed. Null and empty texts have no terms: as documents they are never
    found and not counted, as items they get no rows. Rows that repeat an id are rows of their own,
    on both sides. Items are served in blocks of at most ``max_items`` rows and about ``item_bytes`` bytes of
    text (a longer text is a block of its own), each with a scan of the documents; that bounds
    what the driver and a task hold. Other columns are ignored and empty tables give an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = items.select(
        "item_id", F.col("text").cast("binary").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")
    )
    # Each item weighs its bytes and a share of the block, so both bounds are one.
    rows = rows.withColumn("bytes", F.greatest("bytes", F.lit(-(-item_bytes // max_items)).cast("long")))
    rows = global_positions(scratch.save(rows), ["item_id", "text"], weight="bytes", name="at")
    rows = scratch.save(
        rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "text", F.expr(f"at div {item_bytes}").alias("block"))
    )
    found = None
    for block in sorted(r["block"] for r in rows.select("block").distinct().collect()):
        held = rows.where(F.col("block") == block).select("item", "text").toArrow()
        made = _block(docs, items_of(held.column(0).to_pylist(), held.column(1).to_pylist()), scratch, k, bucket, head)
        if made is not None:
            made = scratch.save(made)
            found = made if found is None else found.unionByName(made)
    if found is None:
        found = spark.createDataFrame([], "item bigint, doc_id bigint, score bigint, rank int")
    return found.join(rows.select("item", "item_id"), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(LAST_ID)).alias("doc_id"), "score"
    )
