"""SimHash near-duplicates by covering locality-sensitive hashing.

Masks come from a linear code: bit ``i`` of a fingerprint gets a non-zero vector ``f(i)`` of
``radius + 1`` bits, and mask ``v`` (one for each non-zero ``v``) keeps the bits with an odd
``f(i) . v``. Any ``radius`` differing bits put ``radius`` linear conditions on ``v``, so some
``v`` meets them all and its mask hides every difference: each pair within the radius collides
in at least one of the ``2^(radius+1) - 1`` tables, with certainty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import Forest, Scratch, tidy, with_field
from marginalia.llm.graph import components
from marginalia.operators.ranking import split_join

BITS = 64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Buckets with more fingerprints are cut by a second family of masks.
LARGE_BUCKET = 4096


def covering_masks(radius: int, family: int = 0) -> list[int]:
    """The masks of one family as unsigned integers; families place the bits differently."""
    codes = (1 << (radius + 1)) - 1
    place = [((i if family == 0 else i * 7 + i // codes) % codes) + 1 for i in range(BITS)]
    return [
        sum(1 << i for i in range(BITS) if bin(place[i] & v).count("1") % 2)
        for v in range(1, codes + 1)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def fingerprint_of(text: bytes, size: int = 3, block: int = 1 << 15) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned integer.

    A-Z become lower case, words are cut at ASCII white space, shingles repeat. A text with
    fewer words than ``size`` is one shingle, and one without words gives 0.
    """
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        return int.from_bytes(digest(joined, 42), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), block):
        hashes = b"".join(
            [digest(joined[s:e], 42) for s, e in zip(starts[at : at + block], stops[at : at + block])]
        )
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("_text"))
        prints = [fingerprint_of(t.as_py() or b"") for t in texts]
        signed = np.array(prints, np.uint64).view(np.int64)
        rest = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(n)) for n in rest), pa.array(signed)],
            names=[*rest, "fp"],
        )


def fingerprints(docs: DataFrame, *keys: Column) -> DataFrame:
    """``keys`` of every document with its fingerprint ``fp`` (a long with the same 64 bits)."""
    rows = docs.select(*keys, F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(tidy(_fingerprint_batches), with_field(rows.schema, ("fp", T.LongType())))


def _link_batches(radius: int) -> callable:
    """Links inside runs of equal ``(t, key)`` of a sorted stream; a forest of each run."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = [np.concatenate(p) for p in zip(held, cols)]
            t, key, fp = held
            last = np.flatnonzero((t != t[-1]) | (key != key[-1])) if len(t) else []
            done = int(last[-1]) + 1 if len(last) else 0
            yield found(*(x[:done] for x in held))
            held = [x[done:] for x in held]
        yield found(*held)

    def found(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        pairs: list[tuple[int, int]] = []
        n = len(t)
        if n > 1:
            same = (t[1:] == t[:-1]) & (key[1:] == key[:-1])
            run = np.concatenate(([0], np.cumsum(~same)))
            stop = np.searchsorted(run, run, side="right")
            forest = Forest(n)
            at, gap = np.flatnonzero(np.arange(n) + 1 < stop), 1
            while len(at):
                near = np.bitwise_count((fp[at] ^ fp[at + gap]).view(np.uint64)) <= radius
                if near.any():
                    pairs += forest.link(at[near], at[near] + gap)
                gap += 1
                at = at[at + gap < stop[at]]
        a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return links


def near_links(prints: DataFrame, scratch: Scratch, radius: int = 3, large: int = LARGE_BUCKET) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints within ``radius`` bits.

    ``prints`` has one row per distinct ``fp``. Each goes to every table of the first family.
    A bucket with more than ``large`` members is cut again by the second family, which covers
    every pair as well; what a bucket of both can hold is bounded by the bits left free.
    """
    first, second = covering_masks(radius), covering_masks(radius, 1)
    rows = prints.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in first])).alias("t", "key"),
    )
    crowded = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > large).select("t", "key")
    crowded = scratch.save(crowded)
    again = F.array(
        *[
            F.struct(
                (F.col("t") * len(second) + len(first) + i).alias("t"),
                # The first key fixes its own bits, so both masks together make the new bucket.
                F.xxhash64("key", F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("key"),
            )
            for i, m in enumerate(second)
        ]
    )
    once = rows.join(crowded, ["t", "key"], "left_anti").select("t", "key", "fp")
    twice = rows.join(crowded, ["t", "key"], "left_semi").select("fp", F.inline(again)).select("t", "key", "fp")
    dealt = once.unionByName(twice).select(F.col("t").cast("long").alias("t"), "key", "fp")
    return (
        dealt.repartition("t", "key")
        .sortWithinPartitions("t", "key", "fp")
        .mapInArrow(tidy(_link_batches(radius)), "a bigint, b bigint")
    )


def near_groups(prints: DataFrame, scratch: Scratch, radius: int = 3, large: int = LARGE_BUCKET) -> DataFrame:
    """``(fp, component)`` for every distinct ``fp`` that is linked to another one."""
    distinct = scratch.save(prints.select("fp").distinct())
    links = near_links(distinct, scratch, radius, large)
    return components(links, scratch).withColumnRenamed("node", "fp")


def simhash_components(docs: DataFrame, radius: int = 3, large: int = LARGE_BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    Rows whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest ``doc_id`` reachable. A null or empty text has fingerprint zero and links like any
    other. Rows that repeat a ``doc_id`` stay as rows; null ids are no candidates for the
    smallest id, and a component of null ids only has a null one. Other columns are ignored, and
    an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.save(fingerprints(docs, F.col("doc_id")))
    named = _smallest(prints, near_groups(prints, scratch, radius, large), F.min("doc_id"), scratch)
    return split_join(prints, named, ["fp"], "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least").alias("component_id"),
    )


def _smallest(prints: DataFrame, groups: DataFrame, least: Column, scratch: Scratch) -> DataFrame:
    """``(fp, least)``: an aggregate of each component's rows for each of its fingerprints."""
    per_print = prints.groupBy("fp").agg(least.alias("least"))
    rooted = scratch.save(per_print.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    per_root = rooted.groupBy("component").agg(F.min("least").alias("least"))
    return split_join(rooted.select("fp", "component"), per_root, ["component"]).select("fp", "least")


def one_per_group(docs: DataFrame, radius: int = 3, large: int = LARGE_BUCKET) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id.

    Null ids come after all others; among equal ids the smaller hash of the text stays, and of
    rows that are alike in both exactly one.
    """
    scratch = Scratch(docs.sparkSession)
    key = [F.col("doc_id").isNull().alias("_no_id"), F.col("doc_id"), F.xxhash64("text").alias("_text_hash")]
    prints = scratch.save(fingerprints(docs, *key))
    row = F.struct("_no_id", "doc_id", "_text_hash")
    groups = near_groups(prints, scratch, radius, large)
    stay = (
        _smallest(prints, groups, F.min(row), scratch)
        .select("least")
        .distinct()
        .select("least._no_id", F.coalesce("least.doc_id", F.lit(0)).alias("_id"), "least._text_hash")
    )
    keyed = docs.select(
        F.struct("*").alias("_row"),
        F.col("doc_id").isNull().alias("_no_id"),
        F.coalesce("doc_id", F.lit(0)).alias("_id"),
        F.xxhash64("text").alias("_text_hash"),
    )
    same = ["_id", "_no_id", "_text_hash"]
    order = Window.partitionBy(*same).orderBy(F.lit(0))
    return (
        keyed.join(stay, same, "left_semi")
        .withColumn("_nth", F.row_number().over(order))
        .where(F.col("_nth") == 1)
        .select("_row.*")
    )
