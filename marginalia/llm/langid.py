"""Language identification with language-bitmask n-gram filters.

Every language has a Bloom filter over its characteristic letter n-grams. The filters share one
table and its hash functions, bit-sliced: a slot holds one bit per language, so that the slots of
an n-gram, joined by AND, give all languages that contain it in one look. A text's n-grams are
looked up, the bits are counted per language, and each count is corrected for the share of
absent n-grams that its filter takes for present ones. The largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import Scratch, crc_of_id, drawn, tidy

#: Letters in an n-gram, slots of the table (a power of two) and hash functions.
GRAM, SLOTS, HASHES = 3, 1 << 19, 2
#: Documents per language that the filters are made from.
FIT_DOCS = 4000
#: An n-gram belongs to a language that has it at this rate, and at this share of the best rate.
RATE, SHARE = 1e-5, 0.5
#: Characters that are looked at in one piece.
PIECE = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_hashes(text: str, gram: int = GRAM) -> Iterator[np.ndarray]:
    """64-bit hashes of all letter n-grams of a text, in pieces of bounded size.

    Letters are lower case; whatever lies between words is one blank, as are both ends.
    """
    if not text:
        return
    letters = _letters()
    factors = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
    held = np.array([32], np.uint32)
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(letters[codes], codes, np.uint32(32))
        codes = np.concatenate([held, codes])
        blank = codes == 32
        codes = codes[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
        if at + PIECE >= len(text) and codes[-1] != 32:
            codes = np.append(codes, np.uint32(32))
        if len(codes) >= gram:
            wide = codes.astype(np.uint64)
            n = len(wide) - gram + 1
            h = np.zeros(n, np.uint64)
            for i in range(gram):
                h = (h ^ wide[i : i + n]) * factors[i % 3]
                h ^= h >> np.uint64(29)
            yield h
        held = codes[-(gram - 1) :] if gram > 1 else codes[:0]


def _positions(h: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    out = []
    for i in range(hashes):
        out.append((h & np.uint64(slots - 1)).astype(np.int64))
        h = (h ^ (h >> np.uint64(17))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return out


def _counted(gram: int):
    """Counts of n-gram hashes per language, summed up within each batch."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                grams = [h for i, x in enumerate(langs) if x == lang for h in gram_hashes(batch.column(1)[i].as_py(), gram)]
                if grams:
                    seen, n = np.unique(np.concatenate(grams), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(seen)), pa.array(seen.view(np.int64)), pa.array(n)],
                        names=["lang", "gram", "n"],
                    )

    return counted


def fit_filters(
    labelled: DataFrame,
    scratch: Scratch,
    docs_per_lang: int = FIT_DOCS,
    gram: int = GRAM,
    slots: int = SLOTS,
    hashes: int = HASHES,
) -> tuple[list[str], np.ndarray]:
    """Languages and the bit-sliced table ``(slots, words)`` from rows ``lang, text``.

    About ``docs_per_lang`` whole documents of each language are used, drawn by a hash of the row. N-gram counts are
    aggregated by Spark; what reaches the driver is one row per filled slot, ``slots`` at most.
    """
    per_lang = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per_lang)
    if not langs:
        return [], np.zeros((slots, 1), np.uint64)
    keep = F.lit(1.0)
    for lang in langs:
        keep = F.when(F.col("lang") == lang, min(1.0, docs_per_lang / per_lang[lang])).otherwise(keep)
    some = labelled.where(drawn(keep, *labelled.columns))
    counts = scratch.save(
        some.select("lang", "text")
        .where(F.col("text").isNotNull())
        .mapInArrow(tidy(_counted(gram)), "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    place, rate = F.lit(0), F.lit(0.0)
    for i, lang in enumerate(langs):
        place = F.when(F.col("lang") == lang, i).otherwise(place)
        rate = F.when(F.col("lang") == lang, F.col("n") / F.lit(float(totals.get(lang, 1)))).otherwise(rate)
    rated = counts.select("gram", place.alias("lang"), rate.alias("rate")).where(F.col("rate") >= RATE)
    best = rated.groupBy("gram").agg(
        F.max("rate").alias("most"), F.collect_list(F.struct("lang", "rate")).alias("of")
    )  # at most one entry per language
    member = best.select("gram", F.inline("of"), "most").where(F.col("rate") >= SHARE * F.col("most"))
    words = -(-len(langs) // 64)
    masks = [
        F.coalesce(F.bit_or(F.when(F.col("lang").between(64 * w, 64 * w + 63), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("lang") - 64 * w).cast("int")))), F.lit(0))
        for w in range(words)
    ]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = _positions(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), slots, hashes)
            lang = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(spots)), pa.array(np.tile(lang, hashes))], names=["slot", "lang"]
            )

    filled = (
        member.select("gram", "lang")
        .mapInArrow(tidy(placed), "slot bigint, lang int")
        .groupBy("slot")
        .agg(*[m.cast("long").alias(f"m{i}") for i, m in enumerate(masks)])
        .toArrow()
    )
    table = np.zeros((slots, words), np.uint64)
    at = filled.column("slot").to_numpy()
    for w in range(words):
        table[at, w] = filled.column(f"m{w}").to_numpy().astype(np.int64).view(np.uint64)
    return langs, table


def _predicted(langs: list[str], table, gram: int, hashes: int):
    """Language and score of each text of a batch."""
    slots, words = table.value.shape
    count = len(langs)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        filled = np.array([((bits[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(count)])
        chance = filled**hashes
        for batch in batches:
            lang_out, score_out = [], []
            for value in batch.column(batch.schema.get_field_index("_text")):
                hits, total = np.zeros(count), 0
                for h in gram_hashes(value.as_py() or "", gram):
                    spots = _positions(h, slots, hashes)
                    total += len(h)
                    for w in range(words):
                        both = bits[spots[0], w]
                        for s in spots[1:]:
                            both = both & bits[s, w]
                        for i in range(64 * w, min(count, 64 * w + 64)):
                            hits[i] += np.count_nonzero(both & np.uint64(1 << (i % 64)))
                if not total or not count:
                    lang_out.append(UNKNOWN)
                    score_out.append(0.0)
                    continue
                true = np.maximum(hits - total * chance, 0.0) / np.maximum(1.0 - chance, 1e-9)
                best = int(true.argmax())
                lang_out.append(langs[best])
                score_out.append(float(true[best] / true.sum()) if true.sum() > 0 else 1.0 / count)
            rest = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in rest), pa.array(lang_out), pa.array(score_out)],
                names=[*rest, "lang_pred", "score"],
            )

    return predicted


def held_out_column() -> Column:
    return crc_of_id() % 3 == 1


def predict_languages(docs: DataFrame, docs_per_lang: int = FIT_DOCS, gram: int = GRAM, slots: int = SLOTS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (``doc_id, text, lang``).

    Learns from rows that are not held out (crc32 of the id modulo 3 is not 1; a null id counts
    as the empty text) and have a language and a text. A text that is null or has no letter gets
    ``und`` with score 0, and so does everything if there is nothing to learn from. Equal counts
    go to the first language by code. A text none of whose n-grams is known gets the first language with an
    even score. Repeated rows are judged alike, other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out_column()).select("lang", "text", "doc_id")
    langs, table = fit_filters(labelled, scratch, docs_per_lang, gram, slots)
    shared = spark.sparkContext.broadcast(table)
    return docs.select("doc_id", held_out_column().alias("held_out"), F.col("text").alias("_text")).mapInArrow(
        tidy(_predicted(langs, shared, gram, HASHES)), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double"
    )
