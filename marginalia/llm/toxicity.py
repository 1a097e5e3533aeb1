"""Toxicity categories by a chain of linear classifiers.

Cues are letter 5-grams and 7-grams that go with the label, found by a chi-squared test over
document counts. Labels tell only whether a document is toxic, so its earlier categories are the
kinds of toxicity that the labelled documents show: those that are toxic are parted in two by which cues
occur together in them.

The chain predicts the categories one after the other; each model sees the cues of a text and the
probabilities of all earlier categories. While fitting, those probabilities come from models that
did not see the row (out of fold), nor the cues that it would have suggested: each fold's models use cues chosen
without the fold. So a later model learns how far they can be trusted. Copies of a text share a fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import Scratch, crc_of_id, sampled, sigmoid, tidy
from marginalia.llm.langid import gram_hashes

#: Labelled documents used for counts and models (about; drawn evenly), and cues kept.
FIT_DOCS, CUES = 12_000, 800
GRAMS, BUCKETS = (5, 7), 1 << 22
FOLDS = 3
#: A cue is in at least this many toxic documents.
LEAST = 4


def _buckets(text: str | None) -> Iterator[np.ndarray]:
    for gram in GRAMS:
        for h in gram_hashes(text or "", gram):
            yield (((h >> np.uint64(7)) + np.uint64(gram)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of documents with each n-gram, per label and fold, summed up within each batch."""
    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        folds = batch.column(2).to_numpy(zero_copy_only=False)
        for label, fold in sorted(set(zip(labels.tolist(), folds.tolist()))):
            per_doc = []
            for i in np.flatnonzero((labels == label) & (folds == fold)):
                parts = [np.unique(b) for b in _buckets(batch.column(1)[int(i)].as_py())]
                if parts:
                    per_doc.append(np.unique(np.concatenate(parts)))
            if per_doc:
                seen, n = np.unique(np.concatenate(per_doc), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(seen), label, np.int32)), pa.array(np.full(len(seen), fold, np.int64)), pa.array(seen), pa.array(n)],
                    names=["label", "fold", "gram", "n"],
                )


def find_cues(labelled: DataFrame, cues: int = CUES, folds: int = FOLDS) -> list[np.ndarray]:
    """Buckets of the ``cues`` n-grams that most go with label 1, from rows ``label, text, place``.

    First those of all rows, then for each fold (``place`` modulo ``folds``) those of the rows outside it.
    The texts are read once.
    """
    rows = labelled.select("label", "text", F.pmod("place", F.lit(folds)).alias("fold"))
    totals = {(r["label"], r["fold"]): r["n"] for r in rows.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    label, fold, n = F.col("label"), F.col("fold"), F.col("n")
    # The fold that each set leaves out.
    left_out = [None, *range(folds)]

    def counted(value: int, k: int | None) -> Column:
        return F.sum(F.when((label == value) if k is None else (label == value) & (fold != k), n).otherwise(0))

    scratch = Scratch(labelled.sparkSession)
    counts = scratch.save(
        rows.mapInArrow(tidy(_document_counts), "label int, fold bigint, gram bigint, n bigint")
        .groupBy("gram")
        .agg(*[counted(v, k).alias(f"{name}{i}") for i, k in enumerate(left_out) for v, name in ((1, "one"), (0, "none"))])
        .where(F.col("one0") >= LEAST)
    )
    sets = []
    for i, k in enumerate(left_out):
        bad, fine = (sum(m for (v, f), m in totals.items() if v == value and f != k) for value in (1, 0))
        if not bad or not fine:
            sets.append(np.zeros(0, np.int64))
            continue
        a, b = F.col(f"one{i}").cast("double"), F.col(f"none{i}").cast("double")
        every = float(bad + fine)
        chi = every * F.pow(a * (fine - b) - b * (bad - a), 2) / ((a + b) * (every - a - b + 1) * bad * fine)
        best = counts.where((a >= LEAST) & (a / bad > 2 * b / fine)).orderBy(F.desc(chi), "gram").limit(cues)
        sets.append(np.sort(np.array([r["gram"] for r in best.select("gram").collect()], np.int64)))
    scratch.drop(counts)
    return sets


def cue_counts(text: str | None, table: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each cue occurs in a whole text, and how many n-grams it has."""
    counts, total = np.zeros(int(table.max(initial=-1)) + 1, np.int64), 0
    for b in _buckets(text):
        hit = table[b]
        counts += np.bincount(hit[hit >= 0], minlength=len(counts))
        total += len(b)
    return counts, total


def features(counts: np.ndarray, total: int) -> np.ndarray:
    """How often each cue occurs, how many do in all, and how dense they are."""
    hits = counts.sum()
    return np.concatenate([np.log1p(counts), [np.log1p(hits), 100.0 * hits / max(total, 1), np.log1p((counts > 0).sum())]]).astype(np.float32)


def lookup(cues: np.ndarray) -> np.ndarray:
    table = np.full(BUCKETS, -1, np.int16)
    table[cues] = np.arange(len(cues), dtype=np.int16)
    return table


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 120, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression with a constant, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    y = y.astype(x.dtype)
    w = ahead = np.zeros(x.shape[1], x.dtype)
    rate = np.float32(4.0 / max(1e-9, float(np.einsum("ij,ij->i", x, x).mean())))
    decay = np.float32(decay)
    for t in range(steps):
        new = ahead - rate * (x.T @ (sigmoid(x @ ahead) - y) / np.float32(len(x)) + decay * ahead)
        ahead = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    # Row by row sums: a matrix product rounds differently for other numbers of rows.
    return sigmoid((x * w[:-1]).sum(axis=1, dtype=np.float64) + w[-1])


def fit_chain(
    x: np.ndarray,
    categories: dict[str, np.ndarray],
    folds: int = FOLDS,
    keys: np.ndarray | None = None,
    without: Callable[[int], np.ndarray] | None = None,
) -> list[np.ndarray]:
    """One weight vector per category, in order. The rows' folds are their ``keys`` modulo ``folds``, so that
    rows with equal keys share one; without keys it is their positions. ``without(k)`` gives the features
    of all rows as the rows outside fold ``k`` suggest them; by default they are ``x``."""
    fold = (np.arange(len(x)) if keys is None else keys) % folds
    chain, earlier = [], np.zeros((len(x), 0), x.dtype)
    for y in categories.values():
        out_of_fold = np.zeros(len(x))
        for k in range(folds):
            inside, outside = fold != k, fold == k
            if inside.any() and outside.any():
                seen = np.hstack([x if without is None else without(k), earlier])
                out_of_fold[outside] = _probability(seen[outside], _logistic(seen[inside], y[inside]))
        chain.append(_logistic(np.hstack([x, earlier]), y))
        earlier = np.hstack([earlier, out_of_fold[:, None].astype(x.dtype)])
    return chain


def chain_probabilities(x: np.ndarray, chain: list[np.ndarray]) -> np.ndarray:
    """Probability of each category for each row, earlier ones feeding the later models."""
    seen = x
    for w in chain:
        seen = np.hstack([seen, _probability(seen, w)[:, None]])
    return seen[:, x.shape[1] :]


def design(doc: np.ndarray, cue: np.ndarray, count: np.ndarray, total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """``features`` of all documents over the cues ``kept``, from one entry per document and cue."""
    n, at = len(total), np.full(int(max(cue.max(initial=-1), kept.max(initial=-1))) + 1, -1, np.int64)
    at[kept] = np.arange(len(kept))
    mine = at[cue] >= 0
    doc, cue, count = doc[mine], at[cue[mine]], count[mine]
    hits = np.bincount(doc, weights=count, minlength=n)
    x = np.zeros((n, len(kept) + 3), np.float32)
    x[doc, cue] = np.log1p(count)
    x[:, -3] = np.log1p(hits)
    x[:, -2] = 100.0 * hits / np.maximum(total, 1)
    x[:, -1] = np.log1p(np.bincount(doc, minlength=n))
    return x


def two_kinds(x: np.ndarray, rounds: int = 20) -> np.ndarray:
    """0 or 1 for each row, by which entries occur together in it: two means of the rows' directions.

    Starts from the row least like the mean and the row least like that one, of equal ones the first. The larger
    kind is 0; rows all alike are one kind.
    """
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    far = unit[np.argmin(unit @ unit.mean(axis=0))]
    centres = np.stack([far, unit[np.argmin(unit @ far)]])
    kind = np.zeros(len(x), np.int64)
    for turn in range(rounds):
        near = unit @ centres.T
        new = (near[:, 1] > near[:, 0]).astype(np.int64)
        if turn and (new == kind).all():
            break
        kind = new
        centres = np.stack([unit[kind == k].mean(axis=0) if (kind == k).any() else centres[k] for k in (0, 1)])
    return 1 - kind if 2 * kind.sum() > len(kind) else kind


def _cue_rows(table):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, count, total = [], [], []
            for value in batch.column(1):
                counts, n = cue_counts(value.as_py(), table.value)
                at = np.flatnonzero(counts)
                index.append(at)
                count.append(counts[at])
                total.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(index, pa.list_(pa.int64())), pa.array(count, pa.list_(pa.int64())), pa.array(total, pa.int64())],
                names=["label", "place", "cue", "count", "total"],
            )

    return rows


def _judged(model):
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = model.value
        names = list(fit["chain"])
        for batch in batches:
            rows = [features(*cue_counts(v.as_py(), fit["table"])) for v in batch.column(batch.schema.get_field_index("_text"))]
            x = np.array(rows, np.float32).reshape(len(rows), -1)
            p = chain_probabilities(x, list(fit["chain"].values())) if rows else np.zeros((0, len(names)))
            rest = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in rest), *(pa.array(p[:, i].astype(np.float64)) for i in range(len(names)))],
                names=[*rest, *names],
            )

    return judged


def held_out_column() -> Column:
    return crc_of_id() % 5 == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, cues: int = CUES) -> dict | None:
    """Cue table and chain from labelled rows that are not held out; None without both labels.

    Categories: ``kind_1`` and ``kind_2``, the toxic rows parted by the cues that occur together in them (the
    larger part first), and last ``toxic``, the label.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    marks = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    marks = marks.where(~held_out_column())
    chosen = scratch.save(sampled(marks, marks.count(), fit_docs, "doc_id"))
    # The chosen ids are a bounded number, so the texts stay where they are.
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text", F.xxhash64("text").alias("place"))
    sets = find_cues(labelled, cues)
    if not len(sets[0]):
        return None
    every = np.unique(np.concatenate(sets))
    got = labelled.mapInArrow(
        tidy(_cue_rows(spark.sparkContext.broadcast(lookup(every)))), "label int, place bigint, cue array<bigint>, count array<bigint>, total bigint"
    ).toArrow()
    # One order for any partitioning, and copies of a text in one fold.
    got = got.sort_by([("place", "ascending"), ("label", "ascending"), ("total", "ascending")]).combine_chunks()
    y = got.column("label").to_numpy().astype(np.float64)
    place, total = got.column("place").to_numpy(), got.column("total").to_numpy()
    cue, count = (pc.list_flatten(got.column(c)).to_numpy() for c in ("cue", "count"))
    doc = np.repeat(np.arange(len(y)), pc.list_value_length(got.column("cue")).to_numpy())

    def over(found: np.ndarray) -> np.ndarray:
        return design(doc, cue, count, total, np.searchsorted(every, found))

    x = over(sets[0])
    bad = np.flatnonzero(y == 1)
    kind = two_kinds(x[bad, :-3])
    kinds = {f"kind_{k + 1}": np.zeros(len(y)) for k in (0, 1)}
    for k, of in enumerate(kinds.values()):
        of[bad[kind == k]] = 1
    chain = fit_chain(x, {**kinds, "toxic": y}, keys=place, without=lambda k: over(sets[k + 1]))
    return {"table": lookup(sets[0]), "chain": dict(zip([*kinds, "toxic"], chain))}


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, cues: int = CUES, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, p_kind_1, p_kind_2, p_toxic, toxic`` for every row of ``docs``.

    ``labels`` (``doc_id``, ``toxic``) is learned from where crc32 of the id modulo 5 is not 0; of repeated
    labels the highest counts. Whole texts are scored; a null or empty text has no cues. Without
    both labels every probability is 0. Repeated rows score alike; other columns are ignored.
    """
    model = fit_toxicity(docs, labels, fit_docs, cues)
    rows = docs.select("doc_id", held_out_column().alias("held_out"), F.col("text").alias("_text"))
    names = ["kind_1", "kind_2", "toxic"]
    if model is None:
        out = rows.drop("_text").withColumns({n: F.lit(0.0) for n in names})
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        kind = dict(docs.dtypes)["doc_id"]
        out = rows.mapInArrow(tidy(_judged(shared)), f"doc_id {kind}, held_out boolean, " + ", ".join(f"{n} double" for n in names))
    return out.select(
        "doc_id",
        "held_out",
        *[F.col(n).alias(f"p_{n}") for n in names],
        (F.col("toxic") >= threshold).cast("int").alias("toxic"),
    )
