"""Text quality by positive-unlabelled learning.

Only documents marked good are trusted; everything else is unlabelled web text, a mixture of good
and bad. The share of good documents in it, the class prior, is estimated from how often the
two kinds reach high scores of a first classifier: the smallest ratio of unlabelled to trusted
documents above any score. A linear scorer then minimises the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import crc_of_id, sampled, sigmoid, tidy, with_field

#: Most trusted and most unlabelled documents that the scorer is fitted on (about; drawn evenly).
FIT_DOCS = 8000
THRESHOLD = 0.3
CLASSES = 16
#: Bytes looked at in one piece.
PIECE = 1 << 20


def _byte_classes() -> bytes:
    """Class of each byte of UTF-8 text: letters, digits, blanks, kinds of marks, wide letters."""
    out = [14] * 256
    groups = [
        (b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" ", 3),
        (b"\n", 4), (b".", 5), (b",;:", 6), (b"!?", 7), (b"|", 8), (b"#$%&*@~^+=<>_/\\`", 9), (b"\"'()[]{}", 10),
        (b"-", 11), (bytes(range(0xC2, 0x100)), 12), (bytes(range(0x80, 0xC2)), 13), (b"\t\r\x0b\x0c", 15),
    ]
    for chars, k in groups:
        for c in chars:
            out[c] = k
    return bytes(out)


BYTE_CLASSES = _byte_classes()
WIDTH = CLASSES * CLASSES + 8


def features(text: bytes) -> np.ndarray:
    """Shape of a text: rates of neighbouring byte classes, and repetition of words and lines."""
    out = np.zeros(WIDTH, np.float32)
    pairs = np.zeros(CLASSES * CLASSES, np.int64)
    last = np.array([4], np.uint8)
    for at in range(0, len(text), PIECE):
        codes = np.concatenate([last, np.frombuffer(text[at : at + PIECE].translate(BYTE_CLASSES), np.uint8)])
        pairs += np.bincount(codes[:-1].astype(np.int16) * CLASSES + codes[1:], minlength=CLASSES * CLASSES)
        last = codes[-1:]
    out[: CLASSES * CLASSES] = np.sqrt(pairs / max(1, len(text)))
    words = text.split()
    n = len(words)
    if n:
        sizes = np.fromiter(map(len, words), np.int64, n)
        seen: dict[bytes, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        lines = text.split(b"\n")
        again = sum(a == b for a, b in zip(words, words[1:]))
        out[CLASSES * CLASSES :] = (
            np.log1p(n), sizes.mean() / 10, sizes.std() / 10, len(seen) / n, max(seen.values()) / n,
            again / n, len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        )
    return out


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(v.as_py() or b"") for v in batch.column(2)]
        flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.float32))
        vectors = pa.FixedSizeListArray.from_arrays(flat, WIDTH).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors], names=["kind", "place", "x"])


def _fitted(x: np.ndarray, gradient, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Weights of a linear scorer by Adam; the last one is the constant."""
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(trusted: np.ndarray, unlabelled: np.ndarray, least: float = 0.02) -> float:
    """Share of good documents among the unlabelled, from scores of both.

    The ratio of the two shares above a score bounds the prior from above; the score is chosen
    where that ratio, with its sampling error added, is smallest.
    """
    cuts = np.unique(np.quantile(trusted, np.linspace(0.0, 1.0 - least, 200)))
    p = np.array([(trusted >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    error = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(trusted)) + 1 / np.sqrt(len(unlabelled)))
    best = int(np.argmin((u + error) / p))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit_scorer(trusted: np.ndarray, unlabelled: np.ndarray, decay: float = 3e-3) -> dict[str, np.ndarray]:
    """Scale, weights and prior from the features of both kinds."""
    both = np.concatenate([trusted, unlabelled])
    mean, std = both.mean(axis=0), both.std(axis=0)
    std[std < 1e-6] = 1.0

    def scaled(x: np.ndarray) -> np.ndarray:
        x = np.clip((x - mean) / std, -4, 4)
        return np.hstack([x, np.ones((len(x), 1))])

    p, u = scaled(trusted), scaled(unlabelled)

    def against(p: np.ndarray, u: np.ndarray) -> np.ndarray:
        def gradient(w: np.ndarray) -> np.ndarray:
            return (u.T @ sigmoid(u @ w)) / len(u) - (p.T @ sigmoid(-(p @ w))) / len(p) + 1e-3 * w

        return _fitted(p, gradient, 200)

    # Each half is scored by weights that the other half gave.
    scores: list[list[np.ndarray]] = [[], []]
    for k in range(2):
        w = against(p[k::2], u[k::2])
        scores[0].append(p[1 - k :: 2] @ w)
        scores[1].append(u[1 - k :: 2] @ w)
    prior = class_prior(np.concatenate(scores[0]), np.concatenate(scores[1]))

    def gradient(w: np.ndarray) -> np.ndarray:
        # Logistic loss: its slope does not vanish for good documents that score very low.
        gp, gu = p @ w, u @ w
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        down = (u.T @ sigmoid(gu)) / len(u) - prior * (p.T @ sigmoid(gp)) / len(p)
        up = prior * (p.T @ sigmoid(-gp)) / len(p)
        # Below zero the second risk has been over-fitted: only that is undone in this step.
        return -down + decay * w if negative < 0 else down - up + decay * w

    return {"mean": mean, "std": std, "w": _fitted(p, gradient), "prior": np.array([prior])}


def _scored(model):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = model.value
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            scores = []
            for value in batch.column(at):
                x = np.clip((features(value.as_py() or b"") - fit["mean"]) / fit["std"], -4, 4)
                scores.append(float(sigmoid(x @ fit["w"][:-1] + fit["w"][-1])))
            rest = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in rest), pa.array(scores, pa.float64())],
                names=[*rest, "score"],
            )

    return scored


def held_out_column() -> Column:
    return crc_of_id() % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> dict[str, np.ndarray] | None:
    """A scorer from rows that are not held out; None when there is no trusted or no other text."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.where(~held_out_column()).select("doc_id", "text")
    ids = rows.select("doc_id")
    trusted = ids.join(marks.where("quality = 1"), "doc_id", "left_semi")
    counts = [ids.count(), trusted.count()]
    if not all(counts):
        return None
    chosen = sampled(trusted.distinct(), counts[1], fit_docs, "doc_id")
    place = F.xxhash64("text", "doc_id").alias("place")
    text = F.col("text").cast("binary").alias("text")
    # The chosen ids are a bounded number, so the texts stay where they are.
    good = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.lit(1).alias("kind"), place, text)
    some = sampled(rows, counts[0], fit_docs, "text", "doc_id", seed=8).select(F.lit(0).alias("kind"), place, text)
    got = good.unionByName(some).mapInArrow(tidy(_feature_batches), "kind int, place bigint, x array<float>").toArrow()
    kind, place_ = got.column("kind").to_numpy(), got.column("place").to_numpy()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(np.float64)
    # One order for any partitioning, so that sums and halves are the same.
    order = np.lexsort((place_, kind))
    kind, x = kind[order], x[order]
    return fit_scorer(x[kind == 1], x[kind == 0])


def scored_documents(docs: DataFrame, model: dict[str, np.ndarray] | None, *keep: Column) -> DataFrame:
    """``keep`` and the score of every row; without a model every score is 1."""
    rows = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    if model is None:
        return rows.drop("_text").withColumn("score", F.lit(1.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(tidy(_scored(shared)), with_field(rows.schema, ("score", T.DoubleType())))


def quality_scores(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id``, ``text``).

    ``labels`` (``doc_id``, ``quality``) is learned from only where crc32 of the id modulo 5 is not
    0 (a null id counts as the empty text, so it is held out). Of repeated labels the lowest counts.
    About ``fit_docs`` trusted and as many unlabelled documents are used, drawn evenly. A null
    text is scored like an empty one; repeated rows score alike; without trusted documents every
    score is 1. Other columns are ignored.
    """
    model = fit_quality(docs, labels, fit_docs)
    out = scored_documents(docs, model, F.col("doc_id"), held_out_column().alias("held_out"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the scorer does not reject, as they are."""
    model = fit_quality(docs, labels, fit_docs)
    if model is None:
        return docs
    scored = scored_documents(docs, model, F.struct("*").alias("_row"))
    return scored.where(F.col("score") >= threshold).select("_row.*")
