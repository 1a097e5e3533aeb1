"""Personal data by fixed patterns and by bootstrapped contexts.

Four patterns find e-mail and IP addresses, card and phone numbers. These are the seeds. The word
before a seed, and the two words before it, are its contexts: lexical patterns that say "here an
identifier follows". The same contexts lead to other tokens that look like identifiers. Patterns
and values make a graph whose two sides are scored in turn, as joins and aggregates:

* a pattern is as good as the mean score of the distinct values seen behind it, times the share of
  all its occurrences in the corpus that an identifier follows at all; it needs ``SUPPORT`` distinct
  values of high score, so copies of a text do not count twice;
* a value is a seed, with score 1, or as good as the patterns it stands behind (one minus the
  product of their doubts). Values that reach ``CONFIDENCE`` support patterns in the next round.

Rounds end when no value is gained. Tokens behind a pattern of ``CONFIDENCE`` or more are spans of
kind ``found``. Words such as ``the`` lead to all kinds of words, so their share keeps them out.

A token looks like an identifier if it is a run of ASCII letters, digits and ``_@/.-``, without
``_/.-`` at its ends, of 6 to 64 characters with at least 4 digits, and meets no seed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import Scratch, tidy
from marginalia.operators.ranking import checked_small, split_join

KINDS = ("email", "ip", "card", "phone", "found")
#: Distinct good values behind a pattern, least confidence, most rounds.
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.6, 8
#: Patterns whose occurrences one scan of the texts counts, and keys that a task keeps.
PATTERNS, KNOWN = 1 << 18, 1 << 18
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_@/.-")
EDGE = "_/.-"
SHORT, LONG, FIGURES = 6, 64, 4
LETTERS = re.compile(r"[^\W\d_]+")

Span = tuple[int, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost addresses, looked up from each ``@``: what is before it back to the last match."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if domain:
            out.append((start, 0, domain.end()))
            free = domain.end()
        at = text.find("@", free)
    return out


def addresses(text: str) -> list[Span]:
    """Of numbers joined by dots every four in turn are a match; each may be 255 at most."""
    out = []
    for run in DOTTED.finditer(text):
        parts, at = run[0].split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((at, 1, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    return out


def phones(text: str) -> list[Span]:
    return [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def base_spans(text: str) -> list[Span]:
    """``(start, kind, end)`` of the four patterns, in order."""
    return sorted(emails(text) + addresses(text) + cards(text) + phones(text))


def look_alikes(text: str, seeds: list[Span]) -> list[Span]:
    """Tokens that look like identifiers and meet no seed."""
    covered: list[list[int]] = []
    for start, _, end in seeds:
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    out, done, at = [], 0, 0
    for m in DIGITS.finditer(text):
        if m.start() < done:
            continue
        start, end = m.start(), m.end()
        while start > done and text[start - 1] in TOKEN:
            start -= 1
        while end < len(text) and text[end] in TOKEN:
            end += 1
        done = end
        start += len(text[start:end]) - len(text[start:end].lstrip(EDGE))
        token = text[start:end].rstrip(EDGE)
        end = start + len(token)
        if not SHORT <= len(token) <= LONG or sum("0" <= c <= "9" for c in token) < FIGURES:
            continue
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if at == len(covered) or covered[at][0] >= end:
            out.append((start, 4, end))
    return out


def key_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 5)


class Keys(dict):
    """Keys of words, whatever their case; computed once for each spelling."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        key = self[word] = key_of(word.lower())
        return key


def context_keys(words: list[str], keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word, and of it with the word before; an empty word stands before all."""
    one = np.fromiter(map(keys.__getitem__, ["", *words]), np.uint64, len(words) + 1)
    before = np.concatenate([one[:1], one[:-1]])
    return one.view(np.int64), (before * np.uint64(0x9E3779B97F4A7C15) + (one ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)


def scanned(text: str, keys: Keys) -> tuple[list[Span], list[tuple]]:
    """Seeds of a text, and ``(start, kind, end, value, one, two, first)`` of seeds and look-alikes.

    ``one`` and ``two`` are the keys of the words that end before the span; ``first`` says that no
    other span stands behind the same words.
    """
    seeds = base_spans(text)
    spans = sorted(seeds + look_alikes(text, seeds))
    if not spans:
        return seeds, []
    found = list(LETTERS.finditer(text))
    one, two = context_keys([m[0] for m in found], keys)
    ends = np.fromiter((m.end() for m in found), np.int64, len(found))
    at = np.searchsorted(ends, [s for s, _, _ in spans], side="right")
    first = np.diff(at, prepend=-1) != 0
    values = np.array([key_of(text[s:e].lower()) for s, _, e in spans], np.uint64).view(np.int64)
    return seeds, list(zip(*zip(*spans), values.tolist(), one[at].tolist(), two[at].tolist(), first.tolist()))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


PLACE = ("start", "kind", "end", "value", "one", "two", "first")
PLACES = "array<struct<start:bigint,kind:int,end:bigint,value:bigint,one:bigint,two:bigint,first:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = [(n, pa.int32() if n == "kind" else pa.bool_() if n == "first" else pa.int64()) for n in PLACE]
    kind, keys = pa.list_(pa.struct(numbers)), Keys()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            counts, digests, places = [], [], []
            for text in part.column(1):
                seeds, spans = scanned(text.as_py() or "", keys)
                counts.append([sum(k == i for _, k, _ in seeds) for i in range(4)])
                digests.append(hashlib.sha256(joined(seeds).encode()).hexdigest())
                places.append([dict(zip(PLACE, s)) for s in spans])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(digests), pa.array(places, kind)],
                names=["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "places"],
            )


def _occurrences(wanted: np.ndarray):
    """How often each of the ``wanted`` contexts, in order, occurs in a task, whatever follows it."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys = np.zeros(len(wanted), np.int64), Keys()
        # Most contexts are none of those wanted: a look at some of their bits tells.
        bits = np.zeros(1 << 22, bool)
        bits[wanted & (len(bits) - 1)] = True
        for batch in batches:
            for text in batch.column(0):
                for key in context_keys(LETTERS.findall(text.as_py() or ""), keys):
                    key = key[bits[key & (len(bits) - 1)]]
                    at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                    np.add.at(seen, at[wanted[at] == key], 1)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[seen > 0]), pa.array(seen[seen > 0])], names=["pattern", "all"])

    return occurrences


def _keyed(places: DataFrame) -> DataFrame:
    """``pattern, value, seed, first`` for both contexts of every place."""
    return places.select(F.explode("places").alias("p")).select(
        F.explode(F.array("p.one", "p.two")).alias("pattern"), "p.value", (F.col("p.kind") < 4).alias("seed"), "p.first"
    )


def pattern_graph(docs: DataFrame, places: DataFrame, scratch: Scratch, support: int = SUPPORT, confidence: float = CONFIDENCE, block: int = PATTERNS) -> DataFrame:
    """``pattern, value, seed, share``: the edges of all patterns that can reach ``confidence``.

    A pattern's confidence is at most its share, and it needs ``support`` distinct values, so all
    others are left out before the rounds. ``share`` is taken over all texts. The patterns are sent to the
    scan in blocks of about ``block``.
    """
    edges = scratch.save(
        _keyed(places).groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count(F.when(F.col("first"), 1)).alias("n"))
    )
    followed = (
        edges.groupBy("pattern")
        .agg(F.count("*").alias("values"), F.sum("n").alias("n"))
        .where(F.col("values") >= support)
        .select("pattern", "n")
    )
    followed = scratch.save(followed)
    total = followed.count()
    parts = max(1, -(-total // block))
    shares = None
    for part in range(parts if total else 0):
        own = followed.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)
        wanted = np.sort(own.select("pattern").toArrow().column(0).to_numpy())
        if not len(wanted):
            continue
        seen = docs.select("text").mapInArrow(tidy(_occurrences(wanted)), "pattern bigint, all bigint")
        made = scratch.save(seen.groupBy("pattern").agg(F.sum("all").alias("all")))
        shares = made if shares is None else shares.unionByName(made)
    if shares is None:
        return edges.limit(0).select("pattern", "value", "seed", F.lit(0.0).alias("share"))
    strong = (
        followed.join(shares, "pattern")
        .select("pattern", F.least(F.lit(1.0), F.col("n") / F.col("all")).alias("share"))
        .where(F.col("share") >= confidence)
    )
    return split_join(edges.drop("n"), scratch.save(strong), ["pattern"])


def good_patterns(graph: DataFrame, scratch: Scratch, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, score`` of the patterns that reach ``confidence``, after the last round.

    Each round is two aggregates over the edges; the table of values gained is the only state.
    """
    graph = scratch.save(graph)
    gained, before = None, 0
    for _ in range(rounds):
        scored = graph.withColumn("score", F.col("seed").cast("double"))
        if gained is not None:
            scored = graph.join(gained, "value", "left").select(
                "pattern", "value", "seed", "share", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("gain", F.lit(0.0))).alias("score")
            )
        patterns = scratch.save(
            scored.groupBy("pattern", "share")
            .agg(F.avg("score").alias("mean"), F.count(F.when(F.col("score") >= confidence, 1)).alias("good"))
            .where((F.col("good") >= support) & (F.col("mean") * F.col("share") >= confidence))
            .select("pattern", (F.col("mean") * F.col("share")).alias("score"))
        )
        doubt = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-12))))
        gained = scratch.save(
            graph.where(~F.col("seed"))
            .join(patterns, "pattern")
            .groupBy("value")
            .agg((1 - F.exp(doubt)).alias("gain"))
            .where(F.col("gain") >= confidence)
        )
        now = gained.count()
        if now == before:
            break
        before = now
    return patterns


def personal_spans(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``docs``.

    ``spans`` is ``array<struct<start, kind, end>>`` in order, positions in code points with exclusive
    ends; kinds 0 to 3 are the patterns, 4 what the contexts found. ``base_sha256`` is the digest of
    the spans of the patterns alone. A null or empty text has no spans. Rows that repeat an id or a
    text are judged alike, and null ids are kept. Other columns are ignored, and an empty table gives
    an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.save(
        texts.mapInArrow(tidy(_scan), f"doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, places {PLACES}")
    )
    graph = pattern_graph(texts, rows.select("places"), scratch, support, confidence)
    patterns = good_patterns(graph, scratch, support, confidence)
    seeds = F.filter("places", lambda p: p["kind"] < 4)
    others = F.filter("places", lambda p: p["kind"] == 4)
    kept = [c for c in rows.columns if c != "places"]
    known = checked_small(patterns.select("pattern"))
    if patterns.isEmpty():
        return rows.select(*kept, _bare(seeds).alias("spans"))
    numbered = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()))
    each = numbered.select("row", F.explode(others).alias("p"))
    both = each.select("row", "p", F.explode(F.array("p.one", "p.two")).alias("pattern"))
    if known is not None:
        hit = both.join(known, "pattern", "left_semi")
    else:
        hit = split_join(both, patterns.select("pattern"), ["pattern"], "left_semi")
    found = hit.groupBy("row").agg(F.collect_set("p").alias("found"))
    return numbered.join(found, "row", "left").select(
        *kept, _bare(F.array_sort(F.concat(seeds, F.coalesce("found", F.array().cast(PLACES))))).alias("spans")
    )


def _bare(places: Column) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))


def joined_spans(spans: str) -> Column:
    """Spans as ``kind:start:end`` text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
