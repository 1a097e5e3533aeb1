"""Ranked search against a plain scorer, with small buckets and blocks so that every bound is used."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from marginalia.llm.ranked import Bucket, Corpus, ranked_documents, terms_of

DOCS = "doc_id bigint, text string, item bigint, n int, score string, `my col` int, terms string"
ITEMS = "item_id bigint, text string, doc_id bigint, block int, at string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    bags = [Counter(plain_terms(d[1])) for d in docs]
    n, total = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item in items:
        found = []
        for d, bag in zip(docs, bags):
            m, score = 100 - 90 + (90 * sum(bag.values()) * n) // max(total, 1), 0
            for t in set(plain_terms(item[1])) & set(bag):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((-score, d[0] is None, d[0] or 0))
        for rank, (score, none, doc) in enumerate(sorted(found)[:k]):
            out.append((item[0], rank + 1, None if none else doc, -score))
    return sorted(out, key=repr)


def made(seed, n_docs, n_items):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("the", "und", "Éa", "x9", "no", "ON", "k\u0085", "ß") for b in "abcdefghijklmnop"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(n):
        return "".join(w + rng.choice([" ", ", ", "\n", "-", "_", "\x7f"]) for w in rng.choices(words, weights, k=n))

    docs = [(i * 7 % 1000, text(rng.choice([1, 3, 20, 60]))) for i in range(n_docs)]
    copy = docs[3][1]
    docs += [(2000 + i, copy) for i in range(25)] + [(2000, copy), (None, copy), (None, None), (5001, None), (5002, ""), (5003, "?!")]
    docs += [(5004, text(40_000)), (5005, "only here"), (5006, words[0] + " ")]
    items = [(i, text(rng.choice([1, 4, 12]))) for i in range(n_items)]
    items += [(90, None), (91, ""), (92, "unknown words only"), (93, copy), (93, copy), (None, "ONLY"), (94, words[0])]
    return [(*d, 1, 2, "x", 3, "t") for d in docs], [(*x, 4, 5, "y") for x in items]


def test_terms_are_maximal_matches():
    for text in ("", "A-Z a_z 09 É\u0085é x\x00y [k]`m~", "ZÀz{}|9\x7f8"):
        assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)


@pytest.mark.parametrize("bucket,head,bytes_", [(2048, 1 << 14, 8 << 20), (4, 20, 60)])
def test_ranking_equals_plain_version(spark, bucket, head, bytes_):
    docs, items = made(bucket, 150, 12)
    d = spark.createDataFrame(docs, DOCS).repartition(4)
    q = spark.createDataFrame(items, ITEMS)
    got = ranked_documents(d, q, 10, bucket=bucket, head=head, item_bytes=bytes_)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, 10)


def test_empty_tables(spark):
    docs, items = made(1, 5, 2)
    d, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert ranked_documents(d.limit(0), q).count() == 0 and ranked_documents(d, q.limit(0)).count() == 0
    assert ranked_documents(d.where("doc_id = 5003"), q).count() == 0


def test_bounds_keep_all_that_reach_a_score_and_prune_others():
    rng = np.random.default_rng(2)
    weight = rng.integers(1, 9000, 60)
    corpus = Corpus(1, 1, weight)
    dense = rng.integers(0, 100_000, (500, 60)) * (rng.random((500, 60)) < 0.3)
    count = (dense > 0).sum(axis=1)
    doc, term = np.nonzero(dense)
    length = np.sqrt((weight * dense.astype(float) ** 2).sum(axis=1))
    bucket = Bucket(np.arange(500), count, term, dense[doc, term], length, corpus)
    pruned = 0
    for _ in range(40):
        terms = rng.choice(60, 8, replace=False)
        terms = terms[np.argsort(-weight[terms])]
        size = math.sqrt(weight[terms].sum())
        scores = dense[:, terms] @ weight[terms]
        least = int(np.sort(scores)[-10])
        kept = bucket.survivors(terms, np.sqrt(weight[terms]) / size, size, least)
        assert set(np.flatnonzero(scores >= least)) <= set(kept.tolist())
        assert (bucket.scores(terms, weight[terms], kept) == scores[kept]).all()
        pruned += 500 - len(kept)
    assert pruned > 40 * 250
