"""The pipeline stage by stage against plain versions, on the smallest tables."""

import itertools
import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from marginalia.llm.common import Scratch
from marginalia.llm.mixing import mix
from marginalia.llm.packing import tokenizer_of
from marginalia.llm.quality import quality_scores
from test_pairs import plain_fingerprint, roots
from test_texts import VOCABULARY, plain_spans

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_stages_equal_plain_versions(spark):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    made = [docs]
    for _, stage in P.STAGES:
        made.append(scratch.save(stage(spark, made[-1], SF_DIR)))
    assert all(m.columns == columns for m in made[:-1])

    scored = quality_scores(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    good = {r["doc_id"] for r in scored.collect() if r["predicted"]}
    assert rows(made[1]) == sorted((tuple(r) for r in docs.collect() if r["doc_id"] in good), key=repr)

    before = made[1].collect()
    prints = [plain_fingerprint(r["text"]) for r in before]
    root = roots(len(before), [(i, j) for i, j in itertools.combinations(range(len(before)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {}
    for r, k in zip(before, root):
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert rows(made[2]) == sorted((tuple(r) for r in before if r["doc_id"] in set(least.values())), key=repr)

    before = made[2].collect()
    want = []
    base, extra = plain_spans([r["text"] for r in before])
    for r, b, e in zip(before, base, extra):
        text, merged = r["text"], []
        for s, _, end in sorted(b + e):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([s, end])
        for s, end in reversed(merged):
            text = text[:s] + "[secret]" + text[end:]
        want.append((r["doc_id"], text, r["lang"], r["source"], len(text) if merged else r["n_chars"]))
    assert rows(made[3]) == sorted(want, key=repr)

    times = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 1 for r in mix(made[3]).collect()}
    assert Counter(r["doc_id"] for r in made[4].collect()) == Counter({k: v for k, v in times.items() if v})

    slow = tokenizer_of(VOCABULARY[0])
    ids = Counter()
    for r in made[4].collect():
        ids[r["doc_id"]] += len(slow.encode(r["text"], add_special_tokens=False).ids) + 1
    got, sizes = Counter(), Counter()
    for r in made[5].collect():
        got[r["doc_id"]] += r["length"]
        sizes[r["sequence_id"]] += r["length"]
    assert got == ids and all(s == 1024 or s & (s - 1) == 0 for s in sizes.values())
    whole = P.run(spark, SF_DIR)
    assert whole.columns == made[5].columns and np.sum([r["length"] for r in whole.collect()]) == sum(ids.values())


def test_empty_documents_pass_every_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0
