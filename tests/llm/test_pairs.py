"""SimHash groups, vector links and top-k against brute force, on small tables with odd rows."""

import itertools
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marginalia.llm.common import Forest, Scratch
from marginalia.llm.graph import components
from marginalia.llm.nearest import CoverTree, top_inner
from marginalia.llm.simhash import covering_masks, fingerprint_of, near_groups, one_per_group, simhash_components
from marginalia.llm.vector_links import vector_groups

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, key int"


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_masks_hide_any_three_bits():
    for family in (0, 1):
        masks = covering_masks(3, family)
        assert len(masks) == 15
        assert all(any(not m & bits for m in masks) for bits in (
            (1 << a) | (1 << b) | (1 << c) for a, b, c in itertools.combinations(range(64), 3)))


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ")
             .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_stated_one(spark):
    rng = random.Random(1)
    texts = ["", " \n", "One", "one TWO", "a b c", "É é A B c d", "x " * 40_000]
    texts += [" ".join(rng.choice("aAbBcC\tdé") for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    assert [fingerprint_of(t.encode(), block=16) for t in texts] == [plain_fingerprint(t) for t in texts]
    # The engine's own hash function agrees on a single shingle.
    got = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == fingerprint_of(b"a b c")


@pytest.mark.parametrize("large", [4096, 3])
def test_near_groups_equal_brute_force(spark, large):
    rng = random.Random(large)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for base in prints[:6]:
        for _ in range(25):
            flip = 0
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                flip |= 1 << b
            prints.append(base ^ flip)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = roots(len(prints), links)
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = {r["fp"]: r["component"] for r in near_groups(df, Scratch(spark), large=large).collect()}
    same = {}
    for i, fp in enumerate(signed):
        same.setdefault(want[i], set()).add(got.get(fp, fp))
    assert all(len(v) == 1 for v in same.values()) and len({*itertools.chain(*same.values())}) == len(same)


def odd_documents():
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    return [
        (5, "the same words in this text", "en", "a", 1, "x", 1), (3, "THE same words\tin this  text", "en", "a", 1, "x", 1),
        (3, "THE same words\tin this  text", "en", "a", 1, "x", 1), (None, "the same words in this text", None, None, None, None, None),
        (9, None, "en", "b", 0, "x", 1), (7, "", "en", "b", 0, "x", 1), (None, " ", None, "b", 0, "x", 1),
        (11, long, "en", "b", 1, "x", 1), (12, long + " end", "en", "b", 1, "x", 1), (13, "alone", None, None, None, None, None),
        (None, "no id and no copy", None, None, None, None, None),
    ]


def test_simhash_components_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_documents(), DOCS)
    got = sorted(map(tuple, simhash_components(docs).collect()), key=repr)
    want = []
    rows = odd_documents()
    prints = [plain_fingerprint(r[1] or "") for r in rows]
    root = roots(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3])
    for i, r in enumerate(rows):
        ids = [x[0] for x, k in zip(rows, root) if k == root[i] and x[0] is not None]
        want.append((r[0], f"{prints[i]:016x}", min(ids, default=None)))
    assert got == sorted(want, key=repr)
    assert simhash_components(docs.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = spark.createDataFrame(odd_documents(), DOCS)
    got = one_per_group(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted([3, 7, 11, 13, None], key=repr)
    assert one_per_group(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 400)]
    hub = [(1, i) for i in range(1000, 1800)] + [(2000, 2001), (7, 7)]
    df = spark.createDataFrame(chain + hub, "a bigint, b bigint")
    got = dict(components(df, Scratch(spark)).collect())
    assert {got[i] for i in range(100, 401)} == {100} and {got[i] for i in range(1000, 1800)} == {1}
    assert got[2001] == 2000 and 7 not in got
    assert components(df.limit(0), Scratch(spark)).count() == 0


def test_forest_keeps_what_connects():
    kept = Forest(6).link(np.array([0, 1, 0, 3]), np.array([1, 2, 2, 4]))
    assert len(kept) == 3 and len(set(roots(6, kept))) == 3


def vectors():
    rng = np.random.default_rng(3)
    rows = [rng.normal(size=8) for _ in range(150)]
    rows += [rows[i % 10] + rng.normal(size=8) * 0.2 for i in range(150)]
    rows += [rows[0]] * 60
    out = [(i + 1, [float(x) for x in r], 0, "x") for i, r in enumerate(rows)]
    out += [
        (900, None, 0, "x"), (901, [], 0, "x"), (902, [0.0] * 8, 0, "x"), (903, [1.0] * 7 + [float("nan")], 0, "x"),
        (904, [1.0] * 7 + [None], 0, "x"), (905, [1.0, 2.0], 0, "x"), (906, [2.0, 4.0], 0, "x"), (907, [1e200] * 8, 0, "x"),
        (908, [float("inf")] + [1.0] * 7, 0, "x"), (None, out[3][1], 0, "x"), (4, out[3][1], 0, "x"),
    ]
    return out


@pytest.mark.parametrize("block,visitors", [(4096, 1 << 18), (16, 64)])
def test_vector_groups_equal_brute_force(spark, block, visitors):
    rows = vectors()

    def fit(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, links = [0] * len(rows), []
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i][1], rows[j][1]
        if fit(a) and fit(b) and len(a) == len(b):
            a, b = (np.array(x) / np.max(np.abs(x)) for x in (a, b))
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    root, want = roots(len(rows), links), []
    for i, r in enumerate(rows):
        least = min((x[0] for x, k in zip(rows, root) if k == root[i] and x[0] is not None), default=None)
        want.append((r[0], n[i], least, r[0] is not None and r[0] == least))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, vec string").repartition(5)
    got = vector_groups(df, 0.9, block=block, visitors=visitors)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert vector_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("block,group", [(4096, 1 << 16), (24, 8)])
def test_top_inner_equals_brute_force(spark, block, group):
    rows = [r for r in vectors() if r[0] != 907]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, row string").repartition(5)
    got = top_inner(df, F.col("vec_id") % 10 == 0, k=5, block=block, group=group).collect()
    whole = []
    for i, (vid, v, *_) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, vid, np.floor(256 * np.array(v)).astype(int)))
    want = []
    for i, vid, v in whole:
        if vid is not None and vid % 10 == 0:
            found = sorted((-int(v @ w), float("inf") if o is None else o, j) for j, o, w in whole if j != i and len(w) == len(v))[:5]
            want += [(vid, k + 1, None if o == float("inf") else o, -s) for k, (s, o, _) in enumerate(found)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert top_inner(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("block,group", [(4096, 1 << 16), (16, 8)])
def test_top_inner_is_exact_beyond_doubles(spark, block, group):
    """Scores around 2^60 that differ by one, among small ones."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    rows += [(1000 + i, [float(x) for x in rng.integers(-(1 << 21), 1 << 21, 4)]) for i in range(60)]
    rows += [(2000 + i, [float(1 << 21), float(i % 7) / 256, 1.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    got = top_inner(df, F.col("vec_id") % 10 == 0, k=5, block=block, group=group).collect()
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for i, v in whole:
        if i % 10 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    assert max(w[3] for w in want) > 1 << 58
    assert sorted(map(tuple, got)) == sorted(want)
    # A vector that is too long for a score stops the job only if a query can meet it.
    far = df.unionByName(spark.createDataFrame([(5001, [1e30, 0.0, 0.0, 0.0])], "vec_id bigint, embedding array<double>"))
    with pytest.raises(ValueError, match="64 bits"):
        top_inner(far, F.col("vec_id") == 10)
    assert top_inner(far, F.lit(False)).count() == 0


def test_batches_of_copies_are_bounded():
    """Every vector visits every block here; no batch has more rows than stated."""
    import pyarrow as pa

    from marginalia.llm import nearest, vector_links

    rng = np.random.default_rng(1)
    n, cells = 3000, 48
    points = rng.normal(size=(n, 16))
    cell = rng.integers(0, cells, n).astype(np.int32)
    vec = pa.array(points.tolist(), pa.list_(pa.float64()))
    centres = {16: rng.normal(size=(cells, 16))}
    blocks = {(16, c): 2 for c in range(cells)}
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n)), vec, pa.array(np.ones(n, np.int64)), pa.array(np.full(n, 16, np.int32)), pa.array(cell)],
        names=["rep", "vec", "copies", "width", "cell"],
    )
    reach = {(16, c): 99.0 for c in range(cells)}
    sizes = [b.num_rows for b in vector_links._visits(centres, reach, blocks, 9.0, 1)(iter([batch]))]
    assert max(sizes) <= vector_links.EMITTED and sum(sizes) > n * cells / 2
    asking = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n)), pa.array(np.arange(n)), vec, pa.array(np.full(n, 16, np.int32)), pa.array(cell), pa.array(np.full(n, -np.inf))],
        names=["row", "vec_id", "vec", "width", "cell", "floor"],
    )
    sizes = [b.num_rows for b in nearest._sent(centres, reach, blocks, False)(iter([asking]))]
    assert max(sizes) <= nearest.EMITTED and sum(sizes) == n * (cells - 1) * 2


def test_cover_tree_radii_cover(spark):
    points = np.random.default_rng(5).normal(size=(700, 6))
    points[100:300] = points[7]
    tree = CoverTree(points)
    for node, rows in enumerate(tree.rows):
        away = np.sqrt(((points[rows] - points[tree.centre[node]]) ** 2).sum(axis=1))
        assert away.max() <= tree.radius[node] + 1e-9
        if tree.children[node]:
            assert sorted(np.concatenate([tree.rows[c] for c in tree.children[node]])) == sorted(rows)
