"""The manifest against a plain recursive version, with odd rows and many small superblocks."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from marginalia.llm.merkle import digest_columns, folded, manifest, paths, reduced

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, pos int, `my col` int, path string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    cells = [row[0], row[3], row[2], row[4], text]
    return h(*("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))


def tree(nodes):
    """Root of the nodes and the list of (siblings before, siblings after) of each of them."""
    ways = [[] for _ in nodes]
    spots = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, merged = [], []
        for i in range(0, len(nodes), 3):
            run = nodes[i : i + 3]
            for k in range(len(run)):
                for leaf_at in spots[i + k]:
                    ways[leaf_at].append((run[:k], run[k + 1 :]))
            above.append(h(*run))
            merged.append([x for k in range(len(run)) for x in spots[i + k]])
        nodes, spots = above, merged
    return nodes[0], ways


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for s in order:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        made.append((mine, *tree([leaf(r, r[1]) for r in mine])))
    root, over = tree([sub for _, sub, _ in made])
    out = []
    for (mine, sub, ways), above in zip(made, over):
        for r, way in zip(mine, ways):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            digest, siblings = leaf(r, text), []
            for left, right in way + above:
                digest = h(*left, digest, *right)
                siblings += left + right
            out.append((r[0], leaf(r, r[1]), sub, root, h(*siblings), digest, digest == root))
    return sorted(out, key=repr)


def odd_rows(n):
    rows = [(i * 3, f"line {i}\nand é {i}", "en", f"s{i % 3}" if i % 5 else "hot", 7, "x", 1, 2, "p") for i in range(n)]
    rows += [
        (None, None, None, None, None, None, None, None, None), (None, "a\nb", None, None, None, None, None, None, None),
        (5, "same\n", "de", "hot", 3, "x", 1, 2, "p"), (5, "same\n", "de", "hot", 3, "x", 1, 2, "p"), (5, "other", "de", "hot", 3, "x", 1, 2, "p"),
        (8, "", "fr", "", 0, "x", 1, 2, "p"), (9, "long\n" * 50_000, "fr", "é", 1, "x", 1, 2, "p"), (-4, "-", "-", "-", -1, "x", 1, 2, "p"),
        (77, "alone", "es", "Z", 5, "x", 1, 2, "p"),
    ]
    return rows


def claimed():
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


@pytest.mark.parametrize("n,levels", [(0, 6), (70, 6), (70, 1), (260, 2)])
def test_manifest_equals_plain_version(spark, n, levels):
    rows = odd_rows(n)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = digest_columns(manifest(df, claimed(), levels=levels))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 1, "x", 1, 2, "p")], DOCS)
    (row,) = manifest(df).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof"] == b""
    none = manifest(df.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root"]


def test_a_changed_leaf_gives_another_root():
    leaves = [h(str(i)) for i in range(30)]
    up = reduced(leaves, 6, True)
    for leaf_, path in zip(leaves, paths(up, "")):
        assert folded(leaf_, path)[0] == up[-1][0] and folded(h("x"), path)[0] != up[-1][0]
