"""Merkle manifest of a document table by a cogrouped exchange of subtrees.

Every row is a leaf. The leaves of a source, in the order of their ids, are cut into superblocks
of ``ARITY ** LEVELS`` neighbours. A first exchange reduces every superblock to its top node; the
tops are few, and rounds of the same step bring them up to the root of the source and, over the
sources, to the root of the table. Going back down, each round hands every node the path above it.
In the last exchange the leaves of a superblock and the path above its top are cogrouped: one call
of the function finishes the reduction inside the superblock, joins each leaf's proof from the
inner and the outer part, and folds the leaf as it is claimed along that proof.

A superblock has at most ``ARITY ** LEVELS`` rows whatever its source holds, so a source with a
third of all rows is many superblocks, and only digests move between tasks, never texts.

Digests are lower-case hex text. A path is, from the leaf up, one ``slot`` and the siblings of a
node in its run for each level: ``(slot digit)(number of siblings digit)(siblings)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import Scratch
from marginalia.operators.ranking import checked_small, global_positions, split_join

ARITY, LEVELS = 3, 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
WIDE = 64


def leaf_of(columns: Sequence[Column]) -> Column:
    """Digest of the columns in order, each with its length in bytes; ``-`` for null."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(
            F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
        )
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def hashed(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def reduced(nodes: list[str], levels: int, alone: bool) -> list[list[str]]:
    """The levels of a tree over ``nodes``, from the bottom; the last one has the top node.

    ``alone`` says that these are all the nodes of their tree, which ends where one is left.
    Otherwise there are other superblocks and all ``levels`` are taken, with runs of one as well.
    """
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        if alone and len(below) == 1:
            break
        out.append([hashed(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


def paths(tree: list[list[str]], above: str) -> list[str]:
    """The path of every node at the bottom of ``tree``, with ``above`` beyond its top."""
    ways = [above]
    for nodes in reversed(tree[:-1]):
        made = []
        for i in range(len(nodes)):
            run = nodes[i - i % ARITY : i - i % ARITY + ARITY]
            slot = i % ARITY
            made.append(f"{slot}{len(run) - 1}{''.join(run[:slot])}{''.join(run[slot + 1:])}{ways[i // ARITY]}")
        ways = made
    return ways


def folded(digest: str, path: str) -> tuple[str, str]:
    """The root that ``digest`` and its path give, and the siblings of the path in order."""
    at, siblings = 0, []
    while at < len(path):
        slot, others = int(path[at]), int(path[at + 1])
        beside = path[at + 2 : at + 2 + others * WIDE]
        digest = hashed((beside[: slot * WIDE], digest, beside[slot * WIDE :]))
        siblings.append(beside)
        at += 2 + others * WIDE
    return digest, "".join(siblings)


def _up(levels: int):
    def up(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        tree = reduced(nodes.sort_values("pos")["digest"].tolist(), levels, bool(nodes["alone"].iloc[0]))
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-int(nodes["n"].iloc[0]) // ARITY**levels)], "digest": tree[-1]})

    return up


def _down(levels: int):
    def down(key: tuple, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        tree = reduced(nodes["digest"].tolist(), levels, bool(nodes["alone"].iloc[0]))
        return pd.DataFrame({"tree": key[0], "pos": nodes["pos"], "path": paths(tree, outer["path"].iloc[0])})

    return down


def _proved(levels: int, names: list[str]):
    """Proofs and folded roots of the leaves of one superblock."""

    def proved(key: tuple, leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("pos")
        digests = leaves["digest"].tolist()
        tree = reduced(digests, levels, bool(leaves["alone"].iloc[0]))
        claims = leaves["claim"].tolist()
        got = [folded(d if c is None else c, p) for d, c, p in zip(digests, claims, paths(tree, outer["path"].iloc[0]))]
        return leaves[names].assign(
            leaf=digests,
            subroot=outer["subroot"].iloc[0],
            proof=[bytes.fromhex(s) for _, s in got],
            folded_root=[r for r, _ in got],
        )

    return proved


class Trees:
    """Rounds of reduction over ``(tree, pos, n, digest)`` rows and back down again.

    ``n`` is the number of nodes of the row's tree. A round leaves one node for each superblock
    of the round before, so rounds grow with the logarithm of the largest tree.
    """

    def __init__(self, nodes: DataFrame, scratch: Scratch, levels: int):
        self.scratch, self.levels, self.rounds = scratch, levels, []
        schema = "tree bigint, pos bigint, n bigint, digest string"
        while True:
            self.rounds.append(nodes)
            nodes = scratch.save(_blocked(nodes, levels).groupBy("tree", "block").applyInPandas(_up(levels), schema))
            if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
                break
        self.tops = nodes.select("tree", "digest")

    def outer(self, above: DataFrame) -> DataFrame:
        """``(tree, pos, path)`` of the superblocks of the first round; ``above`` has that of each top."""
        return self._descend(above, self.rounds[:0:-1])

    def all_paths(self, above: DataFrame) -> DataFrame:
        """``(tree, pos, path)`` of every row given."""
        return self._descend(above, self.rounds[::-1])

    def _descend(self, above: DataFrame, rounds: list[DataFrame]) -> DataFrame:
        for nodes in rounds:
            above = self.scratch.save(
                _blocked(nodes, self.levels)
                .groupBy("tree", "block")
                .cogroup(above.groupBy("tree", "pos"))
                .applyInPandas(_down(self.levels), "tree bigint, pos bigint, path string")
            )
        return above


def _blocked(nodes: DataFrame, levels: int) -> DataFrame:
    width = ARITY**levels
    return nodes.withColumn("block", F.expr(f"pos div {width}")).withColumn("alone", F.col("n") <= width)


def manifest(
    docs: DataFrame,
    claimed: dict[str, Column] | None = None,
    columns: Sequence[str] = COLUMNS,
    group: str = "source",
    key: str = "doc_id",
    levels: int = LEVELS,
) -> DataFrame:
    """``key, leaf, subroot, root, proof, folded_root`` for every row of ``docs``.

    A leaf digests ``columns``; the leaves of each value of ``group`` ascend by ``key`` and make a
    tree, and the roots of these, ordered by the value (null first, by bytes), make the tree over
    all. ``proof`` has the siblings from the leaf to the root as raw digests. ``folded_root`` is
    what the proof gives for the row as it is claimed: ``claimed`` maps columns to other values,
    and the leaf is digested anew with these; without it every row is claimed as it is.

    A null key comes before all others. Rows with equal keys are ordered by their digests, so rows
    that are alike in ``columns`` are interchangeable and each is a leaf. Null and empty groups are
    groups of their own. Texts of any length are digested whole. Other columns, of whatever name,
    are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    own = {c: F.col(f"`{c}`") for c in columns}
    altered = {c: (claimed or {}).get(c, own[c]) for c in columns}
    changed = F.lit(False)
    for c in claimed or {}:
        changed = changed | ~altered[c].eqNullSafe(own[c])
    leaves = scratch.save(
        docs.select(
            F.col(f"`{key}`").alias("_key"),
            F.col(f"`{group}`").isNotNull().alias("_given"),
            F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("")).alias("_group"),
            leaf_of([own[c] for c in columns]).alias("digest"),
            # Only what differs is digested a second time.
            F.when(changed, leaf_of([altered[c] for c in columns])).alias("claim"),
        )
    )
    placed = global_positions(leaves, ["_given", "_group", "_key", "digest"], name="_at")
    groups = placed.groupBy("_given", "_group").agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    groups = scratch.save(global_positions(groups, ["_given", "_group"], name="tree"))
    known = checked_small(groups)
    if known is None:
        named = split_join(placed, groups, ["_given", "_group"])
    else:
        named = placed.join(known, ["_given", "_group"])
    nodes = scratch.save(
        named.select("tree", (F.col("_at") - F.col("_first")).alias("pos"), "n", "digest", "claim", "_key")
    )
    if nodes.isEmpty():
        empty = F.lit(None).cast("string")
        return nodes.select(
            F.col("_key").alias(key), F.col("digest").alias("leaf"), empty.alias("subroot"), empty.alias("root"),
            F.lit(None).cast("binary").alias("proof"), empty.alias("folded_root"),
        )
    trees = Trees(nodes.select("tree", "pos", "n", "digest"), scratch, levels)
    # The roots of the groups are the leaves of one more tree.
    count = groups.count()
    over = Trees(
        scratch.save(trees.tops.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"), "digest")),
        scratch,
        levels,
    )
    root = over.tops.first()["digest"]
    start = docs.sparkSession.createDataFrame([(-1, 0, "")], "tree bigint, pos bigint, path string")
    above = over.all_paths(start).select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path")
    outer = trees.outer(scratch.save(above)).join(trees.tops.withColumnRenamed("digest", "subroot"), "tree")
    kind = dict(nodes.dtypes)["_key"]
    return (
        _blocked(nodes, levels)
        .groupBy("tree", "block")
        .cogroup(outer.groupBy("tree", "pos"))
        .applyInPandas(
            _proved(levels, ["_key"]),
            f"_key {kind}, leaf string, subroot string, proof binary, folded_root string",
        )
        .select(F.col("_key").alias(key), "leaf", "subroot", F.lit(root).alias("root"), "proof", "folded_root")
    )


def digest_columns(made: DataFrame) -> DataFrame:
    """The manifest with its proof as one digest and with ``verified``."""
    return made.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
