"""Exact top-k by inner product with two cover trees.

Vectors are scaled to whole numbers. Candidates are dealt into cells around pivots and each cell
into blocks of bounded size; queries are dealt into groups by the same pivots. A block and a group
are indexed by a cover tree each: every node has a centre that is one of its points and the
covering radius of all points below it, children split a node around points that are far from
each other. For nodes with centres ``q``, ``c`` and radii ``s``, ``r`` no pair scores more than
``q.c + |q| r + |c| s + s r``; a pair of nodes whose bound is below the worst k-th score among the
node's queries is dropped as a whole.

Queries first search the blocks of their own cell. The scores found there prune the cells with
the same bound before anything is sent to them, and go along as the starting scores of the
second search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import Scratch, tidy
from marginalia.llm.vectors import finite, pivots, stack, to_pivots

#: Candidates in a block, queries that one copy of a block meets, points in a leaf, children.
BLOCK, QUERIES, LEAF, FANOUT = 4096, 1 << 16, 256, 16
#: Most pivots and vectors looked at to choose them: the bound of what the driver holds.
PIVOTS, PIVOT_SAMPLE = 512, 8192
#: Queries that are sent at a time, and copies in one batch.
STEP, EMITTED = 256, 4096
#: Rounding of bounds, as a share of the products they are made of.
SLACK = 1e-9
#: Below this size products of whole numbers are exact in doubles; scores are below ``LARGEST``. ``NOTHING`` is no score.
EXACT, LARGEST, NOTHING = float(1 << 52), float(1 << 62), -(1 << 63) + 1


class CoverTree:
    """Points under nodes with a centre, a covering radius and children or a leaf of rows."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.norms = np.sqrt((points**2).sum(axis=1))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        self.root = self._grow(np.arange(len(points)), 0)

    def _away(self, rows: np.ndarray, centre: int) -> np.ndarray:
        gap = self.points[rows] - self.points[centre]
        return np.sqrt((gap * gap).sum(axis=1))

    def _grow(self, rows: np.ndarray, centre: int) -> int:
        away = self._away(rows, centre)
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(away.max()))
        self.children.append([])
        self.rows.append(rows)
        if len(rows) <= LEAF or self.radius[node] == 0:
            return node
        # The centre goes down as a child of its own; others are added where points are farthest.
        chosen, near, best = [centre], np.zeros(len(rows), np.int64), away
        while len(chosen) < FANOUT and best.max() > self.radius[node] / 2:
            nxt = int(rows[best.argmax()])
            gap = self._away(rows, nxt)
            closer = gap < best
            near[closer], best = len(chosen), np.minimum(best, gap)
            chosen.append(nxt)
        if len(chosen) == 1:
            return node
        self.children[node] = [self._grow(rows[near == i], c) for i, c in enumerate(chosen)]
        return node


def dual_search(
    queries: CoverTree, own: np.ndarray, data: CoverTree, ids: np.ndarray, rows: np.ndarray, k: int, floor: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of a block for every query: ``(score, id, row)`` arrays of ``k`` columns.

    ``own`` and ``rows`` say which candidate row is the query itself. ``floor`` is a score that
    ``k`` candidates elsewhere reach already; only what is at least as good is looked for. Free
    places have row -1. Scores are whole numbers: where they may be too large for doubles they are summed up as integers.
    """
    n = len(queries.points)
    score = np.full((n, k), NOTHING, np.int64)
    ident = np.full((n, k), np.iinfo(np.int64).max)
    place = np.full((n, k), -1, np.int64)

    def worst(node: int) -> int:
        q = queries.rows[node]
        return int(np.maximum(score[q, k - 1], floor[q]).min())

    def bound(a: int, b: int) -> float:
        qa, cb = queries.centre[a], data.centre[b]
        s, r = queries.radius[a], data.radius[b]
        mid = float(queries.points[qa] @ data.points[cb])
        size = (queries.norms[qa] + s) * (data.norms[cb] + r)
        return mid + queries.norms[qa] * r + data.norms[cb] * s + s * r + SLACK * (1 + size)

    def leaves(a: int, b: int) -> None:
        q, c = queries.rows[a], data.rows[b]
        if queries.norms[q].max() * data.norms[c].max() < EXACT:
            s = (queries.points[q] @ data.points[c].T).astype(np.int64)
        else:
            s = queries.points[q].astype(np.int64) @ data.points[c].astype(np.int64).T
        s[own[q][:, None] == rows[c][None]] = NOTHING
        # What can enter is as good as the k-th so far and as the k-th of this leaf, ties included.
        least = np.maximum(score[q, k - 1], floor[q])
        if len(c) > k and np.count_nonzero(s >= least[:, None]) > 4 * k * len(q):
            least = np.maximum(least, -np.partition(-s, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((s >= least[:, None]) & (s > NOTHING))
        if not len(i):
            return
        touched = np.unique(i)
        old = q[touched]
        which = np.concatenate([np.repeat(old, k), q[i]])
        scores = np.concatenate([score[old].ravel(), s[i, j]])
        idents = np.concatenate([ident[old].ravel(), ids[c[j]]])
        places = np.concatenate([place[old].ravel(), rows[c[j]]])
        order = np.lexsort((idents, -scores, which))
        which = which[order]
        rank = np.arange(len(which)) - np.searchsorted(which, which)
        best = order[rank < k]
        at, rank = which[rank < k], rank[rank < k]
        score[at, rank], ident[at, rank], place[at, rank] = scores[best], idents[best], places[best]

    stack_ = [(bound(queries.root, data.root), queries.root, data.root)]
    while stack_:
        most, a, b = stack_.pop()
        if most < worst(a):
            continue
        split_q, split_c = queries.children[a], data.children[b]
        if not split_q and not split_c:
            leaves(a, b)
            continue
        if split_c and (not split_q or data.radius[b] >= queries.radius[a]):
            pairs = [(a, x) for x in split_c]
        else:
            pairs = [(x, b) for x in split_q]
        # The most promising pair is on top and raises the scores for the others.
        stack_ += sorted((bound(x, y), x, y) for x, y in pairs)
    return score, ident, place


def _dealt(centres: dict[int, np.ndarray]):
    """Width, nearest pivot and distance to it for every vector."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(batch.schema.get_field_index("vec"))
            sizes = vec.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == width)))
                points = stack(part.column(part.schema.get_field_index("vec")), int(width))
                cell, away = np.zeros(len(points), np.int32), np.sqrt((points**2).sum(axis=1))
                if int(width) in centres:
                    gaps = to_pivots(points, centres[int(width)])
                    cell = gaps.argmin(axis=1).astype(np.int32)
                    away = np.sqrt(((points - centres[int(width)][cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(len(points), width, np.int32)), pa.array(cell), pa.array(away)],
                    names=[*part.schema.names, "width", "cell", "away"],
                )

    return dealt


def _sent(centres, cells: dict, blocks: dict, first: bool):
    """A copy of each query for every block it has to search.

    In the first search these are the blocks of its own cell. In the second they are those of all
    other cells whose best possible score reaches the query's k-th score so far.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(start, STEP) for b in batches for start in range(0, b.num_rows, STEP)):
            at = batch.schema.get_field_index
            width = batch.column(at("width")).to_numpy(zero_copy_only=False)
            cell = batch.column(at("cell")).to_numpy(zero_copy_only=False)
            floor = batch.column(at("floor")).to_numpy(zero_copy_only=False)
            row, to = [], []
            for w in np.unique(width):
                mine = np.flatnonzero(width == w)
                reach = np.zeros((len(mine), 1 + max((c for x, c in blocks if x == w), default=0)), bool)
                if first:
                    reach[np.arange(len(mine)), np.minimum(cell[mine], reach.shape[1] - 1)] = True
                else:
                    points = stack(batch.column(at("vec")).take(pa.array(mine)), int(w))
                    norms = np.sqrt((points**2).sum(axis=1))
                    for c in range(reach.shape[1]):
                        far = cells.get((w, c))
                        if far is None:
                            continue
                        middle = centres[w][c] if w in centres else np.zeros(points.shape[1])
                        slack = SLACK * (1 + norms * (np.sqrt((middle**2).sum()) + far))
                        reach[:, c] = (points @ middle + norms * far + slack >= floor[mine]) & (cell[mine] != c)
                for c in range(reach.shape[1]):
                    inside = mine[reach[:, c]]
                    for b in range(blocks.get((w, c), 0)):
                        row.append(inside)
                        to.append(np.full(len(inside), (int(w) << 40) + (c << 20) + b, np.int64))
            if not row:
                continue
            row, to = np.concatenate(row), np.concatenate(to)
            for start in range(0, len(row), EMITTED):
                some = slice(start, start + EMITTED)
                picked = batch.select(["row", "vec_id", "vec", "floor"]).take(pa.array(row[some]))
                yield pa.RecordBatch.from_arrays([pa.array(to[some]), *picked.columns], names=["block", *picked.schema.names])

    return sent


def _searched(k: int):
    """Searches a sorted stream of blocks: candidates first, then the queries sent to them."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, home, tree, waiting = None, [], None, []

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal tree, waiting
            if not waiting or not home:
                waiting = []
                return
            rows, ids, points = (np.concatenate(x) for x in zip(*home))
            if tree is None:
                tree = CoverTree(points)
            q_rows, q_ids, q_points, floor = (np.concatenate(x) for x in zip(*waiting))
            waiting = []
            score, ident, place = dual_search(CoverTree(q_points), q_rows, tree, ids, rows, k, floor)
            i, j = np.nonzero((place >= 0) & (score >= floor[:, None]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(q_rows[i]), pa.array(q_ids[i]), pa.array(place[i, j]), pa.array(ident[i, j]),
                    pa.array(score[i, j]),
                ],
                names=["row", "query_id", "found", "vec_id", "score"],
            )

        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)]
            change = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0) | (np.diff(keys[2].astype(int)) != 0))
            edges = [0, *(change + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                block, slot, query = (x[a] for x in keys)
                if (block, slot) != now:
                    yield from answers()
                    now, home, tree = (block, slot), [], None
                got = [piece.column(i).to_numpy(zero_copy_only=False) for i in (3, 4)]
                points = stack(piece.column(5), int(block >> 40))
                if query:
                    waiting.append((*got, points, piece.column(6).to_numpy(zero_copy_only=False)))
                    if sum(len(x[0]) for x in waiting) >= 1024:
                        yield from answers()
                else:
                    home.append((*got, points))
        yield from answers()

    return searched


def top_inner(
    rows: DataFrame,
    is_query,
    k: int = 5,
    scale: int = 256,
    block: int = BLOCK,
    max_pivots: int = PIVOTS,
    group: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its ``k`` best other rows.

    Components become ``floor(scale * x)``; the score is the inner product of those, ties go to
    the smaller ``vec_id``. ``is_query`` is a condition on the rows. Vectors that are null, empty,
    or hold null or non-finite parts take no part; vectors of different length do not meet. A row
    is never its own result, rows that repeat an id are rows of their own, and a null ``vec_id``
    counts as larger than all others. Scores are exact whole numbers; those of 2^62 or more in size do not fit, and where
    the longest query and the longest vector allow one the job stops. An empty table gives an empty result.
    """
    scratch = Scratch(rows.sparkSession)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    base = scratch.save(
        rows.where(finite("embedding")).select(
            F.monotonically_increasing_id().alias("row"),
            F.coalesce("vec_id", F.lit((1 << 63) - 1)).alias("vec_id"),
            whole.alias("vec"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        )
    )
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    size = base.agg(
        F.count("*").alias("n"), F.max(length).alias("longest"), F.max(F.when(F.col("asks"), length)).alias("asking")
    ).first()
    n = size["n"]
    if n and size["longest"] * (size["asking"] or 0.0) >= LARGEST:
        raise ValueError("inner products of these vectors do not fit into 64 bits")
    centres = pivots(base, "vec", min(max_pivots, max(1, -(-n // block))), PIVOT_SAMPLE, shape=lambda x: x) if n else {}
    dealt = scratch.save(
        base.mapInArrow(
            tidy(_dealt(centres)),
            "row bigint, vec_id bigint, vec array<double>, asks boolean, width int, cell int, away double",
        )
    )
    stats = dealt.groupBy("width", "cell").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect()
    cells = {(s["width"], s["cell"]): s["far"] for s in stats}
    blocks = {(s["width"], s["cell"]): max(1, -(-s["n"] // block)) for s in stats}
    asked = max(1, -(-dealt.where("asks").count() // group))
    parts = F.lit(1)
    for (w, c), b in blocks.items():
        if b > 1:
            parts = F.when((F.col("width") == w) & (F.col("cell") == c), b).otherwise(parts)
    home_block = F.expr("(CAST(width AS BIGINT) << 40) + (CAST(cell AS BIGINT) << 20)") + F.pmod(
        F.xxhash64("row"), parts.cast("long")
    )
    homes = dealt.select(
        home_block.alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("slot"),
        F.lit(False).alias("query"), "row", "vec_id", "vec", F.lit(NOTHING).alias("floor"),
    )

    def search(asking: DataFrame, first: bool) -> DataFrame:
        sent = asking.mapInArrow(
            tidy(_sent(centres, cells, blocks, first)), "block bigint, row bigint, vec_id bigint, vec array<double>, floor bigint"
        ).select("block", F.pmod(F.xxhash64("row"), F.lit(asked)).cast("int").alias("slot"), F.lit(True).alias("query"),
                 "row", "vec_id", "vec", "floor")
        return (
            homes.unionByName(sent)
            .repartition("block", "slot")
            .sortWithinPartitions("block", "slot", "query")
            .mapInArrow(tidy(_searched(k)), "row bigint, query_id bigint, found bigint, vec_id bigint, score bigint")
        )

    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "found")

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    asking = dealt.where("asks").select("row", "vec_id", "vec", "width", "cell")
    near = scratch.save(ranked(search(asking.withColumn("floor", F.lit(NOTHING)), True)))
    kth = near.where(F.col("rank") == k).select("row", F.col("score").alias("floor"))
    later = asking.join(kth, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(NOTHING)))
    found = near.drop("rank").unionByName(search(later, False))
    null_id = F.lit((1 << 63) - 1)
    return ranked(found).select(
        F.nullif("query_id", null_id).alias("query_id"),
        "rank",
        F.nullif("vec_id", null_id).alias("vec_id"),
        "score",
    )
