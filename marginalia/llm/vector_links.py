"""Near-duplicate vectors by an exact metric range join.

Vectors are scaled to length one, where cosine >= c means a distance of at most
``r = sqrt(2 - 2c)``. Each vector lives in the cell of its nearest pivot. If ``u`` lives in cell
``p`` and ``v`` in cell ``q``, a distance of at most ``r`` implies, by the triangle inequality,
that ``v`` is within ``r`` of the ball around ``p``, and that ``v`` is within ``r`` of the plane
half way between the two pivots. A vector is therefore copied only to the cells that pass both
bounds, and each cell is joined for itself. Nothing is left out: the bounds hold for every pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import Forest, Scratch, tidy
from marginalia.llm.graph import components
from marginalia.llm.vectors import finite, pivots, stack, to_pivots, unit
from marginalia.operators.ranking import split_join

#: Vectors in one block of a cell; a larger cell is cut into blocks that are joined pairwise. Between
#: these bounds a block has a 64th of the table, as fewer cells mean fewer copies.
BLOCK, LARGEST_BLOCK = 4096, 1 << 16
#: Vectors whose visits are worked out at a time, copies in one batch, products in one piece.
STEP, EMITTED, PRODUCTS = 512, 4096, 1 << 21
#: Most pivots, and vectors looked at to choose them: the bound of what the driver holds.
PIVOTS, PIVOT_SAMPLE = 1024, 8192
#: Visitors that one copy of a block meets.
VISITORS = 1 << 18
#: Slack for rounding in the bounds; only ever makes more copies.
SLACK = 1e-9


def _widths(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch whose vectors have the same number of components."""
    sizes = batch.column(batch.schema.get_field_index(name)).value_lengths()
    sizes = sizes.to_numpy(zero_copy_only=False)
    for width in np.unique(sizes):
        yield int(width), batch.take(pa.array(np.flatnonzero(sizes == width)))


def _homes(centres: dict[int, np.ndarray]):
    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in _widths(batch, "vec"):
                cell, away = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows)
                if width in centres:
                    gaps = to_pivots(unit(stack(part.column(1), width)), centres[width])
                    cell = gaps.argmin(axis=1).astype(np.int32)
                    away = gaps[np.arange(len(gaps)), cell]
                width_of = pa.array(np.full(part.num_rows, width, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, width_of, pa.array(cell), pa.array(away)],
                    names=[*part.schema.names, "width", "cell", "away"],
                )

    return homes


def _blocks_of(count: int, block: int) -> int:
    return max(1, -(-count // block))


def _visits(centres, reach: dict, blocks: dict, radius: float, slots: int):
    """Copies of each vector: its home block, and every block that it has to visit.

    Of two cells (or blocks of a cell) one is visited by the other, by turns, so that no block
    has to meet all others.
    """

    def turn(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """True where members of ``q`` visit ``p``."""
        return np.where((p + q) % 2 == 0, p < q, p > q)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            for width, part in _widths(batch, "vec"):
                for first in range(0, part.num_rows, STEP):
                    yield width, part.slice(first, STEP)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between: dict[int, np.ndarray] = {}
        for width, part in steps(batches):
            at = part.schema.get_field_index
            cell = part.column(at("cell")).to_numpy(zero_copy_only=False)
            rep = part.column(at("rep")).to_numpy(zero_copy_only=False)
            cells = max((c for w, c in blocks if w == width), default=0) + 1
            parts = np.array([blocks.get((width, c), 1) for c in range(cells)])
            chunk = (rep * 2654435761 & 0x7FFFFFFF) % parts[cell]
            row, to = [], []
            reached = np.zeros((part.num_rows, cells), bool)
            if width in centres:
                middle = centres[width]
                gaps = to_pivots(unit(stack(part.column(at("vec")), width)), middle)[:, :cells]
                own = gaps[np.arange(len(gaps)), cell]
                far = np.array([reach.get((width, c), -math.inf) for c in range(cells)])
                if width not in between:
                    between[width] = np.maximum(to_pivots(middle, middle)[:, :cells], SLACK)
                apart = between[width][cell]
                plane = (gaps**2 - own[:, None] ** 2) / (2 * apart)
                reached = (gaps <= far + radius + SLACK) & (plane <= radius + SLACK)
                reached &= turn(np.arange(cells)[None], cell[:, None])
            for c in range(cells):
                inside = np.flatnonzero(reached[:, c])
                for k in range(parts[c]):
                    row.append(inside)
                    to.append(np.full(len(inside), (c << 20) + k))
                mine = np.flatnonzero(cell == c)
                for k in range(parts[c]):
                    some = mine[turn(np.full(len(mine), k), chunk[mine])] if parts[c] > 1 else mine[:0]
                    row.append(some)
                    to.append(np.full(len(some), (c << 20) + k))
            row, to = np.concatenate(row), np.concatenate(to)
            slot = (rep[row] * 40503 & 0x7FFFFFFF) % slots
            home = np.arange(part.num_rows)
            for s in range(slots):
                yield _copies(part, width, home, (cell.astype(np.int64) << 20) + chunk, np.full(len(home), s), False)
            for a in range(0, len(row), EMITTED):
                some = slice(a, a + EMITTED)
                yield _copies(part, width, row[some], to[some], slot[some], True)

    return visits


def _copies(part, width, row, to, slot, visitor) -> pa.RecordBatch:
    picked = part.select(["rep", "copies", "vec"]).take(pa.array(row))
    block = pa.array((np.int64(width) << 40) + to.astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [block, pa.array(slot.astype(np.int32)), pa.array(np.full(len(row), visitor)), *picked.columns],
        names=["block", "slot", "visitor", *picked.schema.names],
    )


def _joined(threshold: float):
    """Links inside a sorted stream of blocks: home vectors first, then their visitors.

    Gives ``(rep, other, n)``: a link of the spanning forest with ``n`` null, or, with ``other``
    null, how many rows ``rep`` links to here.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, home = None, None
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)]
            change = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0) | (np.diff(keys[2].astype(int)) != 0))
            edges = [0, *(change + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                block, slot, visitor = (k[a] for k in keys)
                width = int(block >> 40)
                got = (
                    piece.column(3).to_numpy(zero_copy_only=False),
                    piece.column(4).to_numpy(zero_copy_only=False),
                    unit(stack(piece.column(5), width)),
                )
                if (block, slot) != now:
                    now, home = (block, slot), None
                if visitor:
                    if home is not None:
                        yield from matches(got, home, False)
                    continue
                # Links among home vectors are counted in slot 0 only; other slots repeat them.
                if slot == 0:
                    if home is not None:
                        yield from matches(got, home, False)
                    yield from matches(got, got, True)
                home = got if home is None else tuple(np.concatenate(x) for x in zip(home, got))

    def matches(left, right, same: bool) -> Iterator[pa.RecordBatch]:
        step = max(16, PRODUCTS // max(1, len(right[0])))
        for at in range(0, len(left[0]), step):
            near = left[2][at : at + step] @ right[2].T >= threshold
            if same:
                near &= np.arange(len(right[0]))[None] > (np.arange(len(near)) + at)[:, None]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            i += at
            reps = np.concatenate([left[0][i], right[0][j]])
            rows = np.concatenate([right[1][j], left[1][i]])
            seen, where = np.unique(reps, return_inverse=True)
            n = np.bincount(where, weights=rows).astype(np.int64)
            half = len(i)
            kept = Forest(len(seen)).link(where[:half], where[half:])
            a, b = (seen[np.array([p[k] for p in kept], np.int64)] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([seen, a])),
                    pa.array(np.concatenate([seen, b]), mask=np.arange(len(seen) + len(a)) < len(seen)),
                    pa.array(np.concatenate([n, np.zeros(len(a), np.int64)])),
                ],
                names=["rep", "other", "n"],
            )

    return joined


def vector_groups(
    rows: DataFrame,
    threshold: float = 0.9,
    block: int | None = None,
    max_pivots: int = PIVOTS,
    visitors: int = VISITORS,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``rows`` (``vec_id``, ``embedding``).

    Rows with cosine >= ``threshold`` are linked; ``n_links`` counts the other rows a row is
    linked to, ``component_id`` is the smallest id reachable, ``kept`` marks it. Vectors that are
    null, empty, zero, or hold null or non-finite parts link with nothing and stay as their own
    component; so do those of a length no other vector has. Equal vectors are joined once, with
    the number of their rows, so a vector that fills a third of the table costs one row. Rows
    that repeat an id count as different rows; a row with a null id has a null component unless
    it reaches a row with an id, and is never ``kept``. Other columns are ignored.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    base = rows.select("vec_id", F.col("embedding").alias("vec"))
    fit = finite("vec") & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    reps = scratch.save(
        base.where(fit)
        .groupBy("vec")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .select(F.monotonically_increasing_id().alias("rep"), "vec", "copies", "least")
    )
    n = reps.count()
    block = block or min(max(BLOCK, n // 64), LARGEST_BLOCK)
    centres = pivots(reps, "vec", min(max_pivots, _blocks_of(n, block)), PIVOT_SAMPLE) if n else {}
    homes = scratch.save(
        reps.select("rep", "vec", "copies").mapInArrow(
            tidy(_homes(centres)), f"rep bigint, vec {dict(reps.dtypes)['vec']}, copies bigint, width int, cell int, away double"
        )
    )
    cells = homes.groupBy("width", "cell").agg(F.count("*").alias("n"), F.max("away").alias("reach")).collect()
    reach = {(c["width"], c["cell"]): c["reach"] for c in cells}
    blocks = {(c["width"], c["cell"]): _blocks_of(c["n"], block) for c in cells}
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    dealt = (
        homes.drop("away")
        .mapInArrow(
            tidy(_visits(centres, reach, blocks, radius, _blocks_of(n, visitors))),
            f"block bigint, slot int, visitor boolean, rep bigint, copies bigint, vec {dict(reps.dtypes)['vec']}",
        )
        .repartition("block", "slot")
        .sortWithinPartitions("block", "slot", "visitor")
    )
    found = scratch.save(dealt.mapInArrow(tidy(_joined(threshold)), "rep bigint, other bigint, n bigint"))
    links = found.where(F.col("other").isNotNull()).select(F.col("rep").alias("a"), F.col("other").alias("b"))
    counts = found.where(F.col("other").isNull()).groupBy("rep").agg(F.sum("n").alias("n"))
    root = components(links, scratch).withColumnRenamed("node", "rep")
    joined = (
        reps.join(counts, "rep", "left")
        .join(root, "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    joined = scratch.save(joined.select("vec", "copies", "least", "n", "component"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    per_vec = split_join(joined, least, ["component"]).select(
        "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    return (
        split_join(base.withColumn("vec", F.when(fit, F.col("vec"))), per_vec, ["vec"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
