"""Joins and rankings that stay even when one key holds a large share of the rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest number of rows that is ever brought to the driver to become a broadcast table.
SMALL_ROWS = 10_000


def constant_array(values: list, kind: str) -> Column:
    """A literal array built from text in one call, however long it is."""
    cells = ", ".join("NULL" if v is None else repr(v) for v in values)
    return F.expr(f"CAST(ARRAY({cells}) AS ARRAY<{kind}>)")


def ready_checkpoints(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a local session may get its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            # Only a session that runs in this one process may use a folder of this machine.
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read again.

    Unlike a checkpoint this evaluates ``df`` once, and readers take only the columns they use.
    """
    spark = df.sparkSession
    path = f"{ready_checkpoints(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame | None:
    """``df`` as a broadcast table when it has at most ``max_rows`` rows, else None."""
    found = df.limit(max_rows + 1).toArrow()
    if found.num_rows > max_rows:
        return None
    local = df.sparkSession.createDataFrame(found, schema=df.schema)
    return F.broadcast(local)


def hot_keys(rows: DataFrame, key: list[str], tasks: int) -> DataFrame:
    """``key, salts`` of the keys that hold more than an even share of ``rows`` over ``tasks`` tasks.

    There are fewer than ``tasks`` such keys, however many keys there are, and they are among the
    ``tasks`` largest; only these come to the driver. ``salts`` says over how many parts a key
    has to be dealt to have an even share in each. Counts are aggregated before they move, and
    the total is observed in the same job.
    """
    every = Observation()
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n")).observe(every, F.sum("_n").alias("n"))
    most = counts.orderBy(F.desc("_n")).limit(tasks).toArrow()
    share = max(1.0, (every.get["n"] or 0) / tasks)
    schema = rows.select(*key, F.lit(0).cast("long").alias("_n")).schema
    held = rows.sparkSession.createDataFrame(most, schema=T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
    return held.where(F.col("_n") > share).select(*key, F.ceil(F.col("_n") / F.lit(share)).cast("int").alias("salts"))


def split_join(
    rows: DataFrame, other: DataFrame, key: list[str], how: str = "inner", null_safe: bool = False, hot: DataFrame | None = None
) -> DataFrame:
    """``rows`` joined with ``other`` on ``key``, with hot keys dealt over many tasks.

    Keys with more than an even share of ``rows`` are counted first, unless ``hot`` tells them as
    ``hot_keys`` does. Their rows get a salt, and the rows of ``other`` with these keys are repeated
    once for each salt; all others have salt 0. So one shuffle by key and salt is even for any
    partition count and does not rest on adaptive execution. ``how`` is ``inner``, ``left``,
    ``left_semi`` or ``left_anti``. A null key meets a null key only if ``null_safe``.

    The table of hot keys has fewer rows than there are shuffle partitions and is broadcast.
    ``rows`` is evaluated twice, and should come from files with narrow steps, so that a task that
    is run again deals its rows as before. Equal rows are dealt apart like others. The output has
    the key columns first, then the rest of ``rows`` and of ``other``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} joins are not split")
    if hot is None:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hot = hot_keys(rows, key, tasks)
    names = [f"_k{i}" for i in range(len(key))]
    hot = hot.select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col("salts").alias("_salts"))

    def marked(df: DataFrame) -> DataFrame:
        same = F.lit(True)
        for k, n in zip(key, names):
            same = same & df[k].eqNullSafe(F.col(n))
        return df.join(F.broadcast(hot), same, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1))).drop(*names)

    place = F.pmod(F.monotonically_increasing_id(), F.col("_salts").cast("long")).cast("int")
    dealt = marked(rows).withColumn("_salt", place).drop("_salts")
    repeated = marked(other).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    rest = [] if how in ("left_semi", "left_anti") else [c for c in other.columns if c not in key]
    held = repeated.select("_s", *[F.col(k).alias(n) for k, n in zip(key, names)], *rest)
    same = dealt["_salt"] == held["_s"]
    for k, n in zip(key, names):
        same = same & (dealt[k].eqNullSafe(held[n]) if null_safe else dealt[k] == held[n])
    # Merge keeps the sides from being turned into a broadcast that was never counted.
    joined = dealt.join(held.hint("merge"), same, how)
    return joined.select(*key, *[c for c in rows.columns if c not in key], *rest)


def attach(
    rows: DataFrame,
    per_key: DataFrame,
    key: list[str],
    count: str,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Join a one-row-per-key table back to the rows it was computed from.

    ``per_key[count]`` says how many rows each key has. The table is broadcast when it was
    counted to be small. Otherwise both sides are shuffled, and a key that holds more than an even
    share of the rows is dealt over many tasks. A null key meets the null key of ``per_key``.
    The output has the columns of both sides except ``count``.
    """
    per_key = written(per_key)
    small = checked_small(per_key, small_rows)
    if small is None:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        share = max(1.0, (per_key.agg(F.sum(count)).first()[0] or 0) / tasks)
        hot = per_key.where(F.col(count) > share).select(*key, F.ceil(F.col(count) / F.lit(share)).cast("int").alias("salts"))
        found = split_join(rows, per_key.drop(count), key, "left", null_safe=True, hot=hot)
        return found.select(*rows.columns, *[c for c in per_key.columns if c not in (*key, count)])
    other = small.drop(count)
    named = other.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)],
        *[F.col(c) for c in other.columns if c not in key],
    )
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & rows[k].eqNullSafe(F.col(f"_key{i}"))
    return rows.join(F.broadcast(named), same, "left").drop(*[f"_key{i}" for i in range(len(key))])


def global_positions(
    df: DataFrame, order: list[str], weight: str | None = None, name: str = "position"
) -> DataFrame:
    """Add the 0-based position of every row in the global order of ``order``.

    With ``weight`` (a long column) the position is the summed weight of all earlier rows.
    Rows are range-partitioned and sorted; each row's place inside its partition plus the
    total of the partitions before it gives the position, so no task sees the whole table.
    The driver only holds one number per partition.
    """
    place = "_place"
    ranged = (
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn(place, F.monotonically_increasing_id())
    )
    ranged = written(ranged)
    part = F.shiftright(place, 33)
    if weight is None:
        local = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
        sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    else:
        before = Window.partitionBy(part).orderBy(place)
        local = F.sum(weight).over(before) - F.col(weight)
        sizes = ranged.groupBy(part.alias("part")).agg(F.sum(weight).alias("size"))
    by_part = sorted((r["part"], r["size"]) for r in sizes.collect())
    if not by_part:
        return ranged.withColumn(name, F.lit(0).cast("long")).drop(place)
    # One entry per partition number, empty partitions included, so a lookup is an index.
    size_of = dict(by_part)
    filled = [size_of.get(p, 0) for p in range(by_part[-1][0] + 1)]
    starts = list(accumulate(filled, initial=0))[:-1]
    offset = F.get(constant_array(starts, "bigint"), part.cast("int"))
    return ranged.withColumn(name, (local + offset).cast("long")).drop(place)


def _quota_column(quotas: dict[tuple, int], by: list[str]) -> Column:
    out = F.lit(None).cast("long")
    for key, quota in quotas.items():
        match = F.lit(True)
        for c, v in zip(by, key):
            match = match & F.col(c).eqNullSafe(F.lit(v))
        out = F.when(match, F.lit(quota).cast("long")).otherwise(out)
    return out


def take_smallest(
    df: DataFrame,
    by: list[str],
    order: str,
    quota: int | dict[tuple, int] | Callable[[int], int],
    digits: int = 4,
    small_groups: int = SMALL_ROWS,
) -> DataFrame:
    """Keep, in each group, the ``quota`` rows with the smallest hex digest in ``order``.

    Equal digests are ordered by a hash of the whole row, so the choice does not depend on
    partitions; rows that are alike in all columns are interchangeable. The input is evaluated
    twice. The first time only group, digest and row hash are written; counts per digest prefix
    find the prefix in which each group's cut lies, and the rows of that prefix, summed up by
    digest, find the cut itself. The second time one filter keeps what is up to the cut, and no
    row moves. A null digest comes first. Of a group whose cut goes through
    alike rows, one is repeated as often as needed.
    A ``quota`` given as a dict is for the groups it names, other groups being kept whole; a
    function gets the number of all rows.
    """
    row_hash = F.xxhash64(*df.columns)
    keys = written(df.select(*by, F.coalesce(order, F.lit("")).alias("_o"), row_hash.alias("_t")))
    prefix = F.substring("_o", 1, digits)
    hist = keys.groupBy(*by, prefix.alias("_p")).agg(F.count("*").alias("_c"))
    if callable(quota):
        quota = quota(keys.count())
    limit = F.lit(quota).cast("long") if isinstance(quota, int) else _quota_column(quota, by)

    def crossing(counts: DataFrame, *place: str) -> DataFrame:
        """Per group the row of ``counts`` in which the running count goes beyond ``_need``."""
        upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
        return (
            counts.withColumn("_upto", upto)
            .where((F.col("_upto") > F.col("_need")) & (F.col("_upto") - F.col("_c") <= F.col("_need")))
            .groupBy(*by)
            .agg(F.min(F.struct(*place, (F.col("_need") - (F.col("_upto") - F.col("_c"))).alias("need"), "_c")).alias("_cut"))
        )

    # At most 16^digits prefixes of a group meet in one window, and then those of one prefix.
    near = written(crossing(hist.withColumn("_need", limit), "_p").where("_cut IS NOT NULL"))
    edge = _with_cut(keys, near, by, small_groups, "inner").where(prefix == F.col("_cut._p"))
    edge = edge.groupBy(*by, "_o", "_t").agg(F.count("*").alias("_c"), F.min("_cut.need").alias("_need"))
    cuts = written(crossing(edge, "_o", "_t"))
    marked = _with_cut(df, cuts, by, small_groups, "left")
    place = F.struct(F.coalesce(F.col(order), F.lit("")).alias("_o"), row_hash.alias("_t"))
    cut = F.struct("_cut._o", "_cut._t")
    kept = marked.where(F.col("_cut").isNull() | (place < cut)).drop("_cut")
    if cuts.where("_cut.need > 0").isEmpty():
        return kept
    alike = (
        marked.where((place == cut) & (F.col("_cut.need") > 0))
        .groupBy(*by)
        .agg(F.first(F.struct(*df.columns)).alias("_row"), F.first("_cut.need").alias("_n"))
        .select(F.explode(F.array_repeat("_row", F.col("_n").cast("int"))).alias("_row"))
        .select("_row.*")
    )
    return kept.unionByName(alike)


def _with_cut(df: DataFrame, cuts: DataFrame, by: list[str], small_groups: int, how: str) -> DataFrame:
    """``_cut`` of each row's group: broadcast when few, else a shuffle that can be split."""
    small = checked_small(cuts, small_groups)
    other = cuts if small is None else small
    other = other.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_cut")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & df[c].eqNullSafe(F.col(f"_by{i}"))
    if small is not None:
        other = F.broadcast(other)
    return df.join(other, same, how).drop(*[f"_by{i}" for i in range(len(by))])


def value_positions(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with ``first`` and ``after``: the ranks each one covers."""
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(value).alias("value"))
        .agg(F.count("*").alias("copies"))
    )
    return global_positions(counted, ["value"], weight="copies", name="first").withColumn(
        "after", F.col("first") + F.col("copies")
    )


def exact_percentiles(df: DataFrame, value: str, fractions: list[float]) -> DataFrame:
    """Linearly interpolated percentiles as rows ``(fraction, value, n)``.

    Values are counted first and then placed by rank, so memory does not grow with the number
    of distinct values in any task.
    """
    placed = value_positions(df, value)
    n = placed.agg(F.max("after")).first()[0] or 0
    if n == 0:
        raise ValueError(f"no values of {value} to take a percentile of")
    wanted = []
    for f in fractions:
        if not 0.0 <= f <= 1.0:
            raise ValueError(f"fraction {f} is outside 0..1")
        place = f * (n - 1)
        low = int(place)
        wanted.append((f, low, min(low + (place > low), n - 1), place - low))
    asked = F.array(
        *[
            F.struct(
                F.lit(f).alias("fraction"), F.lit(lo).cast("long").alias("lo"),
                F.lit(hi).cast("long").alias("hi"), F.lit(w).alias("w"),
            )
            for f, lo, hi, w in wanted
        ]
    )

    def holds(p: Column) -> Column:
        return (p >= F.col("first")) & (p < F.col("after"))

    return (
        placed.select(
            F.col("value").cast("double").alias("v"),
            F.explode(F.filter(asked, lambda a: holds(a["lo"]) | holds(a["hi"]))).alias("a"),
            "first",
            "after",
        )
        .groupBy(F.col("a.fraction").alias("fraction"), F.col("a.w").alias("w"))
        .agg(
            F.max(F.when(holds(F.col("a.lo")), F.col("v"))).alias("low"),
            F.max(F.when(holds(F.col("a.hi")), F.col("v"))).alias("high"),
        )
        .select(
            "fraction",
            F.when(F.col("w") == 0, F.col("low"))
            .otherwise(F.col("low") * (1 - F.col("w")) + F.col("high") * F.col("w"))
            .alias("value"),
            F.lit(n).cast("long").alias("n"),
        )
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """Put several one-row tables side by side without a cross join."""
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
