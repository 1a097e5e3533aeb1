"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is a queue of its documents in seeded shuffle order, as many times over as a
document may be taken. A document copy leaves its queue at the virtual time "words of the source
up to its end / weight of the source". Copies of all sources are range-sorted by that time and
the mix is what comes before the budget is used up; the copy that crosses it counts in part. A
source that has run empty leaves its share to the others, in proportion to their weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import WORD, Scratch
from marginalia.operators.ranking import checked_small, global_positions

WEIGHTS = (5, 2, 1)
SHARE, REPEATS = 1.5, 2


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(seed: int) -> Column:
    """Place of a document in its source; a null id counts as the empty text."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(
        "doc_id",
        F.col("source").isNull().cast("int").alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source"),
        word_count("text").alias("size"),
        shuffle_key(seed).alias("shuffled"),
    )


def source_targets(sized: DataFrame, scratch: Scratch, weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> DataFrame:
    """``no_source, source, size, weight, rank, target`` for every source.

    ``level`` is the target per unit of weight among sources that can meet it; each round takes
    out those that cannot, until none is above ``repeats`` times its size. A round is one
    aggregate over the table of sources, and there are at most as many as sources.
    """
    totals = sized.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    ranked = global_positions(totals, ["no_source", "source"], name="rank").withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    ranked = scratch.save(ranked)
    limit = F.col("source_size") * repeats
    budget = F.sum("source_size") * F.lit(float(share))
    level, full = 0.0, None
    while True:
        capped = limit.cast("double") <= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.coalesce(budget, F.lit(0.0)).alias("budget"),
            F.coalesce(F.sum(F.when(capped, limit)), F.lit(0)).alias("used"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
            F.count(F.when(capped, 1)).alias("full"),
        ).first()
        if row["open"] is None or (full is not None and row["full"] == full):
            break
        full = row["full"]
        level = (row["budget"] - row["used"]) / row["open"]
    return ranked.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight")))


def _beside(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Source columns beside each row: broadcast when few, else a shuffle that can be split."""
    small = checked_small(sources)
    return rows.join(sources if small is None else small, ["no_source", "source"])


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Each document of ``docs`` with what the mix takes of it.

    Gives ``doc_id, source, size, source_size, target, taken, shuffled`` for every row of ``docs``
    (``doc_id``, ``text``, ``source``). A null text has size 0 and nothing is taken of it; null is
    a source of its own, ranked last. Rows that repeat a document are documents of their own.
    Documents with equal ids and sizes in one source are interchangeable. An empty table gives an
    empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.save(_sized(docs, seed))
    sources = scratch.save(source_targets(sized, scratch, weights, share, repeats))
    budget = int((sources.agg(F.sum("source_size")).first()[0] or 0) * share)
    queued = global_positions(
        sized, ["no_source", "source", "shuffled", "doc_id", "size"], weight="size", name="before"
    )
    queued = scratch.save(queued.withColumn("row", F.monotonically_increasing_id()))
    starts = queued.groupBy("no_source", "source").agg(F.min("before").alias("start"))
    rows = _beside(queued, scratch.save(sources.join(starts, ["no_source", "source"])))
    passed = F.col("pass") * F.col("source_size") + F.col("before") - F.col("start") + F.col("size")
    copies = rows.select(
        "row", "rank", "size", "source_size", "before", "start", "weight",
        F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("pass"),
    ).select("row", "rank", "pass", "size", (passed.cast("double") / F.col("weight")).alias("finish"))
    served = global_positions(copies, ["finish", "rank", "pass", "row"], weight="size", name="used")
    taken = served.groupBy("row").agg(
        F.sum(F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - F.col("used")))).alias("taken")
    )
    return rows.join(taken, "row").select(
        "doc_id",
        F.when(F.col("no_source") == 0, F.col("source")).alias("source"),
        "size",
        "source_size",
        "target",
        F.col("taken").cast("long").alias("taken"),
        "shuffled",
    )


def mixed_documents(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them whole; the columns stay as they are.

    The mix takes a prefix of each source's queue, pass by pass, so the last copy taken of each
    source decides about every row where it lies and no text is moved. Where rows
    repeat an id, size and source, only those at the last place are written, to be counted off.
    Documents without words take no room and stay once.
    """
    scratch = Scratch(docs.sparkSession)
    taken = scratch.save(mix(docs, seed, **how))
    repeats = how.get("repeats", REPEATS)
    place = [F.col("shuffled"), F.coalesce("doc_id", F.lit(0)), F.col("size")]
    whole = F.floor(F.col("taken") / F.col("size"))
    copies = taken.where(F.col("size") > 0).select(
        F.col("source").isNull().cast("int").alias("no_source"), F.coalesce("source", F.lit("")).alias("source"),
        whole.alias("pass"), F.struct(*[c.alias(n) for c, n in zip(place, "abc")]).alias("key"),
    )
    cuts = scratch.save(
        copies.where(F.col("pass") > 0)
        .groupBy("no_source", "source")
        .agg(F.max(F.struct("pass", "key.a", "key.b", "key.c")).alias("cut"))
    )
    # Of rows that share the last place, ids and all, as many are taken as the mix took.
    last = F.struct(*[F.col(f"cut.{n}").alias(n) for n in "abc"])
    quotas = (
        copies.join(cuts, ["no_source", "source"])
        .where(F.col("key") == last)
        .groupBy("no_source", "source")
        .agg(F.count("*").alias("alike"), F.count(F.when(F.col("pass") == F.col("cut.pass"), 1)).alias("quota"))
    )
    cuts = cuts.join(quotas, ["no_source", "source"])
    here = docs.select(
        F.struct("*").alias("_row"),
        F.coalesce("doc_id", F.lit(0)).alias("b"),
        F.col("source").isNull().cast("int").alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source"),
        word_count("text").alias("c"),
        shuffle_key(seed).alias("a"),
    )
    cuts = scratch.save(cuts)
    small = checked_small(cuts)
    beside = here.join(cuts if small is None else small, ["no_source", "source"], "left")
    at = F.struct("a", "b", "c")

    def repeated(rows: DataFrame, within: Column) -> DataFrame:
        full = F.coalesce(F.col("cut.pass"), F.lit(0)) - F.when(within, 0).otherwise(1)
        times = F.when(F.col("c") == 0, 1).otherwise(F.least(F.greatest(full, F.lit(0)), F.lit(repeats)))
        return rows.select("_row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("_copy")).select("_row.*")

    if cuts.where(F.col("quota") < F.col("alike")).isEmpty():
        return repeated(beside, at <= last)
    torn = F.coalesce((F.col("c") > 0) & (at == last) & (F.col("quota") < F.col("alike")), F.lit(False))
    edge = _numbered(beside.where(torn), scratch)
    return repeated(beside.where(~torn), at <= last).unionByName(repeated(edge, F.col("_nth") < F.col("quota")))


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with their number ``_nth`` in their source, in the order in which they are written.

    Rows are numbered inside the parts they were written in; the parts before are added as counts.
    """
    keys = ["no_source", "source"]
    held = scratch.save(rows.withColumn("_place", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_place", 33))
    sizes = held.groupBy(*keys, "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("_part")
    starts = scratch.save(sizes.select(*keys, "_part", (F.sum("n").over(before) - F.col("n")).alias("_start")))
    nth = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_place")) - 1
    return held.withColumn("_nth", nth).join(starts, [*keys, "_part"]).withColumn("_nth", F.col("_nth") + F.col("_start"))
