"""Planning what to write: quotas, grid cells, profiles, batches, and reading the answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import hashing, neighbours
from marginalia.functions.arrays import bind, with_columns_once
from marginalia.functions.text import mentions, ngrams, shape_fault, strip, tokens
from marginalia.operators.ranking import SMALL_ROWS, attach, checked_small, global_positions, split_join, take_smallest, written
from marginalia.operators.tally import tally
from marginalia.schemas import (
    ERROR_SPECS,
    MEANING_REQS,
    SPECS,
    SPECS_PER_BATCH,
    TEXTS,
    UNKNOWN_PROFILE,
)


def quota_sample(
    df: DataFrame, count: int, seed: int, multiword_share: float = 0.15, **limits: int
) -> DataFrame:
    """``count`` senses with a fixed multiword share; a larger count only adds rows.

    A class that is short hands its quota to the other one.
    """
    if count <= 0:
        return df.limit(0)
    sizes = {r["is_multiword"]: r["n"] for r in
             df.groupBy("is_multiword").agg(F.count("*").alias("n")).collect()}
    multi, single = sizes.get(True, 0), sizes.get(False, 0)
    want_multi = min(multi, round(count * multiword_share))
    want_single = min(single, count - want_multi)
    want_multi = min(multi, count - want_single)
    keyed = df.withColumn("_order", hashing.seeded(seed, F.col("sense_uid")))
    quotas = {(True,): want_multi, (False,): want_single}
    return take_smallest(keyed, ["is_multiword"], "_order", quotas, **limits).drop("_order")


def draw_cells(
    senses: DataFrame,
    k: int = SPECS_PER_BATCH,
    meaning_weights: dict[int, float] | None = None,
    error_weights: dict[str, float] | None = None,
    seed: int = 0,
) -> DataFrame:
    """Draw ``k`` distinct (band, recipe) cells per sense, weighted, as an array in the row.

    Each cell gets an exponential waiting time divided by its weight; the first ``k`` to
    arrive are a weighted draw without replacement. Beyond 25 cells the grid is refilled.
    The draws have the distribution of sequential weighted draws, not the rows of any
    particular random stream.
    """
    mw, ew = meaning_weights or {}, error_weights or {}
    grid = [(m, e, mw.get(m, 1.0) * ew.get(e, 1.0)) for m in MEANING_REQS for e in ERROR_SPECS]
    rounds = -(-k // len(grid))
    cells = F.array(
        *[
            F.struct(
                F.lit(r).alias("round"), F.lit(i).alias("i"), F.lit(m).alias("meaning_req"),
                F.lit(e).alias("error_spec"), F.lit(float(w)).alias("w"),
            )
            for r in range(rounds)
            for i, (m, e, w) in enumerate(grid)
        ]
    )

    def arrival(c: Column) -> Column:
        name = F.concat_ws(
            "|", F.lit(str(seed)), F.col("sense_uid"), c["meaning_req"], c["error_spec"], c["round"]
        )
        waiting = -F.log(hashing.unit_interval(hashing.digest(name)))
        key = F.when(c["w"] > 0, waiting / c["w"]).otherwise(F.lit(float("inf")))
        return F.struct(
            c["round"].alias("round"), key.alias("key"), c["i"].alias("i"),
            c["meaning_req"].alias("meaning_req"), c["error_spec"].alias("error_spec"),
        )

    drawn = F.slice(F.array_sort(F.transform(cells, arrival)), 1, k)
    cells = F.transform(drawn, lambda c: F.struct(c["meaning_req"], c["error_spec"]))
    return with_columns_once(senses, cells=cells)


def draw_profile(
    df: DataFrame, profiles: DataFrame, seed: int, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """Give every drawn cell a profile; near-native ones only from band 3 up.

    Up to ``small_rows`` profiles become a constant. A larger registry is ranked and joined by the
    drawn place; both ways give the same profiles. Senses are unique by ``sense_uid``.
    """

    def drawn_number(meaning: Column, error: Column) -> Column:
        name = F.concat_ws("|", F.lit(f"{seed}|profile"), F.col("sense_uid"), meaning, error)
        return F.conv(F.substring(hashing.digest(name), 1, 13), 16, 10).cast("long")

    known = checked_small(profiles.select("id", "l1"), small_rows)
    if known is None:
        return _profiles_by_join(df, profiles, drawn_number)
    rows = sorted((r["id"], r["l1"]) for r in known.collect())
    everyone = [i for i, _ in rows]
    learners = [i for i, l1 in rows if l1 != "none"] or everyone

    def pick(c: Column) -> Column:
        n = drawn_number(c["meaning_req"], c["error_spec"])

        def of(ids: list[str]) -> Column:
            choice = F.array(*[F.lit(i) for i in ids])
            return F.element_at(choice, (n % len(ids) + 1).cast("int"))

        return F.struct(
            c["meaning_req"].alias("meaning_req"),
            c["error_spec"].alias("error_spec"),
            F.when(c["meaning_req"] >= 3, of(everyone)).otherwise(of(learners)).alias("profile_id"),
        )

    drawn = with_columns_once(df, _with=F.transform("cells", pick))
    return drawn.drop("cells").withColumnRenamed("_with", "cells")


def _profiles_by_join(
    df: DataFrame, profiles: DataFrame, drawn_number: Callable[[Column, Column], Column]
) -> DataFrame:
    ids = profiles.select("id", "l1")
    learning = ids.where(F.col("l1") != "none")
    sizes = [ids.count(), learning.count()]
    if not sizes[1]:
        learning, sizes[1] = ids, sizes[0]
    places = None
    for pool, some in enumerate((ids, learning)):
        ranked = global_positions(some, ["id", "l1"], name="place")
        ranked = ranked.select(F.lit(pool).alias("pool"), "place", F.col("id").alias("profile_id"))
        places = ranked if places is None else places.unionByName(ranked)
    cells = df.select("sense_uid", F.posexplode("cells").alias("at", "c")).select(
        "sense_uid", "at", "c.meaning_req", "c.error_spec"
    )
    pool = F.when(F.col("meaning_req") >= 3, 0).otherwise(1)
    number = drawn_number(F.col("meaning_req"), F.col("error_spec"))
    size = F.when(F.col("pool") == 0, sizes[0]).otherwise(sizes[1])
    made = (
        cells.withColumn("pool", pool)
        .withColumn("place", number % size)
        .join(places, ["pool", "place"])
        .groupBy("sense_uid")
        .agg(F.array_sort(F.collect_list(F.struct("at", "meaning_req", "error_spec", "profile_id"))).alias("c"))
    )
    given = F.transform(
        "c", lambda x: F.struct(x["meaning_req"].alias("meaning_req"), x["error_spec"].alias("error_spec"), x["profile_id"].alias("profile_id"))
    )
    return df.drop("cells").join(made.select("sense_uid", given.alias("cells")), "sense_uid", "left")


def flatten_specs(df: DataFrame, seed: int = 0) -> DataFrame:
    """One row per request, with content ids for the request and its batch."""

    def named(c: Column) -> Column:
        parts = [F.col("sense_uid"), c["meaning_req"].cast("string"), c["error_spec"],
                 c["profile_id"], F.lit(str(seed))]
        return F.struct(
            hashing.short_uid(parts, "|").alias("spec_id"),
            c["meaning_req"].alias("meaning_req"),
            c["error_spec"].alias("error_spec"),
            c["profile_id"].alias("profile_id"),
        )

    ids = F.transform("specs", lambda s: s["spec_id"])
    batch = F.substring(
        hashing.digest(F.concat_ws("|", F.col("sense_uid"), F.array_join(ids, "|"))), 1, 16
    )
    named_specs = with_columns_once(df, specs=F.transform("cells", named))
    rows = with_columns_once(named_specs, batch_uid=batch)
    rows = rows.drop("cells").select("*", F.inline("specs")).withColumn("seed", F.lit(seed))
    return rows.select([F.col(f.name).cast(f.dataType) for f in SPECS])


def sample_stats(specs: DataFrame) -> DataFrame:
    """Marginals of the drawn requests as rows ``(section, key, n)``."""
    counted = tally(
        specs,
        specs=F.lit("all"),
        meaning_req=F.col("meaning_req"),
        error_spec=F.col("error_spec"),
        profile=F.col("profile_id"),
    )
    per_sense = specs.groupBy("sense_uid").agg(F.max("is_multiword").alias("is_multiword"))
    return counted.unionByName(
        tally(
            per_sense,
            senses=F.lit("all"),
            multiword_senses=F.when(F.col("is_multiword"), "all"),
        )
    )


def batch_members(specs: DataFrame, **limits: int) -> DataFrame:
    """Every request with its place in its batch, in request-id order.

    The place comes from a range partitioning on (batch, request), so a large batch is spread
    over several tasks instead of being collected.
    """
    placed = global_positions(specs, ["batch_uid", "spec_id"], name="_pos")
    starts = placed.groupBy("batch_uid").agg(
        F.min("_pos").alias("_first"), F.count("*").alias("batch_size")
    )
    joined = attach(
        placed, starts.withColumn("_n", F.col("batch_size")), ["batch_uid"], "_n", **limits
    )
    return joined.withColumn("member_index", (F.col("_pos") - F.col("_first")).cast("int")).drop(
        "_pos", "_first"
    )


def sentence_shape_check(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("shape_fault", shape_fault(F.col(text_col)))


def target_present(df: DataFrame, text_col: str = "text", target_col: str = "target") -> DataFrame:
    """Add ``target_present`` and whether its absence is a fault for the request."""
    present = mentions(F.col(text_col), F.col(target_col))
    expected = (F.col("error_spec") != "unreadable") & (F.col("meaning_req") > 0)
    return df.withColumn("target_present", present).withColumn(
        "target_absent", expected & ~F.col("target_present")
    )


def response_id_check(resp: DataFrame, req: DataFrame) -> DataFrame:
    """Per answered batch: the id fault that refuses it, if any, and its missing ids.

    Both tables have ``batch_uid, spec_id``; an answer without sentences has a null spec_id.
    Both sides are stacked and counted per id, so there is no join.
    """
    got = resp.select(
        "batch_uid", "spec_id", F.lit(1).alias("got"), F.lit(0).alias("want")
    )
    want = req.select("batch_uid", "spec_id", F.lit(0).alias("got"), F.lit(1).alias("want"))
    per_id = (
        got.unionByName(want)
        .groupBy("batch_uid", "spec_id")
        .agg(F.sum("got").alias("got"), F.max("want").alias("want"))
    )
    real = F.col("spec_id").isNotNull()
    return (
        per_id.groupBy("batch_uid")
        .agg(
            (F.max("got") > 0).alias("answered"),
            F.max(real & (F.col("got") > 1)).alias("twice"),
            F.max(real & (F.col("got") > 0) & (F.col("want") == 0)).alias("foreign"),
            F.count_if(real & (F.col("got") == 0)).alias("missing"),
            F.count_if(real & (F.col("want") > 0)).alias("requested"),
        )
        .where("answered")
        .select(
            "batch_uid",
            F.when(F.col("twice"), "duplicate_spec_id")
            .when(F.col("foreign"), "unexpected_spec_id")
            .when(F.col("missing") > 0, "missing_spec_id")
            .alias("batch_fault"),
            "missing",
            "requested",
        )
    )


RESPONSE = "sentences array<struct<spec_id:string,text:string>>"


def _answers(responses: DataFrame) -> DataFrame:
    """``batch_uid, spec_id, text`` of every sentence; one row with nulls for a reply without any."""
    if "kind" in responses.columns:
        responses = responses.where(~F.col("kind").eqNullSafe(F.lit("batch_done")))
    return responses.select(
        "batch_uid",
        F.explode_outer(F.from_json("response", RESPONSE)["sentences"]).alias("s"),
    ).select("batch_uid", "s.spec_id", "s.text")


def batch_faults(responses: DataFrame, specs: DataFrame) -> DataFrame:
    """``response_id_check`` of replies as they come, for callers that need it more than once."""
    return response_id_check(_answers(responses), specs)


def refused_batches(responses: DataFrame, specs: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """Answered batches with an id fault: ``batch_uid, batch_fault, n``.

    Such a batch stays pending as a whole and is asked again. ``n`` counts what is put down in
    the reject counts: each missing id, but a repeated or a foreign id once for the batch.
    ``faults`` are the ``batch_faults``, if they are known already.
    """
    faults = batch_faults(responses, specs) if faults is None else faults
    faults = faults.where(F.col("batch_fault").isNotNull())
    each_missing = F.when(F.col("batch_fault") == "missing_spec_id", F.col("missing")).otherwise(1)
    return faults.select("batch_uid", "batch_fault", each_missing.cast("long").alias("n"))


def expand_batches(
    responses: DataFrame, specs: DataFrame, refused: bool = False, faults: DataFrame | None = None, **limits: int
) -> DataFrame:
    """One row per request of the batches that are done, with its text or a reject reason.

    ``responses`` has ``batch_uid`` and the reply as a JSON string; rows of kind
    ``batch_done`` only serve resuming and are left out. A bad shape or an absent target refuses
    one sentence. A batch without an answer is still pending and has no row. One with an id fault is
    pending too: with ``refused`` its requests are rows whose reject reason is the fault, else it has
    no row; ``refused_batches`` tells the faults per batch. ``faults`` are the ``batch_faults``, if they are
    known already; batches that are not in it have no row.
    """
    texts = _answers(responses)
    faults = batch_faults(responses, specs) if faults is None else faults
    faults = faults.drop("missing").withColumn("answered", F.lit(True))
    # The faults go to the requests before these have texts, so that a text moves once.
    asked = attach(specs, faults, ["batch_uid"], "requested", **limits).where("answered")
    if refused:
        texts = texts.groupBy("batch_uid", "spec_id").agg(F.min("text").alias("text"))
    else:
        # No id comes twice in the answer to a batch without a fault.
        asked = asked.where(F.col("batch_fault").isNull())
    rows = asked.join(texts, ["batch_uid", "spec_id"], "left")
    checked = target_present(sentence_shape_check(rows))
    reason = (
        F.when(F.col("batch_fault").isNotNull(), F.col("batch_fault"))
        .when(F.col("shape_fault").isNotNull(), F.col("shape_fault"))
        .when(F.col("target_absent"), "target_absent")
    )
    done = checked.withColumn("reject_reason", reason).withColumn("req_uid", F.col("spec_id"))
    done = done.withColumn("text", strip(F.col("text")))
    return done.select(
        *[F.col(f.name).cast(f.dataType) for f in TEXTS], "reject_reason"
    )


def join_spec_traits(specs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requests with the description of their learner profile.

    Few profiles are broadcast; else the requests of a profile that has very many are dealt apart.
    """
    traits = profiles.select(F.col("id").alias("profile_id"), "traits")
    small = checked_small(traits)
    if small is None:
        joined = split_join(specs, traits, ["profile_id"], "left")
    else:
        joined = specs.join(small, "profile_id", "left")
    return joined.withColumn("traits", F.coalesce("traits", F.lit(UNKNOWN_PROFILE)))


def tokenize_ngrams(df: DataFrame, text: str, n: int) -> DataFrame:
    """One row per n-gram of the lower-cased word tokens."""
    if n <= 0:
        raise ValueError("n-grams have one token or more")
    grams = bind(tokens(F.col(text)), lambda t: ngrams(t, n))
    return df.select("*", F.explode(grams).alias("ngram")).drop(text)


def _hashed_grams(text: Column) -> Column:
    """``array<struct<n, a, b>>``: every 2- and 3-gram of a text as two independent 64-bit hashes.

    Tokens are hashed once and n-grams are made from these, so none is ever a string. The first
    entry, with ``n`` 0, stands for the text itself.
    """

    def hashed(t: Column) -> Column:
        return F.transform(t, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))

    def sized(h: Column, n: int) -> Column:
        def gram(i: Column) -> Column:
            side = {s: F.xxhash64(*[F.get(h, i + k)[s] for k in range(n)]) for s in "ab"}
            return F.struct(F.lit(n).alias("n"), *[x.alias(s) for s, x in side.items()])

        none = F.array().cast("array<struct<n:int,a:bigint,b:bigint>>")
        return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), gram)).otherwise(none)

    here = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    return bind(hashed(tokens(F.coalesce(text, F.lit("")))), lambda h: F.concat(here, sized(h, 2), sized(h, 3)))


def _collapsing(shares: DataFrame, threshold: float) -> DataFrame:
    return shares.withColumn("collapsed", (F.col("texts") > 0) & (F.col("distinct2") < threshold))


#: Bytes of text per group of batches or part of a batch: an even share of so many, within these bounds.
PARTS, LEAST_BYTES, MOST_BYTES = 200, 1 << 20, 16 << 20
#: Bytes of text in which a task tells the n-grams of large batches apart before it sends them.
SENT_BYTES = 8 << 20


def batch_diversity(
    df: DataFrame, batch: str, text: str, threshold: float = 0.7, least: int = LEAST_BYTES
) -> DataFrame:
    """Distinct bigram and trigram shares pooled over each batch's texts.

    N-grams are told apart exactly. The texts of a batch that fits a part are brought together. A larger
    batch is dealt over several parts by the two first words of each trigram: a task sends a trigram once
    per ``SENT_BYTES`` of text, as word numbers beside the words, and its bigram goes with it. ``df`` is
    read once for the sizes of the batches, which are written, and once or twice for the texts.
    An empty pool scores 1.0.
    """
    rows = df.select(F.col(batch).alias("batch_uid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = written(
        rows.groupBy("batch_uid").agg(F.count("*").alias("texts"), F.sum(F.octet_length("text") + F.lit(1)).alias("size"))
    )
    every = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    part = min(max(every // PARTS, least), max(MOST_BYTES, least))
    fits = F.col("size") <= part
    small, large = sizes.agg(
        *[F.coalesce(F.sum(F.when(x, y)), F.lit(0)) for x, y in ((fits, F.col("size")), (~fits, F.ceil(F.col("size") / part)))]
    ).first()
    rows = rows.withColumn("text", F.lower("text"))
    if large:
        # There are fewer large batches than parts.
        dealt = sizes.where(~fits).select(F.col("batch_uid").alias("_batch"), F.ceil(F.col("size") / part).cast("int").alias("parts"))
        rows = rows.join(F.broadcast(dealt), F.col("batch_uid").eqNullSafe(F.col("_batch")), "left").drop("_batch")
    name = T.StructField("batch_uid", rows.schema["batch_uid"].dataType)
    counts = T.StructType([name, *[T.StructField(c, T.LongType()) for c in neighbours.COUNTS]])
    found = sizes.select("batch_uid", "texts", *[F.lit(0).cast("long").alias(c) for c in neighbours.COUNTS])
    if small:
        groups = -(-small // part)
        whole = (rows.where(F.col("parts").isNull()) if large else rows).select(
            "batch_uid", "text", F.pmod(F.xxhash64("batch_uid"), F.lit(groups)).cast("int").alias("spot")
        )
        counted = whole.repartition(groups, "spot").groupBy("spot").applyInArrow(neighbours.count_texts, counts)
        found = found.unionByName(counted.withColumn("texts", F.lit(0).cast("long")))
    if large:
        fields = "spot int, pairs bigint, triples bigint, words array<string>, id0 array<int>, id1 array<int>, id2 array<int>"
        schema = T.StructType([name, *T.StructType.fromDDL(fields).fields])
        cut = rows.where(F.col("parts").isNotNull()).select("batch_uid", "parts", "text").mapInArrow(neighbours.packed(SENT_BYTES), schema)
        counted = cut.repartition(large, "batch_uid", "spot").groupBy("batch_uid", "spot").applyInArrow(neighbours.count_packed, counts)
        found = found.unionByName(counted.withColumn("texts", F.lit(0).cast("long")))
    sums = found.groupBy("batch_uid").agg(*[F.sum(c).alias(c) for c in ("texts", *neighbours.COUNTS)])

    def share(of: str) -> Column:
        return F.coalesce(F.try_divide(F.col(f"distinct_{of}"), F.col(of)), F.lit(1.0))

    shares = sums.select("batch_uid", "texts", share("pairs").alias("distinct2"), share("triples").alias("distinct3"))
    return _collapsing(shares, threshold)


#: Size of a sketch as a power of two: a standard error of about 0.8 %.
SKETCH_BITS = 14


def diversity_sketches(df: DataFrame, batch: str, text: str, bits: int = SKETCH_BITS) -> DataFrame:
    """Per batch the number of texts and n-grams and a distinct-count sketch of each kind of n-gram.

    Sketches of parts of a batch, made at other times, are merged by ``diversity_of_sketches``;
    at most ``2 ** bits`` bytes of each move, whatever the batch holds.
    """
    grams = df.select(F.col(batch).alias("batch_uid"), F.explode(_hashed_grams(F.col(text))).alias("g"))

    def of(n: int) -> list[Column]:
        mine = F.when(F.col("g.n") == n, F.xxhash64("g.a", "g.b"))
        return [F.count(mine).alias(f"n{n}"), F.hll_sketch_agg(mine, bits).alias(f"sketch{n}")]

    return grams.groupBy("batch_uid").agg(F.count_if(F.col("g.n") == 0).alias("texts"), *of(2), *of(3))


def diversity_of_sketches(sketches: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The columns of ``batch_diversity``, estimated from sketches of batches or of parts of them."""

    def share(n: int) -> Column:
        distinct = F.hll_sketch_estimate(F.hll_union_agg(f"sketch{n}")).cast("double")
        every = F.sum(f"n{n}")
        return F.when(every > 0, F.least(F.lit(1.0), distinct / every)).otherwise(1.0)

    shares = sketches.groupBy("batch_uid").agg(
        F.sum("texts").alias("texts"), share(2).alias("distinct2"), share(3).alias("distinct3")
    )
    return _collapsing(shares, threshold)
