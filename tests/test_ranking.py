import hashlib
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import hashing
from marginalia.operators import ranking as R
from marginalia.operators import timing as M


def rows_with_a_hot_key(n=600):
    rng = random.Random(3)
    return [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(25)) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_global_positions(spark, parts):
    data = rows_with_a_hot_key()
    df = spark.createDataFrame(data, "i int, k string, v int").repartition(parts)
    got = {r["i"]: r["position"] for r in R.global_positions(df, ["k", "v", "i"]).collect()}
    ordered = sorted(data, key=lambda r: (r[1], r[2], r[0]))
    assert got == {r[0]: p for p, r in enumerate(ordered)}


def test_weighted_positions(spark):
    data = [(c, len(c)) for c in "a bb ccc dddd eeeee ffffff".split()]
    df = spark.createDataFrame(data, "k string, w long").repartition(5)
    got = {r["k"]: r["position"] for r in R.global_positions(df, ["k"], weight="w").collect()}
    assert got == {"a": 0, "bb": 1, "ccc": 3, "dddd": 6, "eeeee": 10, "ffffff": 15}
    assert R.global_positions(df.limit(0), ["k"]).count() == 0


def brute_smallest(data, quota):
    groups = {}
    for i, k, _ in data:
        groups.setdefault(k, []).append((hashlib.sha256(f"9|{i}".encode()).hexdigest(), i))
    return {i for g in groups.values() for _, i in sorted(g)[:quota]}


@pytest.mark.parametrize("limits", [{}, {"digits": 1}, {"digits": 1, "small_groups": 3}, {"digits": 2, "small_groups": 1}])
@pytest.mark.parametrize("quota", [0, 1, 7, 10_000])
def test_take_smallest_is_exact_on_every_path(spark, limits, quota):
    data = rows_with_a_hot_key(300)
    df = spark.createDataFrame(data, "i int, k string, v int").withColumn(
        "o", hashing.seeded(9, F.col("i").cast("string"))
    )
    got = [r["i"] for r in R.take_smallest(df, ["k"], "o", quota, **limits).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_smallest(data, quota)


def test_null_and_repeated_ids_are_chosen_alike_on_every_path(spark):
    rows = [(None if i % 3 == 0 else f"id{i % 20}", i % 5, None if i % 2 else "g") for i in range(240)]
    df = spark.createDataFrame(rows, "uid string, v int, k string").withColumn("o", hashing.seeded(3, F.col("uid")))
    seen = set()
    for parts in (1, 4, 200):
        for limits in ({}, {"digits": 1, "small_groups": 1}):
            kept = R.take_smallest(df.repartition(parts), ["k"], "o", 50, **limits).collect()
            assert len(kept) == 100 and sum(r["k"] is None for r in kept) == 50
            seen.add(tuple(sorted(map(repr, kept))))
    assert len(seen) == 1
    order = {r["uid"]: r["o"] for r in df.select("uid", "o").distinct().collect()}
    for key in ("g", None):
        want = sorted(order[u] for u, _, k in rows if k == key)[:50]
        assert sorted(r["o"] for r in kept if r["k"] == key) == want


def test_copies_of_one_row_are_counted(spark):
    df = spark.createDataFrame([("same", i % 2) for i in range(200)], "k string, v int")
    df = df.withColumn("o", F.sha2("k", 256))
    kept = R.take_smallest(df, ["k"], "o", 137, digits=1)
    assert sorted(r["n"] for r in kept.groupBy("v").agg(F.count("*").alias("n")).collect()) == [37, 100]


def test_input_is_evaluated_twice(spark, tmp_path):
    spark.range(200).selectExpr("id", "id % 3 AS k").write.parquet(str(tmp_path / "t"))
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        calls.add(1)
        return f"{x * 7919 % 1000:04x}"

    df = spark.read.parquet(str(tmp_path / "t")).withColumn("o", seen.asNondeterministic()("id"))
    assert R.take_smallest(df, ["k"], "o", 20, digits=1).count() == 60
    assert calls.value == 400


def test_quota_per_group(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(90)], "i int, g int")
    df = df.withColumn("o", F.sha2(F.col("i").cast("string"), 256))
    kept = R.take_smallest(df, ["g"], "o", {(0,): 4, (1,): 0})
    assert {r["g"]: r["n"] for r in kept.groupBy("g").agg(F.count("*").alias("n")).collect()} == {0: 4, 2: 30}


@pytest.mark.parametrize("small", [10_000, 2])
def test_attach_by_broadcast_and_by_shuffle(spark, small):
    data = [(i, None if k == "k1" else k, v) for i, k, v in rows_with_a_hot_key()]
    df = spark.createDataFrame(data, "i int, k string, v int")
    per = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    got = R.attach(df, per, ["k"], "n", small_rows=small).collect()
    sums = {}
    for _, k, v in data:
        sums[k] = sums.get(k, 0) + v
    assert len(got) == len(data)
    assert all(r["s"] == sums[r["k"]] for r in got)


def test_exact_percentiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "x double").repartition(7)
    got = {r["fraction"]: r["value"] for r in R.exact_percentiles(df, "x", [0.5, 0.95, 0.99, 0.0, 1.0]).collect()}
    assert got[0.5] == pytest.approx(50.5)
    assert got[0.95] == pytest.approx(95.05)
    assert got[0.99] == pytest.approx(99.01)
    assert (got[0.0], got[1.0]) == (1.0, 100.0)
    one = R.exact_percentiles(df.limit(1), "x", [0.3]).first()
    assert one["value"] is not None
    with pytest.raises(ValueError):
        R.exact_percentiles(df.limit(0), "x", [0.5])


def test_pareto_frontier_against_all_pairs(spark):
    rng = random.Random(5)
    pts = [(i, rng.randrange(12), rng.randrange(12)) for i in range(150)]
    df = spark.createDataFrame(pts, "i int, q int, t int").repartition(6)
    want = {
        a[0]
        for a in pts
        if not any(
            b[1] >= a[1] and b[2] <= a[2] and (b[1] > a[1] or b[2] < a[2]) for b in pts
        )
    }
    assert {r["i"] for r in M.pareto_frontier(df, "q", "t").collect()} == want


def test_bucket_matches_integer_arithmetic(spark):
    keys = [f"key-{i}" for i in range(200)] + ["é", ""]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r["k"]: r["b"] for r in df.select("k", hashing.bucket(5, F.col("k")).alias("b")).collect()}
    for k in keys:
        head = hashlib.sha256(f"5|{k}".encode()).digest()[:8]
        assert got[k] == int.from_bytes(head, "big") % 10_000


@pytest.fixture
def fixed_partitions(spark):
    """Sixteen shuffle partitions that adaptive execution does not touch."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield 16
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_split_join_equals_a_plain_join(spark, fixed_partitions, tmp_path, how, null_safe):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 400).alias("k"), F.col("id").alias("v")
    )
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    other = spark.createDataFrame([(k, f"{k}-{i}") for k in [*range(0, 300), None] for i in range(2 if k == 7 else 1)], "k bigint, w string")
    same = rows["k"].eqNullSafe(other["k"]) if null_safe else rows["k"] == other["k"]
    want = rows.join(other, same, how).select(rows["k"], "v", *([] if how.startswith("left_") else ["w"]))
    got = R.split_join(rows, other, ["k"], how, null_safe=null_safe)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_hot_key_is_dealt_evenly_without_adaptive_execution(spark, fixed_partitions, tmp_path):
    spark.range(48_000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    ).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    other = spark.range(48_000).select(F.col("id").alias("k"), (F.col("id") + 1).alias("w"))
    hot = R.hot_keys(rows, ["k"], fixed_partitions).collect()
    assert [(r["k"], r["salts"]) for r in hot] == [(5, 6)]
    joined = R.split_join(rows, other, ["k"])
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    per_task = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(per_task) == 48_000 and len(per_task) == fixed_partitions and max(per_task) < 2.5 * 48_000 / fixed_partitions


def test_an_attached_table_that_is_large_is_dealt_the_same_way(spark, fixed_partitions, tmp_path):
    spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 3000).alias("k"), F.col("id").alias("v")
    ).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    per_key = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    got = R.attach(rows, per_key, ["k"], "n", small_rows=10)
    assert got.columns == ["k", "v", "top"]
    want = {r["k"]: r["top"] for r in per_key.collect()}
    assert got.count() == 9000 and all(r["top"] == want[r["k"]] for r in got.collect())
