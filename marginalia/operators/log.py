"""Append logs and caches: current state, pending work, lookups, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.hashing import digest
from marginalia.operators.ranking import attach


def latest_by_key(
    log: DataFrame, key: str, seq: str | list[str], tombstone: Column | None = None
) -> DataFrame:
    """The last row of each key by an explicit sequence, deleted keys left out.

    File order is no order here, so a log without a sequence column is refused. Of rows that
    share a key's highest sequence the same one is taken in every run, by a hash of the row.
    """
    order = [seq] if isinstance(seq, str) else seq
    missing = [c for c in order if c not in log.columns]
    if missing or not order:
        raise ValueError(f"the log needs its sequence columns: {missing}")
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest))).alias("r"))
    current = last.select(key, "r.*").select(*log.columns)
    if tombstone is None:
        return current
    return current.where(~F.coalesce(tombstone, F.lit(False)))


def log_key(uid: Column, pass_index: int) -> Column:
    """Resume key of a grading; later passes carry a suffix."""
    return uid if pass_index == 0 else F.concat(uid, F.lit(f"#p{pass_index}"))


def request_of(key: Column) -> Column:
    return F.regexp_replace(key, r"#p\d+\z", "")


def pending_requests(
    requests: DataFrame, log: DataFrame, pass_index: int = 0, id_col: str = "req_uid"
) -> DataFrame:
    """Requests whose key is not in the log yet."""
    done = log.select(F.col(id_col).alias("_done")).distinct()
    key = log_key(F.col(id_col), pass_index)
    return requests.join(done, key == F.col("_done"), "left_anti")


def cache_key(model: Column, prompt_hash: Column, request: Column) -> Column:
    return digest(F.concat_ws("|", model, prompt_hash, request))


def cache_lookup(requests: DataFrame, cache_log: DataFrame, **limits: int) -> DataFrame:
    """Add ``response`` and ``hit`` to requests ``(model, prompt_hash, request)``.

    The cache log has ``key, seq, response``; the latest entry counts and a null response is
    a deletion.
    """
    keyed = requests.withColumn(
        "key", cache_key(F.col("model"), F.col("prompt_hash"), F.col("request"))
    )
    current = latest_by_key(cache_log.select("key", "seq", "response"), "key", "seq")
    asked = keyed.groupBy("key").agg(F.count("*").alias("_n"))
    per_key = asked.join(current.select("key", "response"), "key", "left")
    return attach(keyed, per_key, ["key"], "_n", **limits).withColumn(
        "hit", F.col("response").isNotNull()
    )


def usage_report(calls: DataFrame) -> DataFrame:
    """One row of call, cache, token and cost totals."""
    hits = F.coalesce(F.sum(F.col("cache_hit").cast("long")), F.lit(0))
    n = F.count("*")
    return calls.agg(
        n.alias("calls"),
        hits.alias("cache_hits"),
        (n - hits).alias("network_calls"),
        F.round(F.when(n > 0, hits / n).otherwise(0.0), 4).alias("hit_rate"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"),
        F.count_if("failed").alias("failures"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"),
    )


def rubric_guard(log: DataFrame, prompt_hash: str) -> DataFrame:
    """Whether all graded rows of a log were written under the given prompt."""
    graded = log.where(F.col("meaning").isNotNull())
    other = F.coalesce(F.col("prompt_hash"), F.lit("")) != prompt_hash
    return graded.agg(
        F.count_distinct(F.coalesce("prompt_hash", F.lit(""))).alias("prompts"),
        F.count_if(other).alias("foreign_rows"),
        (F.count_if(other) == 0).alias("passed"),
    )
