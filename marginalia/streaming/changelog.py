"""Append logs as streams: ingest, current state, running counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators.grading import check_rows, parse_responses
from marginalia.operators.log import latest_by_key
from marginalia.schemas import LOG
from marginalia.sources.readers import BAD_LINE, log_lines


#: Files that one micro-batch takes in, so that a backlog is worked off in bounded pieces.
FILES_PER_BATCH = 1000


def read_log_stream(
    spark: SparkSession, path: str, schema: T.StructType, id_col: str, files: int = FILES_PER_BATCH
) -> DataFrame:
    """New log files as they arrive; lines that are no records stay in ``bad_line``."""
    return log_lines(spark.readStream.option("maxFilesPerTrigger", files).text(path), schema, id_col)


def graded_log(lines: DataFrame) -> DataFrame:
    """Checked log rows: ``reject_reason`` is null for valid ones, bad_line for torn lines."""
    checked = check_rows(parse_responses(lines))
    reason = F.when(F.col(BAD_LINE).isNotNull(), "bad_line").otherwise(F.col("reject_reason"))
    return checked.withColumn("reject_reason", reason)


def stream_log_ingest(
    spark: SparkSession, path: str, ckpt: str, out: str, schema: T.StructType = LOG
) -> None:
    """Bring all log files not seen yet into ``out``, accepted and refused rows apart.

    The file source remembers its files in ``ckpt`` and the parquet sink its batches, so a
    restarted run neither repeats nor loses a line.
    """
    rows = graded_log(read_log_stream(spark, path, schema, "req_uid"))
    kept = rows.select(
        "req_uid", "seq", "text", "correction", "meaning", "feedback", "reject_reason", BAD_LINE,
        F.when(F.col("reject_reason").isNull(), "valid").otherwise("rejects").alias("part"),
    )
    query = (
        kept.writeStream.format("parquet")
        .partitionBy("part")
        .option("checkpointLocation", ckpt)
        .option("path", out)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_latest_state(stream: DataFrame, key: str, seq: str | list[str]) -> DataFrame:
    """Streaming aggregate with the last row of each key; state holds one row per key.

    Run it in update mode: each change of a key is emitted again, deletions included, and a
    reader applies its tombstone rule to the last row of a key.
    """
    order = [seq] if isinstance(seq, str) else seq
    missing = [c for c in order if c not in stream.columns]
    if missing or not order:
        raise ValueError(f"the log needs its sequence columns: {missing}")
    rest = [c for c in stream.columns if c != key]
    last = stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest))).alias("r"))
    return last.select(key, "r.*")


def stream_reject_counts(stream: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """Running counts per reject reason."""
    return stream.groupBy(F.coalesce(F.col(reason), F.lit("ok")).alias("reason")).agg(
        F.count("*").alias("n")
    )


class Generations:
    """A keyed table that micro-batches change, kept as one compacted generation and a few changes.

    Each batch adds one folder with what it changes, named by its number; a retried batch writes the
    same folder again. After ``every`` batches the newest generation and the changes since are merged
    into a new generation, and only when that is whole a pointer to it is left, so a reader, or a run
    that starts again after a failure, always finds one whole generation and the changes after it.
    What a pointer has made superfluous is removed. Reading costs the keys and at most ``every`` batches
    of changes, however long the history is.

    ``merge`` makes one row per key out of rows of generations and changes, and has to give the
    same for any grouping of them (a latest row, a sum).
    """

    def __init__(self, spark: SparkSession, out: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame], every: int = 16):
        self.spark, self.out, self.schema, self.merge, self.every = spark, out, schema, merge, every

    def _path(self, name: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{name}")

    def _listed(self, kind: str) -> list[int]:
        """Numbers of the folders of one kind, in order."""
        at = self._path(kind)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        return sorted(int(f.getPath().getName()) for f in files.listStatus(at))

    def _remove(self, kind: str, numbers: list[int]) -> None:
        for n in numbers:
            at = self._path(f"{kind}/{n:012d}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def pointer(self) -> int | None:
        """Number of the last batch in the newest whole generation."""
        return max(self._listed("pointer"), default=None)

    def add(self, batch: DataFrame, number: int) -> None:
        """The changes of one batch; compacts when enough of them have gathered."""
        done = self.pointer()
        if done is not None and number <= done:
            return  # a batch that a generation holds already
        self.merge(batch.select(*self.schema.names)).write.mode("overwrite").parquet(f"{self.out}/change/{number:012d}")
        if len(self._since(done, number)) >= self.every:
            self.compact(number)

    def _since(self, done: int | None, upto: int | None = None) -> list[int]:
        return [n for n in self._listed("change") if (done is None or n > done) and (upto is None or n <= upto)]

    def compact(self, upto: int) -> None:
        """A new generation with all changes up to batch ``upto``."""
        self._merged(upto).write.mode("overwrite").parquet(f"{self.out}/whole/{upto:012d}")
        at = self._path(f"pointer/{upto:012d}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True).close()
        self._remove("change", [n for n in self._listed("change") if n <= upto])
        for kind in ("pointer", "whole"):
            self._remove(kind, [n for n in self._listed(kind) if n < upto])

    def _merged(self, upto: int | None) -> DataFrame:
        done = self.pointer()
        folders = [f"{self.out}/change/{n:012d}" for n in self._since(done, upto)]
        if done is not None:
            folders.append(f"{self.out}/whole/{done:012d}")
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.merge(self.spark.read.schema(self.schema).parquet(*folders))

    def read(self, upto: int | None = None) -> DataFrame:
        """The table as of the last batch, or as of batch ``upto`` if no generation goes beyond it."""
        return self._merged(upto)


def _run(stream: DataFrame, ckpt: str, each: Callable[[DataFrame, int], None]) -> None:
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_rows(spark: SparkSession, out: str, schema: T.StructType, key: str, seq: str | list[str], every: int = 16) -> Generations:
    """The last row of each key of a log, deletions included, as generations below ``out``."""
    return Generations(spark, out, schema, lambda rows: latest_by_key(rows, key, seq), every)


def stream_state(stream: DataFrame, ckpt: str, state: Generations) -> None:
    """Bring all log rows not seen yet into ``state``; a row that comes late loses to a later one.

    There is no state in the executors: what a batch changes is an aggregate of its own rows.
    """
    _run(stream, ckpt, state.add)


LATE = "late"


def window_counts(spark: SparkSession, out: str, every: int = 16) -> Generations:
    """Counts per window, kind and lateness, as generations below ``out``."""
    schema = T.StructType(
        [
            T.StructField("window_start", T.TimestampType()),
            T.StructField("kind", T.StringType()),
            T.StructField(LATE, T.BooleanType()),
            T.StructField("n", T.LongType()),
            T.StructField("newest", T.TimestampType()),
        ]
    )
    keys = ["window_start", "kind", LATE]
    return Generations(spark, out, schema, lambda rows: rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("newest").alias("newest")), every)


def stream_event_counts(
    stream: DataFrame, ckpt: str, counts: Generations, time: str, kind: str, width: str, delay: str
) -> None:
    """Rows per event-time window of ``width`` and ``kind``, those behind the watermark apart.

    The watermark of a batch is the newest time of the batches before it, less ``delay``; a row is
    late if its window ended by then, as in the engine's own windowed aggregates, which would drop
    it without a word. Here it is counted with ``late`` true. Rows without a time are late in the
    window null. No state is kept but the counts.
    """

    def add(batch: DataFrame, number: int) -> None:
        # Without what an earlier try of this batch may have left.
        newest = counts.read(number - 1).agg(F.max("newest")).first()[0]
        limit = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        rows = batch.select(F.window(F.col(time), width).alias("w"), F.col(time).alias("t"), F.col(kind).alias("kind"))
        dated = rows.select(
            F.col("w.start").alias("window_start"), "kind", F.coalesce(F.col("w.end") <= limit, F.lit(False)).alias(LATE),
            F.lit(1).cast("long").alias("n"), F.col("t").alias("newest"),
        )
        undated = batch.where(F.col(time).isNull()).select(
            F.lit(None).cast("timestamp").alias("window_start"), F.col(kind).alias("kind"), F.lit(True).alias(LATE),
            F.lit(1).cast("long").alias("n"), F.lit(None).cast("timestamp").alias("newest"),
        )
        counts.add(dated.unionByName(undated), number)

    _run(stream, ckpt, add)


def event_counts(counts: Generations) -> DataFrame:
    """``window_start, kind, n, late``: rows counted in time, and rows that came too late."""
    in_time = F.sum(F.when(~F.col(LATE), F.col("n")).otherwise(0))
    too_late = F.sum(F.when(F.col(LATE), F.col("n")).otherwise(0))
    return counts.read().groupBy("window_start", "kind").agg(in_time.alias("n"), too_late.alias(LATE))


def run_updates(stream: DataFrame, ckpt: str, out: str) -> None:
    """Append every update of a streaming aggregate to ``out`` with its batch number.

    Each batch has a folder of its own that a retried batch overwrites.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(
            f"{out}/batch_{number:09d}"
        )

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def settled(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The newest update of each key written by ``run_updates``."""
    updates = spark.read.parquet(f"{out}/batch_*")
    rest = [c for c in updates.columns if c not in (key, "batch")]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(key, "r.*")
