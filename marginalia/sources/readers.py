"""Reading the dataset's tables, logs and corpus files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import strip
from marginalia.operators.joins import join_senses_entries
from marginalia.schemas import GRADER_COLUMNS, POOL_COLUMNS, PREDICTIONS, PROFILES, TAGS

BAD_LINE = "bad_line"


def scan_senses(senses: DataFrame, entries: DataFrame) -> DataFrame:
    """Dictionary senses with headword and part of speech; only the needed columns are read."""
    return join_senses_entries(
        senses.select("id", "entry_id", "definition", "cefr_level"),
        entries.select("id", "headword", "pos"),
    )


def log_lines(raw: DataFrame, schema: T.StructType, id_col: str = "req_uid") -> DataFrame:
    """Parse a ``value`` column of JSON lines; ``bad_line`` keeps what is no JSON object.

    Blank lines go; a record without its id is bad as well.
    """
    if id_col not in schema.fieldNames():
        raise ValueError(f"the schema has no {id_col}")
    lines = raw.withColumn("value", strip(F.col("value"))).where(F.col("value") != "")
    whole = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    parsed = lines.withColumn("_r", F.from_json("value", whole, options))
    record = F.col("_r").isNotNull() & F.startswith("value", F.lit("{"))
    good = record & F.col(f"_r.{BAD_LINE}").isNull() & F.col(f"_r.{id_col}").isNotNull()
    rest = [c for c in raw.columns if c != "value"]
    return parsed.select(
        *rest,
        *[F.when(good, F.col(f"_r.{f}")).alias(f) for f in schema.fieldNames()],
        F.when(~F.coalesce(good, F.lit(False)), F.col("value")).alias(BAD_LINE),
    )


def scan_jsonl_log(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    id_col: str = "req_uid",
    keep_bad: bool = False,
) -> DataFrame:
    """Records of an append log. Torn and foreign lines are left out, or kept in ``bad_line``."""
    parsed = log_lines(spark.read.text(path), schema, id_col)
    return parsed if keep_bad else parsed.where(F.col(BAD_LINE).isNull()).drop(BAD_LINE)


def scan_m2(spark: SparkSession, path: str, coder: str | None = None) -> DataFrame:
    """Annotated corpus files as ``(source, cefr, tokens, annotations)``, one row a sentence.

    Sentences are the blank-line separated records of the file, so files split over tasks. A
    malformed record is an error. With ``coder`` only that annotator's edits are kept.
    """
    raw = spark.read.option("lineSep", "\n\n").text(path).select(
        F.col("_metadata.file_name").alias("source"), F.col("value")
    )
    return m2_blocks(raw, coder)


def m2_blocks(raw: DataFrame, coder: str | None = None) -> DataFrame:
    blocks = raw.select(
        "source", F.explode(F.split(F.col("value"), r"\n(?=S )")).alias("block")
    ).select("source", F.split(F.regexp_replace("block", r"^\n+", ""), "\n").alias("lines"))
    starts = F.startswith(F.col("lines")[0], F.lit("S "))
    orphans = F.exists("lines", lambda x: F.startswith(x, F.lit("A "))) & ~starts
    blocks = blocks.where(starts | F.when(orphans, _refuse("annotation without a sentence above it")))

    def annotation(line: Column) -> Column:
        parts = F.split(F.substring(line, 3, 1 << 30), r"\|\|\|")
        bounds = F.filter(F.split(parts[0], r"\s+"), lambda b: b != "")
        ok = (F.size(parts) >= 6) & (F.size(bounds) == 2)

        def bound(i: int) -> Column:
            return F.when(ok, F.get(bounds, F.lit(i))).otherwise(
                F.raise_error(F.concat(F.lit("malformed annotation: "), line))
            ).cast("int")

        return F.struct(
            bound(0).alias("start"), bound(1).alias("end"), F.get(parts, F.lit(1)).alias("type"),
            F.get(parts, F.lit(2)).alias("correction"), F.get(parts, F.lit(5)).alias("coder"),
        )

    notes = F.transform(F.filter("lines", lambda x: F.startswith(x, F.lit("A "))), annotation)
    if coder is not None:
        notes = F.filter(notes, lambda a: a["coder"] == coder)
    return blocks.select(
        "source",
        F.substring_index("source", ".", 1).alias("cefr"),
        F.split(F.substring(F.col("lines")[0], 3, 1 << 30), " ").alias("tokens"),
        notes.alias("annotations"),
    )


def _refuse(message: str) -> Column:
    return F.raise_error(F.lit(message)).cast("boolean")


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction lines with their required fields; a missing field or an empty file fails.

    A null prediction is legal, so presence is tested on the keys of the raw line.
    """
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    keys = F.json_object_keys("value")
    missing = F.array_except(
        F.array(*[F.lit(k) for k in ("req_uid", "text", "gold", "prediction")]), keys
    )
    n, absent = lines.agg(
        F.count("*"), F.max(F.when(F.size(missing) > 0, F.array_join(missing, ", ")))
    ).first()
    if not n:
        raise ValueError(f"{path} holds no predictions")
    if absent is not None:
        raise ValueError(f"a predictions line is missing {absent}")
    parsed = F.from_json("value", PREDICTIONS, {"mode": "FAILFAST"})
    return lines.select(parsed.alias("r")).select("r.*")


def scan_rows(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Dataset rows from JSON lines or parquet, by the suffix of the path."""
    if path.rstrip("/").endswith(".jsonl"):
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.json(path)
    rows = spark.read.parquet(path)
    return rows if schema is None else rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def scan_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Learner profiles from a JSON array; ids must be unique and every field filled."""
    rows = spark.read.schema(PROFILES).json(path, multiLine=True)
    check_profiles(rows)
    return rows


def check_profiles(rows: DataFrame) -> None:
    texts = [f.name for f in PROFILES if isinstance(f.dataType, T.StringType)]
    empty = F.lit(False)
    for c in texts:
        empty = empty | F.coalesce(strip(F.col(c)) == "", F.lit(True))
    legal = F.array(*[F.lit(t) for t in TAGS])
    facts = rows.agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("ids"),
        F.count_if(empty).alias("empty"),
        F.count_if(F.coalesce(F.size("error_bias") <= 0, F.lit(True))).alias("no_bias"),
        F.count_if(F.size(F.array_except("error_bias", legal)) > 0).alias("unknown"),
    ).first()
    if facts["n"] == 0:
        raise ValueError("the profile file lists nothing")
    if facts["empty"] or facts["no_bias"]:
        raise ValueError("a profile has a missing field")
    if facts["unknown"]:
        raise ValueError("a profile has unknown tags")
    if facts["ids"] != facts["n"]:
        raise ValueError("two profiles share an id")


def scan_pool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*POOL_COLUMNS)


def scan_texts_allowlisted(spark: SparkSession, path: str) -> DataFrame:
    """Only what a grader may see; request columns are not even read."""
    rows = spark.read.parquet(path)
    missing = [c for c in GRADER_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"the texts have no column {missing}")
    return rows.select(*GRADER_COLUMNS)


def content_fingerprint(rows: DataFrame, name: Column, content: Column) -> DataFrame:
    """Name, sha256 and size in bytes of every row's content; a null content counts as empty."""
    body = F.coalesce(content.cast("binary"), F.lit(b""))
    return rows.select(name.alias("file"), F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("long").alias("bytes"))


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and size per file; each file is read whole by one task, up to 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    return content_fingerprint(files, F.substring_index("path", "/", -1), F.col("content"))


#: Entries that one digest combines.
FAN_IN = 4096


def corpus_digest(fingerprints: DataFrame, levels: int | None = None) -> DataFrame:
    """One digest for a set of named contents, whatever their order.

    Entries are combined in a tree: first those whose hashed names share ``levels`` hex digits, then
    the digests of those groups that share one digit less, and so on. A group combines its
    entries in order, and ``levels``, at least 1, follows from the number of entries, so none has
    many more than ``FAN_IN``.
    """
    node = fingerprints.select(
        F.sha2("file", 256).alias("place"), F.sha2(F.concat_ws("|", "file", "sha256"), 256).alias("digest"), F.lit(1).alias("files")
    )
    if levels is None:
        levels, rest = 1, fingerprints.count() / FAN_IN / 16
        while rest > 1:
            levels, rest = levels + 1, rest / 16
    for level in range(levels, -1, -1):
        node = node.groupBy(F.substring("place", 1, level).alias("place")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ","), 256).alias("digest"),
            F.sum("files").alias("files"),
        )
    return node.select("files", F.col("digest").alias("corpus_sha256"))
