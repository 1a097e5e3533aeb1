"""Registered queries: sources, normalisation, quarantine, sampling, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import curate as C
from marginalia.operators import joins as J
from marginalia.operators import requests as R
from marginalia.operators import tally as T
from marginalia.operators.grading import parse_corrections
from marginalia.functions.text import shape_fault
from marginalia.plans import derive as D
from marginalia.plans.registry import SHARED, query, scratch, table
from marginalia.schemas import LOG, POOL, PREDICTIONS, QUARANTINE
from marginalia.sources import readers, sinks


@query("SELECT source_sense_id, definition, cefr_level, headword, pos FROM sense_rows")
def scan_senses(spark: SparkSession, d: str) -> DataFrame:
    return readers.scan_senses(D.senses(spark, d), D.entries(spark, d))


@query("""
SELECT pos, headword, count(*) AS n, CAST(sum(length(definition)) AS BIGINT) AS chars
FROM sense_rows GROUP BY pos, headword
""")
def join_senses_entries(spark: SparkSession, d: str) -> DataFrame:
    joined = J.join_senses_entries(D.senses(spark, d), D.entries(spark, d))
    return joined.groupBy("pos", "headword").agg(
        F.count("*").alias("n"), F.sum(F.length("definition")).cast("long").alias("chars")
    )


@query("""
SELECT CASE WHEN bad THEN NULL ELSE req_uid END AS req_uid, CASE WHEN bad THEN NULL ELSE event_id END AS seq,
  CASE WHEN bad THEN NULL ELSE event_type END AS text, bad
FROM (SELECT 'e' || event_id AS req_uid, event_id, event_type, event_id % 50 = 0 OR event_id % 51 = 0 AS bad
      FROM events WHERE event_id % 53 <> 0)
""")
def scan_jsonl_log(spark: SparkSession, d: str) -> DataFrame:
    """Events written as a log with torn, foreign and blank lines, and read back."""
    n = F.col("event_id")
    record = F.to_json(
        F.struct(
            F.concat(F.lit("e"), n.cast("string")).alias("req_uid"),
            n.alias("seq"),
            F.col("event_type").alias("text"),
        )
    )
    line = (
        F.when(n % 53 == 0, "  ")
        .when(n % 50 == 0, F.substring(record, F.lit(1), F.length(record) - 5))
        .when(n % 51 == 0, "[1, 2]")
        .otherwise(record)
    )
    path = scratch(spark)
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    rows = readers.scan_jsonl_log(spark, path, LOG, keep_bad=True)
    return rows.select("req_uid", "seq", "text", F.col("bad_line").isNotNull().alias("bad"))


def prediction_rows(spark: SparkSession, d: str) -> DataFrame:
    m = D.marked(spark, d)
    gold = F.struct(
        F.col("gold").alias("correction"),
        F.col("gold_meaning").alias("meaning"),
        F.col("gold_feedback").alias("feedback"),
    )
    pred = F.struct(
        F.col("pred").alias("correction"),
        F.col("pred_meaning").alias("meaning"),
        F.col("pred_feedback").alias("feedback"),
    )
    key = F.col("doc_id") + F.col("line_no")
    return m.select(
        "req_uid", "text", "target", F.lit("a line").alias("definition"),
        F.lit("noun").alias("pos"), gold.alias("gold"),
        F.when(key % 14 != 0, pred).alias("prediction"),
        ((key % 100) / 100.0).alias("meaning_confidence"), (key % 3).cast("int").alias("retries"),
        F.lit("").alias("note"),
    )


SHARED["predictions"] = """
SELECT req_uid, text, target, gold AS gold_correction, gold_meaning, gold_feedback,
  (doc_id + line_no) % 14 <> 0 AS answered,
  CASE WHEN (doc_id + line_no) % 14 <> 0 THEN pred END AS pred_correction,
  CASE WHEN (doc_id + line_no) % 14 <> 0 THEN pred_meaning END AS pred_meaning,
  CASE WHEN (doc_id + line_no) % 14 <> 0 THEN pred_feedback END AS pred_feedback,
  CAST((doc_id + line_no) % 3 AS INTEGER) AS retries FROM marked
"""


@query("""
SELECT req_uid, text, gold_correction, gold_meaning, gold_feedback, pred_correction, pred_meaning, answered, retries
FROM predictions
""")
def scan_predictions(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    prediction_rows(spark, d).write.option("ignoreNullFields", False).json(path)
    p = readers.scan_predictions(spark, path)
    assert p.schema == PREDICTIONS
    return p.select(
        "req_uid", "text", F.col("gold.correction").alias("gold_correction"),
        F.col("gold.meaning").alias("gold_meaning"), F.col("gold.feedback").alias("gold_feedback"),
        F.col("prediction.correction").alias("pred_correction"),
        F.col("prediction.meaning").alias("pred_meaning"),
        F.col("prediction").isNotNull().alias("answered"), "retries",
    )


@query("""
SELECT row_id, text, fmt FROM lines, (VALUES ('jsonl'), ('parquet')) f(fmt)
""")
def scan_rows(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    rows = D.lines(spark, d).select("row_id", "text")
    rows.write.json(f"{path}/rows.jsonl")
    rows.write.parquet(f"{path}/rows.parquet")
    one = readers.scan_rows(spark, f"{path}/rows.jsonl", rows.schema).withColumn("fmt", F.lit("jsonl"))
    two = readers.scan_rows(spark, f"{path}/rows.parquet").withColumn("fmt", F.lit("parquet"))
    return C.union_sources(one, two)


@query("SELECT id, l1, cefr, bias1 || ',' || bias2 AS bias, length, traits FROM profiles")
def scan_profiles(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    packed = F.collect_list(F.struct(*D.profiles(spark, d).columns))
    D.profiles(spark, d).agg(F.to_json(packed).alias("value")).coalesce(1).write.text(path)
    rows = readers.scan_profiles(spark, path)
    return rows.select("id", "l1", "cefr", F.array_join("error_bias", ",").alias("bias"), "length", "traits")


@query("SELECT sense_uid, target, target_norm, pos, definition, cefr, is_multiword, is_placeholder FROM pool")
def scan_pool(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    sinks.sink_fixed_schema(D.sense_tables(spark, d)[0], POOL, path, "sense_uid")
    return readers.scan_pool(spark, path)


@query("""
SELECT sense_uid, source_sense_id, target, pos, is_multiword, NULL::VARCHAR AS source_db_sha256 FROM pool
""")
def sink_fixed_schema(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    sinks.sink_fixed_schema(D.sense_tables(spark, d)[0], POOL, path, "sense_uid")
    return spark.read.parquet(path).select(
        "sense_uid", "source_sense_id", "target", "pos", "is_multiword", "source_db_sha256"
    )


@query("""
SELECT req_uid, doc_id || '-' || source AS sense_uid, target, 'noun' AS pos, lang AS definition, text FROM marked
""")
def scan_texts_allowlisted(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    m = D.marked(spark, d)
    m.select(
        "req_uid", F.concat_ws("-", "doc_id", "source").alias("sense_uid"), "target",
        F.lit("noun").alias("pos"), F.col("lang").alias("definition"), "text",
        F.col("meaning").alias("meaning_req"), F.lit("few").alias("error_spec"),
    ).write.parquet(path)
    return readers.scan_texts_allowlisted(spark, path)


def page_prints(spark: SparkSession, d: str) -> DataFrame:
    """The pages as files of their own, named by id."""
    pages = table(spark, d, "pages")
    return readers.content_fingerprint(pages, F.concat(F.lit("page-"), F.col("page_id").cast("string")), F.col("html"))


SHARED["page_prints"] = "SELECT 'page-' || page_id AS file, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS bytes FROM pages"


@query("SELECT file, sha256, bytes FROM page_prints")
def file_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return page_prints(spark, d)


@query("""
SELECT CAST(sum(files) AS BIGINT) AS files, sha256(string_agg(digest, ',' ORDER BY digest)) AS corpus_sha256
FROM (SELECT substr(place, 1, 1) AS place, count(*) AS files, sha256(string_agg(digest, ',' ORDER BY digest)) AS digest
  FROM (SELECT sha256(file) AS place, sha256(file || '|' || sha256) AS digest FROM page_prints) GROUP BY substr(place, 1, 1))
""")
def corpus_digest(spark: SparkSession, d: str) -> DataFrame:
    return readers.corpus_digest(page_prints(spark, d))


@query("""
SELECT req_uid, json_extract_string(j, '$.correction') AS correction, CAST(json_extract(j, '$.meaning') AS INTEGER) AS meaning,
  json_extract_string(j, '$.feedback') AS feedback, json_keys(j)::VARCHAR = '[correction, feedback, meaning]' AS key_order
FROM (SELECT req_uid, to_json({'correction': gold, 'feedback': gold_feedback, 'meaning': gold_meaning}) AS j FROM marked)
""")
def training_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = D.marked(spark, d).select(
        "req_uid", "target", "text", F.lit("").alias("definition"), F.lit("noun").alias("pos"),
        F.col("gold").alias("correction"), F.col("gold_meaning").alias("meaning"),
        F.col("gold_feedback").alias("feedback"),
    )
    c = F.col("completion")
    return sinks.training_pairs(rows).select(
        "req_uid",
        F.get_json_object(c, "$.correction").alias("correction"),
        F.get_json_object(c, "$.meaning").cast("int").alias("meaning"),
        F.get_json_object(c, "$.feedback").alias("feedback"),
        (F.array_join(F.json_object_keys(c), ",") == "correction,feedback,meaning").alias("key_order"),
    )


# --- projections -------------------------------------------------------------------------


@query("""
SELECT id, headword, CASE lower(trim(pos)) WHEN 'noun' THEN 'noun' WHEN 'verb' THEN 'verb'
    WHEN 'phrasal verb' THEN 'phrasal verb' WHEN 'adj' THEN 'adjective' WHEN 'idiom' THEN 'idiom' END AS pos_norm,
  CASE lower(trim(pos)) WHEN '' THEN 'excluded_pos' WHEN 'prefix' THEN 'excluded_pos' WHEN 'weird' THEN 'unmappable_pos'
    ELSE 'ok' END AS pos_status FROM entries
""")
def normalize_pos(spark: SparkSession, d: str) -> DataFrame:
    return C.normalize_pos(D.entries(spark, d), "pos").select("id", "headword", "pos_norm", "pos_status")


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS target_norm
FROM documents
""")
def normalize_target(spark: SparkSession, d: str) -> DataFrame:
    return C.normalize_target(table(spark, d, "documents"), "text").select("doc_id", "target_norm")


@query("""
SELECT id, pos IN ('phrasal verb', 'idiom') OR contains(trim(headword), ' ') AS is_multiword FROM entries
""")
def flag_multiword(spark: SparkSession, d: str) -> DataFrame:
    rows = D.entries(spark, d).withColumnRenamed("headword", "target")
    return C.flag_multiword(rows).select("id", "is_multiword")


@query("SELECT id, headword LIKE '%sth' AS is_placeholder FROM entries")
def flag_placeholder(spark: SparkSession, d: str) -> DataFrame:
    rows = D.entries(spark, d).withColumnRenamed("headword", "target")
    return C.flag_placeholder(rows).select("id", "is_placeholder")


@query("SELECT doc_id, substr(sha256(source || '|' || lang || '|' || text), 1, 16) AS uid FROM documents")
def content_uid(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return C.content_uid(docs, ["source", "lang", "text"], "|").select("doc_id", "uid")


@query("""
SELECT CAST(source_sense_id AS VARCHAR) AS source_sense_id, coalesce(reason, 'pool') AS outcome,
  CASE WHEN reason IS NULL THEN sense_uid END AS sense_uid, CASE WHEN reason IS NULL THEN pos ELSE raw_pos END AS pos
FROM sense_checked
""")
def sense_quarantine(spark: SparkSession, d: str) -> DataFrame:
    pool, refused = D.sense_tables(spark, d)
    assert sinks.as_schema(refused, QUARANTINE).columns == QUARANTINE.fieldNames()
    return pool.select("source_sense_id", F.lit("pool").alias("outcome"), "sense_uid", "pos").unionByName(
        refused.select(
            "source_sense_id",
            F.col("reason").alias("outcome"),
            F.lit(None).cast("string").alias("sense_uid"),
            F.col("raw_pos").alias("pos"),
        )
    )


@query("""
SELECT 'pool_rows' AS section, 'all' AS key, count(*) AS n FROM pool
UNION ALL SELECT 'pos', pos, count(*) FROM pool GROUP BY pos
UNION ALL SELECT 'cefr', coalesce(cefr, 'null'), count(*) FROM pool GROUP BY cefr
UNION ALL SELECT 'multiword_rows', 'all', count(*) FROM pool WHERE is_multiword HAVING count(*) > 0
UNION ALL SELECT 'placeholder_rows', 'all', count(*) FROM pool WHERE is_placeholder HAVING count(*) > 0
UNION ALL SELECT 'target_groups', 'all', count(DISTINCT target_norm) FROM pool
UNION ALL SELECT 'quarantine', reason, count(*) FROM sense_checked WHERE reason IS NOT NULL GROUP BY reason
""")
def pool_quality(spark: SparkSession, d: str) -> DataFrame:
    return C.pool_quality(*D.sense_tables(spark, d))


SHAPE = r"""CASE WHEN t = '' THEN 'empty' WHEN length(t) < 3 THEN 'too_short' WHEN length(t) > 600 THEN 'too_long'
  WHEN contains(t, chr(10)) THEN 'multiline' END"""


@query(rf"""
SELECT doc_id, {SHAPE} AS shape_fault FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)
""")
def sentence_shape_check(spark: SparkSession, d: str) -> DataFrame:
    return R.sentence_shape_check(table(spark, d, "documents")).select("doc_id", "shape_fault")


@query("""
SELECT req_uid, target_present, meaning_req > 0 AND error_spec <> 'unreadable' AND NOT target_present AS target_absent
FROM (SELECT req_uid, coalesce(gold_meaning, 0) AS meaning_req, CASE WHEN line_no % 5 = 4 THEN 'unreadable' ELSE 'few' END AS error_spec,
        contains(lower(text), lang) OR ((doc_id + line_no) % 3 = 0 AND contains(lower(text), 'talk')) AS target_present FROM marked)
""")
def target_present(spark: SparkSession, d: str) -> DataFrame:
    rows = D.marked(spark, d).withColumn("meaning_req", F.col("gold_meaning")).withColumn(
        "error_spec", F.when(F.col("line_no") % 5 == 4, "unreadable").otherwise("few")
    )
    return R.target_present(rows).select("req_uid", "target_present", "target_absent")


def row_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.derive_row_stats(parse_corrections(D.marked(spark, d), "gold"))


SHARED["row_stats"] = """
SELECT m.req_uid, m.lang, CAST(c.n_words AS INTEGER) AS n_words, CAST(coalesce(e.n, 0) AS INTEGER) AS n_edits,
  coalesce(e.tags, '') AS tags, coalesce(e.tag_list, []) AS tag_list
FROM marked m JOIN word_counts c ON c.req_uid = m.req_uid
LEFT JOIN (SELECT req_uid, count(*) AS n, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, list_distinct(list(tag)) AS tag_list
           FROM gold_pairs GROUP BY req_uid) e ON e.req_uid = m.req_uid
"""


@query("SELECT req_uid, n_words, n_edits, tags FROM row_stats")
def derive_row_stats(spark: SparkSession, d: str) -> DataFrame:
    return row_stats(spark, d).select("req_uid", "n_words", "n_edits", F.array_join("tags", ",").alias("tags"))


@query("""
SELECT lang, edit_bucket, count(*) AS n FROM (SELECT lang, CASE WHEN n_edits = 0 THEN 'clean' WHEN n_edits = 1 THEN 'one'
  WHEN n_edits <= 3 THEN 'few' ELSE 'many' END AS edit_bucket FROM row_stats) GROUP BY lang, edit_bucket
""")
def edit_bucket(spark: SparkSession, d: str) -> DataFrame:
    return C.edit_bucket(row_stats(spark, d)).groupBy("lang", "edit_bucket").agg(F.count("*").alias("n"))


@query("SELECT req_uid, n_words FROM row_stats WHERE n_words >= 3")
def drop_fragments(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_fragments(row_stats(spark, d)).select("req_uid", "n_words")


@query("""
SELECT l.row_id, l.text FROM lines l JOIN word_counts c ON c.req_uid = l.row_id WHERE c.n_words <= 200
""")
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_within_length(D.lines(spark, d).select("row_id", "text"), f"{path}/fitting", 200)
    return spark.read.parquet(f"{path}/fitting")


# --- duplicates, caps, splits ------------------------------------------------------------


@query("""
SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1
""")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return C.dedupe_first(docs.withColumn("h", F.sha2("text", 256)), "h", "doc_id").select("doc_id", "text")


@query("""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r > 1
""")
def later_copies(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return C.later_copies(docs, "h", "doc_id").select("doc_id")


@query("""
SELECT row_id, lang FROM (SELECT row_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7|' || row_id)) AS r,
  greatest(1, CAST(floor(count(*) OVER () * 0.15::DOUBLE) AS BIGINT)) AS cap FROM lines) WHERE r <= cap
""")
def cap_strata(spark: SparkSession, d: str) -> DataFrame:
    rows = D.lines(spark, d)
    return C.cap_strata(rows, ["lang"], 0.15, 7, uid="row_id").select("row_id", "lang")


@query("SELECT lang, source, count(*) AS n FROM lines GROUP BY lang, source")
def stratum_distribution(spark: SparkSession, d: str) -> DataFrame:
    return T.stratum_distribution(D.lines(spark, d), ["lang", "source"])


def bucket_sql(seed: int, key: str) -> str:
    return f"('0x' || substr(sha256('{seed}|' || {key}), 1, 16))::UBIGINT % 10000"


SHARED["split_lines"] = f"""
SELECT *, CASE WHEN point < 0.8::DOUBLE THEN 'train' WHEN point < 0.9::DOUBLE THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, ({bucket_sql(11, "source || '/' || lang")})::DOUBLE / 10000 AS point FROM lines)
"""


def split_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = D.lines(spark, d).withColumn("target_norm", F.concat_ws("/", "source", "lang"))
    return C.group_split(rows, "target_norm", 11)


@query("SELECT row_id, split, 11::BIGINT AS seed FROM split_lines")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return split_lines(spark, d).select("row_id", "split", "seed")


@query(f"""
SELECT row_id, CASE WHEN ({bucket_sql(3, "row_id")})::DOUBLE / 10000 < 0.05::DOUBLE THEN 'val' ELSE 'train' END AS split FROM lines
""")
def row_split(spark: SparkSession, d: str) -> DataFrame:
    return C.row_split(D.lines(spark, d), "row_id", 3).select("row_id", "split")


@query("""
SELECT (SELECT count(*) FROM (SELECT text FROM split_lines GROUP BY text HAVING count(DISTINCT split) > 1)) AS cross_split_text_hashes,
  count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test
FROM split_lines
""")
def contamination(spark: SparkSession, d: str) -> DataFrame:
    return C.contamination(split_lines(spark, d))


@query("""
SELECT sha256(text) AS text_hash, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
  count(*) FILTER (split = 'test') AS test FROM split_lines GROUP BY text HAVING count(DISTINCT split) > 1
""")
def text_overlap(spark: SparkSession, d: str) -> DataFrame:
    return C.text_overlap(split_lines(spark, d))


@query("""
SELECT row_id, text FROM split_lines WHERE split = 'test' AND text NOT IN (SELECT text FROM split_lines WHERE split <> 'test')
""")
def strict_test(spark: SparkSession, d: str) -> DataFrame:
    return C.strict_test(split_lines(spark, d)).select("row_id", "text")


@query("SELECT split, count(*) AS n FROM split_lines GROUP BY split")
def split_nonempty_gate(spark: SparkSession, d: str) -> DataFrame:
    return sinks.split_nonempty_gate(split_lines(spark, d), ["train", "val", "test"])


@query(rf"""
SELECT part, split, count(*) AS n FROM (
  SELECT 'processed' AS part, split FROM usable_lines UNION ALL
  SELECT 'test_strict', split FROM usable_lines WHERE split = 'test' AND text NOT IN (SELECT text FROM usable_lines WHERE split <> 'test')
  UNION ALL SELECT 'rejects', {SHAPE} FROM (SELECT trim(text) AS t FROM split_lines) WHERE {SHAPE} IS NOT NULL)
GROUP BY part, split
""")
def sink_splits(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    rows = split_lines(spark, d).withColumn("reject_reason", shape_fault(F.col("text")))
    good = rows.where(F.col("reject_reason").isNull()).drop("reject_reason")
    sinks.sink_splits(good, rows.where(F.col("reject_reason").isNotNull()), path, 5, uid="row_id", splits=["train", "val", "test"])
    read = spark.read.parquet
    parts = C.union_sources(
        read(f"{path}/processed").select(F.lit("processed").alias("part"), "split"),
        read(f"{path}/test_strict").select(F.lit("test_strict").alias("part"), "split"),
        read(f"{path}/rejects").select(F.lit("rejects").alias("part"), F.col("reject_reason").alias("split")),
    )
    return parts.groupBy("part", "split").agg(F.count("*").alias("n"))


SHARED["usable_lines"] = rf"SELECT * FROM (SELECT *, trim(text) AS t FROM split_lines) WHERE {SHAPE} IS NULL"


@query("""
SELECT 'lang' AS section, lang AS key, count(*) AS n FROM lines GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM lines GROUP BY source
""")
def sink_report(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    found = T.tally(D.lines(spark, d), lang=F.col("lang"), source=F.col("source"))
    sinks.sink_report(found, path)
    return spark.read.schema(found.schema).json(path)


@query("SELECT row_id, text FROM lines ORDER BY sha256('9|' || row_id) LIMIT 100")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.seeded_sample(D.lines(spark, d), 100, 9, uid="row_id").select("row_id", "text")


@query("SELECT row_id, source FROM lines ORDER BY source, row_id")
def ordered_output(spark: SparkSession, d: str) -> DataFrame:
    return C.ordered_output(D.lines(spark, d).select("row_id", "source"), ["source", "row_id"])


@query("""
SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark
UNION ALL SELECT 'conversations', text FROM conversations
""")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    return C.union_sources(
        *[
            table(spark, d, t).select(F.lit(t).alias("origin"), "text")
            for t in ("documents", "benchmark", "conversations")
        ]
    )


# --- joins -------------------------------------------------------------------------------


@query("""
SELECT d.doc_id, l.quality, l.toxic, d.source, d.text, l.quality AS lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id
""")
def join_texts_labels(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, d, "labels").withColumn("lang", F.col("quality"))
    return J.join_texts_labels(texts, labels, "doc_id")


@query("""
SELECT l.quality, d.lang, count(*) AS n, CAST(sum(d.n_chars) AS BIGINT) AS chars
FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY l.quality, d.lang
""")
def join_texts_labels_strict(spark: SparkSession, d: str) -> DataFrame:
    joined = J.join_texts_labels_strict(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")
    return joined.groupBy("quality", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""
SELECT g.req_uid, g.gold, p.pred, p.req_uid IS NOT NULL AS has_prediction
FROM marked g LEFT JOIN (SELECT req_uid, pred FROM marked WHERE doc_id % 9 <> 0) p ON p.req_uid = g.req_uid
""")
def join_prediction_gold(spark: SparkSession, d: str) -> DataFrame:
    m = D.marked(spark, d)
    joined = J.join_prediction_gold(
        m.where(F.col("doc_id") % 9 != 0).select("req_uid", F.col("pred").alias("correction")),
        m.select("req_uid", F.col("gold").alias("correction")),
    )
    return joined.select(
        "req_uid",
        F.col("gold.correction").alias("gold"),
        F.col("prediction.correction").alias("pred"),
        F.col("prediction").isNotNull().alias("has_prediction"),
    )


# --- requests ----------------------------------------------------------------------------

SHARED["sense_classes"] = """
SELECT sha256('5|' || row_id) AS o, row_id AS sense_uid, lang <> 'en' AS is_multiword FROM lines
"""


@query("""
SELECT sense_uid, is_multiword FROM (
  SELECT *, row_number() OVER (PARTITION BY is_multiword ORDER BY o) AS r,
    least(count(*) FILTER (is_multiword) OVER (), CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT)) AS want_multi
  FROM (SELECT *, count(*) OVER () // 3 AS n FROM sense_classes))
WHERE r <= CASE WHEN is_multiword THEN want_multi ELSE n - want_multi END
""")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = D.lines(spark, d).select(F.col("row_id").alias("sense_uid"), (F.col("lang") != "en").alias("is_multiword"))
    return R.quota_sample(rows, rows.count() // 3, 5)


MEANING_WEIGHTS = {0: 0.6, 1: 1.2, 2: 1.5, 3: 1.2, 4: 0.9}
ERROR_WEIGHTS = {"none": 0.8, "one": 1.3, "few": 1.4, "many": 1.0, "unreadable": 0.3}


def specs_for(spark: SparkSession, d: str) -> DataFrame:
    pool = D.sense_tables(spark, d)[0]
    drawn = R.draw_cells(pool, 6, MEANING_WEIGHTS, ERROR_WEIGHTS, 42)
    return R.draw_profile(drawn, D.profiles(spark, d), 42)


SHARED["drawn"] = """
SELECT sense_uid, m, e, r FROM (
  SELECT *, row_number() OVER (PARTITION BY sense_uid ORDER BY key, m * 5 + ei) AS r FROM (
    SELECT p.sense_uid, m, ei, e,
      -ln((('0x' || substr(sha256('42|' || p.sense_uid || '|' || m || '|' || e || '|0'), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0)
        / (([0.6, 1.2, 1.5, 1.2, 0.9]::DOUBLE[])[m + 1] * ([0.8, 1.3, 1.4, 1.0, 0.3]::DOUBLE[])[ei + 1]) AS key
    FROM pool p, (SELECT unnest(range(5)) AS m) ms, (SELECT unnest(range(5)) AS ei, unnest(['none', 'one', 'few', 'many', 'unreadable']) AS e) es))
WHERE r <= 6
"""
SHARED["spec_rows"] = """
SELECT *, substr(sha256(sense_uid || '|' || m || '|' || e || '|' || profile_id || '|42'), 1, 16) AS spec_id FROM (
  SELECT d.*, CASE WHEN m >= 3 THEN everyone[CAST(h % len(everyone) AS INTEGER) + 1] ELSE learners[CAST(h % len(learners) AS INTEGER) + 1] END AS profile_id
  FROM (SELECT *, ('0x' || substr(sha256('42|profile|' || sense_uid || '|' || m || '|' || e), 1, 13))::UBIGINT AS h FROM drawn) d,
       (SELECT list(id ORDER BY id) AS everyone, list(id ORDER BY id) FILTER (l1 <> 'none') AS learners FROM profiles))
"""


@query("SELECT sense_uid, CAST(r - 1 AS INTEGER) AS place, CAST(m AS INTEGER) AS meaning_req, e AS error_spec FROM drawn")
def draw_cells(spark: SparkSession, d: str) -> DataFrame:
    drawn = R.draw_cells(D.sense_tables(spark, d)[0], 6, MEANING_WEIGHTS, ERROR_WEIGHTS, 42)
    return drawn.select("sense_uid", F.posexplode("cells").alias("place", "c")).select(
        "sense_uid", "place", "c.meaning_req", "c.error_spec"
    )


@query("SELECT sense_uid, CAST(m AS INTEGER) AS meaning_req, e AS error_spec, profile_id FROM spec_rows")
def draw_profile(spark: SparkSession, d: str) -> DataFrame:
    return specs_for(spark, d).select("sense_uid", F.inline("cells"))


@query("""
SELECT spec_id, substr(sha256(s.sense_uid || '|' || b.ids), 1, 16) AS batch_uid, s.sense_uid, p.target, CAST(m AS INTEGER) AS meaning_req,
  e AS error_spec, s.profile_id, 42::BIGINT AS seed
FROM spec_rows s JOIN (SELECT sense_uid, string_agg(spec_id, '|' ORDER BY r) AS ids FROM spec_rows GROUP BY sense_uid) b ON b.sense_uid = s.sense_uid
JOIN pool p ON p.sense_uid = s.sense_uid
""")
def flatten_specs(spark: SparkSession, d: str) -> DataFrame:
    return R.flatten_specs(specs_for(spark, d), 42).select(
        "spec_id", "batch_uid", "sense_uid", "target", "meaning_req", "error_spec", "profile_id", "seed"
    )


@query("""
SELECT 'specs' AS section, 'all' AS key, count(*) AS n FROM spec_rows
UNION ALL SELECT 'meaning_req', CAST(m AS VARCHAR), count(*) FROM spec_rows GROUP BY m
UNION ALL SELECT 'error_spec', e, count(*) FROM spec_rows GROUP BY e
UNION ALL SELECT 'profile', profile_id, count(*) FROM spec_rows GROUP BY profile_id
UNION ALL SELECT 'senses', 'all', count(*) FROM pool
UNION ALL SELECT 'multiword_senses', 'all', count(*) FROM pool WHERE is_multiword
""")
def sample_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.sample_stats(R.flatten_specs(specs_for(spark, d), 42))


@query("""
SELECT s.row_id AS spec_id, s.source AS batch_uid, CAST(row_number() OVER (PARTITION BY source ORDER BY row_id) - 1 AS INTEGER) AS member_index,
  count(*) OVER (PARTITION BY source) AS batch_size FROM lines s
""")
def batch_members(spark: SparkSession, d: str) -> DataFrame:
    rows = D.lines(spark, d).select(F.col("row_id").alias("spec_id"), F.col("source").alias("batch_uid"))
    return R.batch_members(rows).select("spec_id", "batch_uid", "member_index", "batch_size")


def batch_specs(spark: SparkSession, d: str) -> DataFrame:
    return D.lines(spark, d).select(
        F.col("row_id").alias("spec_id"), F.col("doc_id").cast("string").alias("batch_uid"),
        F.col("source").alias("sense_uid"), F.col("lang").alias("target"),
        F.col("lang").alias("target_norm"), F.lit("noun").alias("pos"),
        F.lit("a line").alias("definition"), F.lit(None).cast("string").alias("cefr"),
        F.lit(False).alias("is_multiword"), F.lit(False).alias("is_placeholder"),
        F.concat(F.lit("nation_"), (F.col("doc_id") % 30).cast("string")).alias("profile_id"),
        (F.col("line_no") % 5).cast("int").alias("meaning_req"),
        F.when(F.col("line_no") % 4 == 3, "unreadable").otherwise("few").alias("error_spec"),
    )


def batch_responses(spark: SparkSession, d: str) -> DataFrame:
    """One reply per document, in the row: some lose, repeat or invent a sentence."""
    doc = F.col("doc_id")

    def sentence(t: object, i: object) -> object:
        return F.struct(F.concat_ws(":", doc, i).alias("spec_id"), F.concat(F.lit(" "), t).alias("text"))

    every = F.transform(F.split("text", "\n"), lambda t, i: sentence(t, i))
    foreign = F.struct(F.lit("nobody").alias("spec_id"), F.lit("x").alias("text"))
    sentences = (
        F.when(doc % 10 == 0, F.slice(every, F.lit(2), F.size(every)))
        .when(doc % 10 == 1, F.concat(every, F.slice(every, 1, 1)))
        .when(doc % 10 == 2, F.concat(every, F.array(foreign)))
        .otherwise(every)
    )
    docs = table(spark, d, "documents")
    asked = docs.where(doc % 7 != 3).select(
        doc.cast("string").alias("batch_uid"),
        F.to_json(F.struct(sentences.alias("sentences"))).alias("response"),
        F.lit("response").alias("kind"),
    )
    done = docs.select(doc.cast("string").alias("batch_uid"), F.lit("{}").alias("response"), F.lit("batch_done").alias("kind"))
    return asked.unionByName(done)


@query("""
SELECT CAST(doc_id AS VARCHAR) AS batch_uid, CASE doc_id % 10 WHEN 0 THEN 'missing_spec_id' WHEN 1 THEN 'duplicate_spec_id'
  WHEN 2 THEN 'unexpected_spec_id' END AS batch_fault, CAST(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS missing,
  count(*) AS requested FROM lines WHERE doc_id % 7 <> 3 GROUP BY doc_id
""")
def response_id_check(spark: SparkSession, d: str) -> DataFrame:
    replies = batch_responses(spark, d).where(F.col("kind") == "response")
    got = replies.select(
        "batch_uid", F.explode_outer(F.from_json("response", R.RESPONSE)["sentences"]).alias("s")
    ).select("batch_uid", "s.spec_id")
    return R.response_id_check(got, batch_specs(spark, d))


SHARED["batch_rows"] = rf"""
SELECT doc_id, row_id AS req_uid, CAST(doc_id AS VARCHAR) AS batch_uid, coalesce({SHAPE}, CASE WHEN line_no % 5 > 0 AND line_no % 4 <> 3 AND NOT contains(lower(t), lang) THEN 'target_absent' END)
  AS reject_reason, t AS text
FROM (SELECT *, trim(text) AS t FROM lines WHERE doc_id % 7 <> 3 AND doc_id % 10 > 2)
"""


@query(rf"""
SELECT row_id AS req_uid, CAST(doc_id AS VARCHAR) AS batch_uid, CASE doc_id % 10 WHEN 0 THEN 'missing_spec_id' WHEN 1 THEN 'duplicate_spec_id'
    WHEN 2 THEN 'unexpected_spec_id' ELSE coalesce({SHAPE}, CASE WHEN line_no % 5 > 0 AND line_no % 4 <> 3 AND NOT contains(lower(t), lang) THEN 'target_absent' END)
  END AS reject_reason, CASE WHEN doc_id % 10 <> 0 OR line_no > 0 THEN t END AS text
FROM (SELECT *, trim(text) AS t FROM lines WHERE doc_id % 7 <> 3)
""")
def expand_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = R.expand_batches(batch_responses(spark, d), batch_specs(spark, d), refused=True)
    return rows.select("req_uid", "batch_uid", "reject_reason", "text")


@query("""
SELECT DISTINCT CAST(doc_id AS VARCHAR) AS batch_uid, CASE doc_id % 10 WHEN 0 THEN 'missing_spec_id' WHEN 1 THEN 'duplicate_spec_id' ELSE 'unexpected_spec_id' END AS batch_fault,
  1::BIGINT AS n FROM lines WHERE doc_id % 7 <> 3 AND doc_id % 10 <= 2
""")
def refused_batches(spark: SparkSession, d: str) -> DataFrame:
    return R.refused_batches(batch_responses(spark, d), batch_specs(spark, d))


@query("""
SELECT row_id AS spec_id, 'nation_' || doc_id % 30 AS profile_id, coalesce(p.traits, 'a language learner') AS traits
FROM lines LEFT JOIN profiles p ON p.id = 'nation_' || doc_id % 30
""")
def join_spec_traits(spark: SparkSession, d: str) -> DataFrame:
    joined = R.join_spec_traits(batch_specs(spark, d), D.profiles(spark, d))
    return joined.select("spec_id", "profile_id", "traits")


SHARED["grams"] = """
SELECT source, row_id, n, unnest([array_to_string(t[i:i + n - 1], ' ') FOR i IN range(1, len(t) - n + 2)]) AS gram
FROM (SELECT source, row_id, n, regexp_extract_all(lower(text), '[a-z0-9'']+') AS t FROM lines, (VALUES (2), (3)) k(n)) WHERE len(t) >= n
"""


@query("SELECT gram AS ngram, count(*) AS n FROM grams WHERE n = 2 GROUP BY gram")
def tokenize_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return R.tokenize_ngrams(D.lines(spark, d), "text", 2).groupBy("ngram").agg(F.count("*").alias("n"))


@query("""
SELECT b.source AS batch_uid, b.texts, round(coalesce(d2, 1.0), 6) AS distinct2, round(coalesce(d3, 1.0), 6) AS distinct3, coalesce(d2, 1.0) < 0.7 AS collapsed
FROM (SELECT source, count(*) AS texts FROM lines GROUP BY source) b LEFT JOIN (
  SELECT source, count(DISTINCT gram) FILTER (n = 2) / nullif(count(*) FILTER (n = 2), 0)::DOUBLE AS d2,
    count(DISTINCT gram) FILTER (n = 3) / nullif(count(*) FILTER (n = 3), 0)::DOUBLE AS d3 FROM grams GROUP BY source) g ON g.source = b.source
""")
def batch_diversity(spark: SparkSession, d: str) -> DataFrame:
    found = R.batch_diversity(D.lines(spark, d), "source", "text")
    return found.select(
        "batch_uid", "texts", F.round("distinct2", 6).alias("distinct2"),
        F.round("distinct3", 6).alias("distinct3"), "collapsed",
    )
