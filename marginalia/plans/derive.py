"""Inputs derived from the given tables, and the same derivations in SQL.

No learner corpus is given, so lines of ``documents`` are the sentences. Every few words one
is marked as edited; which edit, tag, band and comment a line gets follows from its numbers.
The SQL side never parses markup: it places the same edits by word offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans.registry import SHARED, spread, table
from marginalia.schemas import TAGS

TAG_LIST = "[" + ", ".join(f"'{t}'" for t in TAGS) + "]"


def tag_at(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TAGS]), (n % len(TAGS) + 1).cast("int"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "text")
    ).select(
        F.concat_ws(":", "doc_id", "line_no").alias("row_id"),
        "doc_id", "line_no", "lang", "source", "text",
    )


SHARED["lines"] = """
SELECT doc_id || ':' || line_no AS row_id, * FROM (
  SELECT doc_id, lang, source, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no,
         unnest(string_split(text, chr(10))) AS text
  FROM documents)
"""


def _edited(gold: bool) -> Column:
    """The line with its words turned into edits where the rule says so."""
    doc, line = F.col("doc_id"), F.col("line_no")
    key = doc + line

    def word(w: Column, i: Column) -> Column:
        planned = (i + key) % 7 == 3
        kind = (i + doc) % 4
        shift = F.lit(0) if gold else F.when(i % 4 == 1, 1).otherwise(0)
        tag = tag_at(doc + i * 3 + shift)

        def token(old: Column, new: Column, t: Column) -> Column:
            return F.concat(F.lit("["), old, F.lit(">"), new, F.lit(":"), t, F.lit("]"))

        fix = F.concat(F.lit("fix"), F.length(w).cast("string"))
        marked = (
            F.when(kind == 3, F.concat(token(F.lit(""), F.lit("the"), tag), F.lit(" "), w))
            .when(kind == 2, token(w, F.lit(""), tag))
            .otherwise(token(w, fix, tag))
        )
        usable = w != ""
        if gold:
            return F.when(planned & usable, marked).otherwise(w)
        extra = (i + key) % 11 == 5
        return (
            F.when(planned & (i % 5 != 2) & usable, marked)
            .when(extra & ~planned & usable, token(w, F.lit("x"), tag_at(i + F.lit(0))))
            .otherwise(w)
        )

    body = F.array_join(F.transform(F.split("text", " "), word), " ")
    ends = key % 5 == 0 if gold else key % 10 == 0
    return F.concat(body, F.when(ends, F.lit(" [>too:coll]")).otherwise(F.lit("")))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a reference, a prediction, and a raw grading that has every fault."""
    doc, line = F.col("doc_id"), F.col("line_no")
    key = doc + line
    lost = (doc * 7 + line) % 13 == 0
    fault = (
        F.when(key % 17 == 1, " [oops")
        .when(key % 17 == 2, " [a>b:zzz]")
        .when(key % 17 == 3, " [>:sp]")
        .when(key % 17 == 4, " extra")
        .otherwise("")
    )
    note = (doc + line * 3) % 11
    base = lines(spark, sf_dir).withColumn("_gold", _edited(True)).withColumn("_pred", _edited(False))
    return base.select(
        F.col("row_id").alias("req_uid"),
        "doc_id",
        "line_no",
        "lang",
        "source",
        "text",
        F.when(~lost, F.col("_gold")).alias("gold"),
        F.when(~(lost & (key % 2 == 0)) & (key % 19 != 0), F.col("_pred")).alias("pred"),
        F.when(~lost, F.concat("_gold", fault)).alias("correction"),
        F.when((doc + line * 5) % 31 != 0, (doc * 3 + line) % 6).cast("int").alias("meaning"),
        F.when(note == 0, "")
        .when(note == 1, "   ")
        .when(note == 2, "Good start. But fix the verb.")
        .when(note == 3, None)
        .otherwise(F.concat(F.lit("The "), "lang", F.lit(" line from "), "source", F.lit(" reads well.")))
        .alias("feedback"),
        ((doc * 3 + line) % 5).cast("int").alias("gold_meaning"),
        ((doc + line * 2) % 5).cast("int").alias("pred_meaning"),
        F.concat(F.lit("The "), "lang", F.lit(" line from "), "source", F.lit(" reads well.")).alias(
            "gold_feedback"
        ),
        F.concat(F.lit("This "), "lang", F.lit(" line of "), "source", F.lit(" reads fine.")).alias(
            "pred_feedback"
        ),
        F.when(key % 3 == 0, F.concat("lang", F.lit(" talk"))).otherwise(F.col("lang")).alias("target"),
    )


SHARED["tokens"] = """
SELECT row_id, doc_id, line_no, i, w, sum(length(w) + 1) OVER (PARTITION BY row_id ORDER BY i) - length(w) - 1 AS off
FROM (SELECT row_id, doc_id, line_no, unnest(range(len(string_split(text, ' ')))) AS i,
             unnest(string_split(text, ' ')) AS w FROM lines)
"""
SHARED["gold_edits"] = f"""
SELECT row_id AS req_uid, CAST(off AS INTEGER) AS "start",
       CAST(CASE WHEN kind = 3 THEN off ELSE off + length(w) END AS INTEGER) AS "end",
       CASE WHEN kind = 3 THEN '' ELSE w END AS original,
       CASE WHEN kind = 3 THEN 'the' WHEN kind = 2 THEN '' ELSE 'fix' || length(w) END AS replacement,
       {TAG_LIST}[CAST((doc_id + i * 3) % 16 AS INTEGER) + 1] AS tag
FROM (SELECT *, (i + doc_id) % 4 AS kind FROM tokens WHERE w <> '' AND (i + doc_id + line_no) % 7 = 3)
UNION ALL
SELECT row_id, CAST(length(text) AS INTEGER), CAST(length(text) AS INTEGER), '', 'too', 'coll'
FROM lines WHERE (doc_id + line_no) % 5 = 0
"""
SHARED["pred_edits"] = f"""
SELECT row_id AS req_uid, CAST(off AS INTEGER) AS "start",
       CAST(CASE WHEN kind = 3 AND planned THEN off ELSE off + length(w) END AS INTEGER) AS "end",
       CASE WHEN kind = 3 AND planned THEN '' ELSE w END AS original,
       CASE WHEN NOT planned THEN 'x' WHEN kind = 3 THEN 'the' WHEN kind = 2 THEN '' ELSE 'fix' || length(w) END AS replacement,
       CASE WHEN planned THEN {TAG_LIST}[CAST((doc_id + i * 3 + CASE WHEN i % 4 = 1 THEN 1 ELSE 0 END) % 16 AS INTEGER) + 1]
            ELSE {TAG_LIST}[CAST(i % 16 AS INTEGER) + 1] END AS tag
FROM (SELECT *, (i + doc_id) % 4 AS kind, (i + doc_id + line_no) % 7 = 3 AS planned FROM tokens WHERE w <> '')
WHERE (planned AND i % 5 <> 2) OR (NOT planned AND (i + doc_id + line_no) % 11 = 5)
UNION ALL
SELECT row_id, CAST(length(text) AS INTEGER), CAST(length(text) AS INTEGER), '', 'too', 'coll'
FROM lines WHERE (doc_id + line_no) % 10 = 0
"""
SHARED["strings"] = f"""
SELECT row_id, any_value(doc_id) AS doc_id, any_value(line_no) AS line_no,
  string_agg(CASE WHEN w <> '' AND planned THEN mark ELSE w END, ' ' ORDER BY i)
    || CASE WHEN (any_value(doc_id) + any_value(line_no)) % 5 = 0 THEN ' [>too:coll]' ELSE '' END AS gold_text,
  string_agg(CASE WHEN w <> '' AND planned AND i % 5 <> 2 THEN pmark
                  WHEN w <> '' AND NOT planned AND (i + doc_id + line_no) % 11 = 5
                    THEN '[' || w || '>x:' || {TAG_LIST}[CAST(i % 16 AS INTEGER) + 1] || ']' ELSE w END, ' ' ORDER BY i)
    || CASE WHEN (any_value(doc_id) + any_value(line_no)) % 10 = 0 THEN ' [>too:coll]' ELSE '' END AS pred_text
FROM (
  SELECT *, CASE kind WHEN 3 THEN '[>the:' || tag || '] ' || w WHEN 2 THEN '[' || w || '>:' || tag || ']'
                 ELSE '[' || w || '>fix' || length(w) || ':' || tag || ']' END AS mark,
            CASE kind WHEN 3 THEN '[>the:' || ptag || '] ' || w WHEN 2 THEN '[' || w || '>:' || ptag || ']'
                 ELSE '[' || w || '>fix' || length(w) || ':' || ptag || ']' END AS pmark
  FROM (SELECT *, (i + doc_id) % 4 AS kind, (i + doc_id + line_no) % 7 = 3 AS planned,
               {TAG_LIST}[CAST((doc_id + i * 3) % 16 AS INTEGER) + 1] AS tag,
               {TAG_LIST}[CAST((doc_id + i * 3 + CASE WHEN i % 4 = 1 THEN 1 ELSE 0 END) % 16 AS INTEGER) + 1] AS ptag
        FROM tokens))
GROUP BY row_id
"""
SHARED["marked"] = """
SELECT l.row_id AS req_uid, l.doc_id, l.line_no, l.lang, l.source, l.text,
  CASE WHEN (l.doc_id * 7 + l.line_no) % 13 <> 0 THEN s.gold_text END AS gold,
  CASE WHEN NOT ((l.doc_id * 7 + l.line_no) % 13 = 0 AND (l.doc_id + l.line_no) % 2 = 0)
            AND (l.doc_id + l.line_no) % 19 <> 0 THEN s.pred_text END AS pred,
  CASE WHEN (l.doc_id * 7 + l.line_no) % 13 <> 0 THEN s.gold_text ||
    CASE (l.doc_id + l.line_no) % 17 WHEN 1 THEN ' [oops' WHEN 2 THEN ' [a>b:zzz]' WHEN 3 THEN ' [>:sp]'
      WHEN 4 THEN ' extra' ELSE '' END END AS correction,
  CASE WHEN (l.doc_id + l.line_no * 5) % 31 <> 0 THEN CAST((l.doc_id * 3 + l.line_no) % 6 AS INTEGER) END AS meaning,
  CASE (l.doc_id + l.line_no * 3) % 11 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN 'Good start. But fix the verb.'
    WHEN 3 THEN NULL ELSE 'The ' || l.lang || ' line from ' || l.source || ' reads well.' END AS feedback,
  CAST((l.doc_id * 3 + l.line_no) % 5 AS INTEGER) AS gold_meaning,
  CAST((l.doc_id + l.line_no * 2) % 5 AS INTEGER) AS pred_meaning,
  'The ' || l.lang || ' line from ' || l.source || ' reads well.' AS gold_feedback,
  'This ' || l.lang || ' line of ' || l.source || ' reads fine.' AS pred_feedback,
  CASE WHEN (l.doc_id + l.line_no) % 3 = 0 THEN l.lang || ' talk' ELSE l.lang END AS target
FROM lines l JOIN strings s ON s.row_id = l.row_id
"""
# What the checks must say about the raw grading, from how it was made.
SHARED["verdicts"] = """
SELECT *, CASE
  WHEN correction IS NOT NULL AND (doc_id + line_no) % 17 = 1 THEN 'malformed_edit'
  WHEN correction IS NOT NULL AND (doc_id + line_no) % 17 = 2 THEN 'unknown_tag'
  WHEN correction IS NOT NULL AND (doc_id + line_no) % 17 = 3 THEN 'empty_edit'
  WHEN correction IS NOT NULL AND (doc_id + line_no) % 17 = 4 THEN 'text_altered'
  WHEN meaning IS NULL THEN 'bad_type'
  WHEN meaning > 4 THEN 'meaning_range'
  WHEN feedback IS NULL THEN 'bad_type'
  WHEN trim(feedback) = '' THEN 'feedback_empty'
  WHEN feedback LIKE 'Good start%' THEN 'feedback_multi_sentence' END AS reject_reason
FROM marked
"""
SHARED["gold_pairs"] = """
SELECT e.* FROM gold_edits e JOIN marked m ON m.req_uid = e.req_uid WHERE m.gold IS NOT NULL
"""
SHARED["pred_pairs"] = """
SELECT e.* FROM pred_edits e JOIN marked m ON m.req_uid = e.req_uid WHERE m.pred IS NOT NULL
"""
SHARED["weights"] = """
SELECT * FROM (VALUES ('punc', 1), ('sp', 1), ('art', 1), ('num', 1), ('poss', 1), ('prep', 2), ('part', 2),
  ('agr', 2), ('tense', 2), ('form', 2), ('pron', 2), ('order', 3), ('coll', 2), ('word', 2), ('unnat', 3),
  ('other', 2)) t(tag, weight)
"""
SHARED["word_counts"] = """
SELECT row_id AS req_uid, count(*) FILTER (w <> '') AS n_words FROM tokens GROUP BY row_id
"""
SHARED["penalties"] = """
SELECT m.req_uid, g.grp,
  coalesce(sum(w.weight) FILTER ((w.tag IN ('coll', 'word', 'unnat')) = (g.grp = 'usage')), 0)
    / sqrt(greatest(any_value(c.n_words), 1)) AS penalty
FROM marked m JOIN word_counts c ON c.req_uid = m.req_uid
CROSS JOIN (VALUES ('correctness'), ('usage')) g(grp)
LEFT JOIN gold_edits e ON e.req_uid = m.req_uid LEFT JOIN weights w ON w.tag = e.tag
WHERE m.gold IS NOT NULL GROUP BY m.req_uid, g.grp
"""


def paired_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked lines with parsed ``gold_edits`` and ``pred_edits``."""
    from marginalia.functions.markup import parse_markup
    from marginalia.functions.arrays import with_columns_once

    return with_columns_once(
        marked(spark, sf_dir),
        gold_edits=parse_markup(F.col("gold"))["edits"],
        pred_edits=parse_markup(F.col("pred"))["edits"],
    )


def edit_rows(df: DataFrame, col: str) -> DataFrame:
    return df.select("req_uid", F.inline(col))


def side_edits(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """One row per edit of the marked lines' ``gold`` or ``pred``; the other side is not built."""
    from marginalia.functions.markup import parse_markup
    from marginalia.functions.arrays import with_columns_once

    rows = marked(spark, sf_dir).select("req_uid", side)
    return edit_rows(with_columns_once(rows, edits=parse_markup(F.col(side))["edits"]), "edits")


# --- dictionary senses -------------------------------------------------------------------
POS_SAMPLES = ["Noun ", "verb", "phrasal verb", "prefix", "adj", "idiom", "weird", ""]


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    pos = F.element_at(F.array(*[F.lit(p) for p in POS_SAMPLES]), (key % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.when(key % 11 == 10, "  ")
        .when(key % 5 == 1, F.concat("p_name", F.lit(" sth")))
        .when(key % 5 == 2, F.upper(F.substring_index("p_name", " ", 1)))
        .otherwise(F.col("p_name"))
        .alias("headword"),
        pos.alias("pos"),
    )


def senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    # A third of the senses share one entry, the others are spread over all of them.
    parts = table(spark, sf_dir, "part").count()
    entry = F.when(doc % 3 == 0, 1).otherwise(doc * 7919 % max(parts, 1) + 1)
    return table(spark, sf_dir, "documents").select(
        doc.alias("id"),
        entry.cast("long").alias("entry_id"),
        F.when(doc % 13 == 0, " ").when(doc % 13 == 1, " ab ").otherwise(F.col("text")).alias("definition"),
        F.when(doc % 4 != 0, F.col("lang")).otherwise("").alias("cefr_level"),
    )


SHARED["entries"] = """
SELECT p_partkey AS id,
  CASE WHEN p_partkey % 11 = 10 THEN '  ' WHEN p_partkey % 5 = 1 THEN p_name || ' sth'
       WHEN p_partkey % 5 = 2 THEN upper(split_part(p_name, ' ', 1)) ELSE p_name END AS headword,
  ['Noun ', 'verb', 'phrasal verb', 'prefix', 'adj', 'idiom', 'weird', ''][CAST(p_partkey % 8 AS INTEGER) + 1] AS pos
FROM part
"""
SHARED["senses"] = """
SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id * 7919 % (SELECT count(*) FROM part) + 1 END AS entry_id,
  CASE doc_id % 13 WHEN 0 THEN ' ' WHEN 1 THEN ' ab ' ELSE text END AS definition,
  CASE WHEN doc_id % 4 <> 0 THEN lang ELSE '' END AS cefr_level
FROM documents
"""
SHARED["sense_rows"] = """
SELECT s.id AS source_sense_id, s.definition, s.cefr_level, e.headword, e.pos
FROM senses s JOIN entries e ON e.id = s.entry_id
"""
SHARED["sense_checked"] = """
SELECT *, CASE WHEN definition = '' THEN 'empty_definition' WHEN length(definition) < 3 THEN 'definition_too_short'
    WHEN target = '' THEN 'empty_target' WHEN lower(trim(raw_pos)) IN ('', 'prefix') THEN 'excluded_pos'
    WHEN pos IS NULL THEN 'unmappable_pos' WHEN nth > 1 THEN 'duplicate_uid' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY usable, sense_uid ORDER BY source_sense_id) AS nth
  FROM (SELECT *, substr(sha256(target_norm || '|' || coalesce(pos, '') || '|' || definition), 1, 16) AS sense_uid,
          length(definition) >= 3 AND target <> '' AND pos IS NOT NULL AS usable
    FROM (SELECT source_sense_id, regexp_replace(definition, '^\\s+|\\s+$', '', 'g') AS definition, trim(headword) AS target,
            pos AS raw_pos, lower(trim(headword)) AS target_norm, nullif(cefr_level, '') AS cefr,
            CASE lower(trim(pos)) WHEN 'noun' THEN 'noun' WHEN 'verb' THEN 'verb' WHEN 'phrasal verb' THEN 'phrasal verb'
              WHEN 'adj' THEN 'adjective' WHEN 'idiom' THEN 'idiom' END AS pos
          FROM sense_rows)))
"""
SHARED["pool"] = """
SELECT sense_uid, CAST(source_sense_id AS VARCHAR) AS source_sense_id, target, target_norm, pos, definition, cefr,
  pos IN ('phrasal verb', 'idiom') OR contains(target, ' ') AS is_multiword,
  regexp_matches(target, '(^|[^a-z])(sb|sth)($|[^a-z])') AS is_placeholder
FROM sense_checked WHERE reason IS NULL
"""


def sense_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from marginalia.operators.curate import sense_quarantine
    from marginalia.sources.readers import scan_senses

    return sense_quarantine(scan_senses(senses(spark, sf_dir), entries(spark, sf_dir)))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learner profiles made from the nations and their regions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    key = F.col("n_nationkey")
    return joined.select(
        F.lower("n_name").alias("id"),
        F.when(key % 5 == 4, "none").otherwise(F.lower("r_name")).alias("l1"),
        F.concat(F.lit("B"), (key % 2 + 1).cast("string")).alias("cefr"),
        F.array(tag_at(key), tag_at(key + 5)).alias("error_bias"),
        F.when(key % 2 == 0, "short").otherwise("medium").alias("length"),
        F.concat(F.lit("writes like "), "r_name").alias("traits"),
    )


SHARED["profiles"] = f"""
SELECT lower(n_name) AS id, CASE WHEN n_nationkey % 5 = 4 THEN 'none' ELSE lower(r_name) END AS l1,
  'B' || (n_nationkey % 2 + 1) AS cefr, {TAG_LIST}[n_nationkey % 16 + 1] AS bias1,
  {TAG_LIST}[(n_nationkey + 5) % 16 + 1] AS bias2,
  CASE WHEN n_nationkey % 2 = 0 THEN 'short' ELSE 'medium' END AS length, 'writes like ' || r_name AS traits
FROM nation JOIN region ON r_regionkey = n_regionkey
"""

# --- events as a log ---------------------------------------------------------------------


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"),
        F.col("event_id").alias("seq"),
        "event_type",
        "value",
        F.when(F.col("event_type") != "error", F.col("props")).alias("response"),
    )


SHARED["event_log"] = """
SELECT 'u' || user_id AS key, event_id AS seq, event_type, value,
  CASE WHEN event_type <> 'error' THEN props END AS response FROM events
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request timings: ``value`` is the latency, the first event ids of a user are warm-up."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") * 0.5).alias("started_s"),
        (value * 0.25).alias("ttft_s"),
        value.alias("latency_s"),
        (F.col("event_id") % 40).cast("int").alias("output_tokens"),
        (F.col("event_type") != "error").alias("ok"),
        (F.col("event_id") % 97 == 0).alias("warmup"),
    )


SHARED["samples"] = """
SELECT event_id * 0.5::DOUBLE AS started_s, value * 0.25::DOUBLE AS ttft_s, value AS latency_s,
  CAST(event_id % 40 AS INTEGER) AS output_tokens, event_type <> 'error' AS ok, event_id % 97 = 0 AS warmup FROM events
"""
SHARED["timed"] = "SELECT * FROM samples WHERE ok AND NOT warmup"


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    constant = F.col("o_custkey") % 6 == 0
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("group_id"),
        key.alias("rollout_id"),
        F.when(constant, 1.5).otherwise(F.col("o_totalprice") / 1000.0).alias("reward"),
        (F.col("o_custkey") % 4).cast("double").alias("empty_reward"),
        (key % 300).cast("int").alias("tokens"),
    )


SHARED["rollouts"] = """
SELECT o_custkey AS group_id, o_orderkey AS rollout_id,
  CASE WHEN o_custkey % 6 = 0 THEN 1.5::DOUBLE ELSE o_totalprice / 1000.0::DOUBLE END AS reward,
  CAST(o_custkey % 4 AS DOUBLE) AS empty_reward, CAST(o_orderkey % 300 AS INTEGER) AS tokens FROM orders
"""
