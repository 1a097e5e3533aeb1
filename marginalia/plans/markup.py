"""Registered queries: markup, checks, bands, spans and corpus import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import corpus as K
from marginalia.operators import grading as G
from marginalia.operators import spans as S
from marginalia.operators import tally as T
from marginalia.plans import derive as D
from marginalia.plans.registry import SHARED, query, scratch
from marginalia.sources import readers


def edit_string(edits: str) -> Column:
    parts = F.transform(
        edits,
        lambda e: F.concat_ws(
            "|", e["start"], e["end"], e["original"], e["replacement"], e["tag"]
        ),
    )
    return F.array_join(parts, ";")


EDIT_SQL = """string_agg("start" || '|' || "end" || '|' || original || '|' || replacement || '|' || tag, ';' ORDER BY "start", "end")"""


@query(f"""
SELECT v.req_uid, CASE WHEN v.reject_reason IN ('malformed_edit', 'unknown_tag', 'empty_edit') THEN v.reject_reason END AS parse_error,
  CASE WHEN v.correction IS NULL OR (v.doc_id + v.line_no) % 17 IN (1, 2, 3) THEN NULL WHEN (v.doc_id + v.line_no) % 17 = 4 THEN v.text || ' extra'
    ELSE v.text END AS parsed_text,
  CASE WHEN v.correction IS NULL THEN NULL WHEN (v.doc_id + v.line_no) % 17 IN (1, 2, 3) THEN '' ELSE coalesce(e.edits, '') END AS edits
FROM verdicts v LEFT JOIN (
  SELECT req_uid, {EDIT_SQL} AS edits FROM (
    SELECT g.req_uid, g."start" + moved AS "start", g."end" + moved AS "end", original, replacement, tag
    FROM (SELECT g.*, CASE WHEN (m.doc_id + m.line_no) % 17 = 4 AND original = '' AND replacement = 'too' THEN 1 ELSE 0 END AS moved
          FROM gold_edits g JOIN marked m ON m.req_uid = g.req_uid) g)
  GROUP BY req_uid) e ON e.req_uid = v.req_uid
""")
def parse_corrections(spark: SparkSession, d: str) -> DataFrame:
    parsed = G.parse_corrections(D.marked(spark, d))
    return parsed.select("req_uid", "parse_error", "parsed_text", edit_string("edits").alias("edits"))


@query("SELECT req_uid, gold AS correction, false AS render_error FROM marked WHERE gold IS NOT NULL")
def render_corrections(spark: SparkSession, d: str) -> DataFrame:
    parsed = G.parse_corrections(D.marked(spark, d), "gold").where(F.col("gold").isNotNull())
    rows = parsed.select("req_uid", F.col("parsed_text").alias("text"), "edits")
    return G.render_corrections(rows).select("req_uid", "correction", "render_error")


@query("""
SELECT req_uid, CASE WHEN correction IS NULL THEN 'null' WHEN (doc_id + line_no) % 17 IN (1, 2, 3) THEN trim(correction)
  WHEN (doc_id + line_no) % 17 = 4 THEN text || ' extra' ELSE text END AS source_text FROM marked
""")
def strip_corrections(spark: SparkSession, d: str) -> DataFrame:
    return G.strip_corrections(D.marked(spark, d)).select("req_uid", "source_text")


@query(r"""
SELECT m.req_uid, CASE WHEN m.gold IS NULL THEN 'null' WHEN NOT contains(m.gold, '[') THEN m.text
  ELSE trim(regexp_replace(a.done || CASE WHEN (m.doc_id + m.line_no) % 5 = 0 THEN ' too' ELSE '' END, ' +', ' ', 'g')) END AS corrected_text
FROM marked m JOIN (
  SELECT row_id, string_agg(CASE WHEN w = '' OR (i + doc_id + line_no) % 7 <> 3 THEN w ELSE CASE (i + doc_id) % 4 WHEN 3 THEN 'the ' || w
    WHEN 2 THEN '' ELSE 'fix' || length(w) END END, ' ' ORDER BY i) AS done FROM tokens GROUP BY row_id) a ON a.row_id = m.req_uid
""")
def apply_corrections(spark: SparkSession, d: str) -> DataFrame:
    return G.apply_corrections(D.marked(spark, d), "gold").select("req_uid", "corrected_text")


@query("""
SELECT req_uid, reject_reason, CASE WHEN reject_reason IS NULL THEN trim(feedback) ELSE feedback END AS feedback,
  CASE WHEN reject_reason IN ('malformed_edit', 'empty_edit') THEN 'offset ' || (length(gold) + 1) WHEN reject_reason = 'unknown_tag' THEN 'tag zzz'
    WHEN reject_reason = 'meaning_range' THEN 'meaning ' || meaning WHEN reject_reason = 'bad_type' AND meaning IS NULL THEN 'meaning'
    WHEN reject_reason = 'bad_type' THEN 'feedback' END AS reject_detail FROM verdicts
""")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    valid, rejects = G.validate_rows(D.marked(spark, d))
    return valid.select("req_uid", none.alias("reject_reason"), "feedback", none.alias("reject_detail")).unionByName(
        rejects.select("req_uid", "reject_reason", "feedback", "reject_detail")
    )


@query("""
SELECT req_uid, CASE WHEN correction IS NOT NULL THEN CASE (doc_id + line_no) % 17 WHEN 1 THEN 'malformed_edit' WHEN 2 THEN 'unknown_tag'
  WHEN 3 THEN 'empty_edit' WHEN 4 THEN 'strip_mismatch' END END AS correction_fault FROM marked
""")
def validate_corrections(spark: SparkSession, d: str) -> DataFrame:
    return G.validate_corrections(D.marked(spark, d)).select("req_uid", "correction_fault")


BAND_SQL = "CAST(4 - (p > 0.0)::INT - (p > 0.4)::INT - (p > 0.9)::INT - (p > 1.6)::INT AS INTEGER)"
SHARED["bands"] = f"""
SELECT m.req_uid, CASE WHEN m.gold IS NULL THEN 0 ELSE g.band END AS grammar, CASE WHEN m.gold IS NULL THEN 0 ELSE u.band END AS naturalness
FROM marked m
LEFT JOIN (SELECT req_uid, {BAND_SQL} AS band FROM (SELECT req_uid, penalty AS p FROM penalties WHERE grp = 'correctness')) g ON g.req_uid = m.req_uid
LEFT JOIN (SELECT req_uid, {BAND_SQL} AS band FROM (SELECT req_uid, penalty AS p FROM penalties WHERE grp = 'usage')) u ON u.req_uid = m.req_uid
"""


@query("SELECT req_uid, CAST(grammar AS INTEGER) AS grammar, CAST(naturalness AS INTEGER) AS naturalness FROM bands")
def derive_bands(spark: SparkSession, d: str) -> DataFrame:
    parsed = G.parse_corrections(D.marked(spark, d), "gold")
    return G.derive_bands(parsed).select("req_uid", "grammar", "naturalness")


def gold_penalties(spark: SparkSession, d: str) -> DataFrame:
    rows = D.marked(spark, d).select("req_uid", "text", "gold_meaning", F.col("gold").alias("correction"))
    return G.group_penalties(rows)


@query("SELECT req_uid, grp, round(penalty, 6) AS penalty FROM penalties")
def group_penalties(spark: SparkSession, d: str) -> DataFrame:
    return gold_penalties(spark, d).select("req_uid", "grp", F.round("penalty", 6).alias("penalty"))


def replies(spark: SparkSession, d: str) -> DataFrame:
    """Model replies around each raw grading: prose, a second object, wrong types, no object."""
    style = (F.col("doc_id") + F.col("line_no") * 2) % 9
    keep = {"ignoreNullFields": "false"}
    full = F.to_json(F.struct("correction", "meaning", "feedback"), keep)
    stringy = F.to_json(
        F.struct("correction", F.col("meaning").cast("string").alias("meaning"), "feedback"), keep
    )
    reply = (
        F.when(style == 0, "I cannot do that.")
        .when(style == 1, F.to_json(F.struct("correction", "meaning"), keep))
        .when(style == 2, stringy)
        .when(style == 3, F.concat(F.lit("Sure: "), full, F.lit(' and {"x": 1} too')))
        .when(style == 4, F.concat(F.lit('{"a": '), F.lit("1")))
        .when(style == 5, F.concat(F.lit("Well\n"), full, F.lit("\nDone }")))
        .otherwise(full)
    )
    later = F.col("line_no") % 3 == 0
    return D.marked(spark, d).select(
        F.when(later, F.concat("req_uid", F.lit("#p1"))).otherwise(F.col("req_uid")).alias("req_uid"),
        F.when(later, 1).otherwise(0).alias("pass_index"),
        reply.alias("reply"),
        F.lit("rubric-1").alias("prompt_hash"),
    )


SHARED["reply_verdicts"] = """
SELECT *, CASE WHEN style IN (0, 1, 4) THEN 'missing_field'
  WHEN style = 2 AND coalesce(reject_reason, '') NOT IN ('malformed_edit', 'unknown_tag', 'empty_edit', 'text_altered') THEN 'bad_type'
  ELSE reject_reason END AS outcome
FROM (SELECT *, (doc_id + line_no * 2) % 9 AS style FROM verdicts)
"""


@query("""
SELECT req_uid, CASE WHEN style NOT IN (0, 4) THEN correction END AS correction,
  CASE WHEN style NOT IN (0, 2, 4) THEN CAST(meaning AS BIGINT) END AS meaning, CASE WHEN style NOT IN (0, 1, 4) THEN feedback END AS feedback,
  CASE WHEN style IN (0, 4) THEN NULL WHEN meaning IS NULL THEN 'null' WHEN style = 2 THEN 'string' ELSE 'int' END AS meaning_type,
  CASE style WHEN 0 THEN NULL WHEN 4 THEN NULL WHEN 1 THEN 'correction,meaning' ELSE 'correction,feedback,meaning' END AS payload_keys
FROM reply_verdicts
""")
def parse_responses(spark: SparkSession, d: str) -> DataFrame:
    found = G.parse_responses(replies(spark, d))
    return found.select(
        F.regexp_replace("req_uid", "#p1", "").alias("req_uid"), "correction", "meaning", "feedback", "meaning_type",
        F.array_join(F.array_sort("payload_keys"), ",").alias("payload_keys"),
    )


@query("""
SELECT r.req_uid, r.outcome AS reject_reason, CASE WHEN line_no % 3 = 0 THEN 1 ELSE 0 END AS pass_index,
  CASE WHEN outcome IS NULL THEN meaning END AS meaning, CASE WHEN outcome IS NULL THEN b.grammar END AS grammar,
  CASE WHEN outcome IS NULL THEN b.naturalness END AS naturalness, CASE WHEN outcome IS NULL THEN s.n_edits END AS n_edits,
  CASE WHEN outcome IS NULL THEN s.tags END AS tags
FROM reply_verdicts r JOIN bands b ON b.req_uid = r.req_uid JOIN row_stats s ON s.req_uid = r.req_uid
""")
def ingest_labels(spark: SparkSession, d: str) -> DataFrame:
    texts = D.marked(spark, d).select("req_uid", F.col("source").alias("sense_uid"), "text")
    rows = G.ingest_labels(replies(spark, d), texts)

    def accepted(c: Column, name: str) -> Column:
        return F.when(F.col("reject_reason").isNull(), c).alias(name)

    return rows.select(
        "req_uid", "reject_reason", "pass_index",
        *[accepted(F.col(c), c) for c in ("meaning", "grammar", "naturalness", "n_edits")],
        accepted(F.array_join("tags", ","), "tags"),
    )


@query("SELECT coalesce(reject_reason, 'ok') AS reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM marked), 6) AS share FROM verdicts GROUP BY 1")
def reject_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = T.reject_counts(G.check_rows(D.marked(spark, d)))
    return counts.select("reason", "n", F.round("share", 6).alias("share"))


# --- units and line edits ----------------------------------------------------------------

SHARED["units"] = r"""
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY s) AS INTEGER) AS unit_index, token, CAST(s AS INTEGER) AS start_char,
  CAST(s + length(token) AS INTEGER) AS end_char
FROM (SELECT row_id, token, off + sum(length(token)) OVER (PARTITION BY row_id, i ORDER BY j) - length(token) AS s
  FROM (SELECT row_id, i, off, unnest(u) AS token, unnest(range(len(u))) AS j
        FROM (SELECT *, regexp_extract_all(w, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS u FROM tokens)))
"""
SHARED["unit_edges"] = """
SELECT row_id, list(start_char ORDER BY unit_index) AS starts, list(end_char ORDER BY unit_index) AS ends FROM units GROUP BY row_id
"""


def span_sql(edits: str) -> str:
    return f"""
SELECT req_uid, "start" AS s0, "end" AS e0, CASE WHEN "start" = "end" THEN gap ELSE first END AS a,
  CASE WHEN "start" = "end" THEN gap WHEN upto > 0 THEN upto + 1 ELSE first END AS b, tag, replacement
FROM (SELECT e.*, len(list_filter(ends, lambda x: x <= e."start")) + 1 AS first, len(list_filter(starts, lambda x: x < e."end")) AS upto,
        len(list_filter(starts, lambda x: x < e."start")) + 1 AS gap
      FROM {edits} e LEFT JOIN unit_edges u ON u.row_id = e.req_uid)
"""


SHARED["gold_spans"] = span_sql("gold_pairs")
SHARED["pred_spans"] = span_sql("pred_pairs")
SHARED["span_lines"] = """
SELECT m.req_uid, m.doc_id, m.line_no, m.gold, m.text, CASE WHEN m.gold IS NULL THEN 'NULL' ELSE coalesce(s.lines, 'OK') END AS span_lines, s.last_end
FROM marked m LEFT JOIN (SELECT req_uid, string_agg(trim(a || ' ' || b || ' ' || tag || ' ' || replacement), chr(10) ORDER BY s0, e0) AS lines,
  arg_max(b, s0::BIGINT * 1000000 + e0) AS last_end FROM gold_spans GROUP BY req_uid) s ON s.req_uid = m.req_uid
"""


@query("SELECT row_id, unit_index, token, start_char, end_char FROM units")
def lex_units(spark: SparkSession, d: str) -> DataFrame:
    return S.lex_units(D.lines(spark, d).select("row_id", "text"), "text")


@query("""
SELECT row_id, coalesce(string_agg(unit_index || ' ' || token, chr(10) ORDER BY unit_index), '') AS numbered
FROM (SELECT l.row_id, u.unit_index, u.token FROM lines l LEFT JOIN units u ON u.row_id = l.row_id) GROUP BY row_id
""")
def numbered_text(spark: SparkSession, d: str) -> DataFrame:
    return S.numbered_text(D.lines(spark, d), "text").select("row_id", "numbered")


def gold_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = D.marked(spark, d).select("req_uid", "doc_id", "line_no", "text", F.col("gold").alias("correction"))
    return S.edits_to_spans(rows)


@query("SELECT req_uid, span_lines FROM span_lines")
def edits_to_spans(spark: SparkSession, d: str) -> DataFrame:
    return gold_lines(spark, d).select("req_uid", "span_lines")


@query("SELECT req_uid, coalesce(gold, 'null') AS correction FROM marked")
def spans_to_edits(spark: SparkSession, d: str) -> DataFrame:
    return S.spans_to_edits(gold_lines(spark, d).drop("correction")).select("req_uid", "correction")


@query("""
SELECT req_uid, CASE doc_id % 6 WHEN 1 THEN 'start_out_of_bounds' WHEN 2 THEN 'invalid_span' WHEN 3 THEN 'invalid_tag'
  WHEN 4 THEN CASE WHEN last_end > 1 THEN 'overlapping_span' ELSE 'valid' END ELSE 'valid' END AS span_fault FROM span_lines
""")
def validate_spans(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("doc_id") % 6
    extra = (
        F.when(kind == 1, "\n0 1 sp x").when(kind == 2, "\n1 9999999 sp x").when(kind == 3, "\n1 1 zzz x")
        .when(kind == 4, "\n1 1 sp x").otherwise("")
    )
    rows = gold_lines(spark, d).withColumn("span_lines", F.concat("span_lines", extra))
    return S.validate_spans(rows).select("req_uid", "span_fault")


@query("""
SELECT m.req_uid, coalesce(o.overlapping, false) AS overlapping FROM marked m LEFT JOIN (
  SELECT req_uid, bool_or(coalesce("start" < before, false)) AS overlapping FROM (
    SELECT req_uid, "start", lag("end") OVER (PARTITION BY req_uid ORDER BY "start", "end") AS before
    FROM (SELECT * FROM gold_pairs UNION ALL SELECT * FROM pred_pairs)) GROUP BY req_uid) o ON o.req_uid = m.req_uid
""")
def overlap_check(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<struct<original:string,replacement:string,tag:string,start:int,end:int>>")
    both = F.concat(F.coalesce("gold_edits", none), F.coalesce("pred_edits", none))
    return S.overlap_check(D.paired_edits(spark, d).withColumn("edits", both)).select("req_uid", "overlapping")


# --- corpus ------------------------------------------------------------------------------


def corpus_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines as annotated corpus sentences, with unmapped types, bad spans and clashes."""
    doc, line = F.col("doc_id"), F.col("line_no")
    toks = F.split(F.regexp_replace("text", "([.,])", " $1"), " ")

    def note(s: Column, e: Column, kind: Column, fix: Column, coder: str = "0") -> Column:
        return F.struct(
            s.cast("int").alias("start"), e.cast("int").alias("end"), kind.alias("type"),
            fix.alias("correction"), F.lit(coder).alias("coder"),
        )

    def planned(t: Column, i: Column) -> Column:
        kind = (doc + i) % 10
        typ = (
            F.when(kind == 0, F.when(doc % 200 == 7, "R:WEIRD").otherwise("R:SPELL"))
            .when(kind == 1, "R:VERB:SVA").when(kind == 2, "M:DET").when(kind == 3, "U:PREP")
            .when(kind == 4, "R:OTHER").when(kind == 5, "R:OTHER").when(kind == 6, "UNK")
            .when(kind == 7, "R:NOUN:NUM").when(kind == 8, "R:PUNCT").otherwise("noop")
        )
        fix = (
            F.when(kind == 0, F.when(doc % 200 == 13, "a:b").otherwise(F.concat(F.lit("fix"), F.length(t).cast("string"))))
            .when(kind == 1, "goes").when(kind == 2, "the").when(kind == 3, "").when(kind == 4, "was not")
            .when(kind == 5, "went").when(kind == 6, t).when(kind == 7, "cats ,").otherwise("-NONE-")
        )
        end = F.when(kind == 2, i).otherwise(i + 1)
        made = note(F.when(kind == 9, -1).otherwise(i), F.when(kind == 9, -1).otherwise(end), typ, fix)
        return F.when((t != "") & ~t.isin(".", ",") & ((i + doc + line) % 9 == 4), made)

    n = F.size("tokens")
    spell = F.lit("R:SPELL")
    extra = (
        F.when(doc % 200 == 9, F.array(note(n + 1, n + 2, spell, F.lit("x"))))
        .when(
            (doc % 200 == 11) & (n >= 3),
            F.array(note(F.lit(0), F.lit(3), spell, F.lit("x")), note(F.lit(1), F.lit(2), spell, F.lit("y"))),
        )
        .otherwise(F.array().cast("array<struct<start:int,end:int,type:string,correction:string,coder:string>>"))
    )
    other = F.array(note(F.lit(0), F.lit(1), spell, F.lit("zzz"), "1"))
    # Some sentences are empty.
    bare = F.when((doc + line) % 23 == 7, "").otherwise(F.col("text"))
    rows = D.lines(spark, d).withColumn("text", bare).withColumn("tokens", toks)
    own = F.filter(F.transform("tokens", planned), lambda x: x.isNotNull())
    return rows.select(
        "row_id", "source", F.upper("lang").alias("cefr"), "tokens",
        F.concat(own, extra, other).alias("annotations"),
    )


SHARED["m2_lines"] = """
SELECT * REPLACE (CASE WHEN (doc_id + line_no) % 23 = 7 THEN '' ELSE text END AS text) FROM lines
"""
SHARED["m2_tokens"] = r"""
SELECT *, i > 0 AND ((w <> '' AND contains('.,!?;:%)]}', substr(w, 1, 1))) OR regexp_matches(w, '^(n''t|''[\p{L}\p{N}_]{1,2})$')
    OR (before <> '' AND contains('([{$#', right(before, 1)))) AS glued,
  w <> '' AND w NOT IN ('.', ',') AND (i + doc_id + line_no) % 9 = 4 AS hit, (doc_id + i) % 10 AS kind
FROM (SELECT *, coalesce(lag(w) OVER (PARTITION BY row_id ORDER BY i), '') AS before FROM (
  SELECT row_id, doc_id, line_no, lang, unnest(t) AS w, unnest(range(len(t))) AS i
  FROM (SELECT *, string_split(regexp_replace(text, '([.,])', ' \1', 'g'), ' ') AS t FROM m2_lines)))
"""
SHARED["m2_rows"] = """
SELECT *, CASE WHEN doc_id % 200 = 7 AND spells > 0 THEN 'unmapped_type:R:WEIRD' WHEN doc_id % 200 = 9 THEN 'span_out_of_range'
    WHEN doc_id % 200 = 11 AND n_tokens >= 3 THEN 'overlapping_edits' WHEN doc_id % 200 = 13 AND spells > 0 THEN 'reparse:malformed_edit'
    WHEN broken > 0 THEN 'roundtrip_mismatch' END AS drop_reason
FROM (SELECT row_id, any_value(doc_id) AS doc_id, any_value(line_no) AS line_no, upper(any_value(lang)) AS cefr, count(*) AS n_tokens,
  count(*) FILTER (hit AND kind = 0) AS spells, count(*) FILTER (hit AND kind = 2 AND glued) AS broken,
  count(*) FILTER (hit AND kind NOT IN (6, 9)) AS n_edits,
  string_agg(CASE WHEN i = 0 OR glued THEN '' ELSE ' ' END || w, '' ORDER BY i) AS text,
  string_agg(CASE WHEN i = 0 OR glued THEN '' ELSE ' ' END || CASE WHEN NOT hit OR kind IN (6, 9) THEN w WHEN kind = 2 THEN '[>the:art] ' || w
    ELSE '[' || w || '>' || CASE kind WHEN 0 THEN 'fix' || length(w) || ':sp' WHEN 1 THEN 'goes:agr' WHEN 3 THEN ':prep' WHEN 4 THEN 'was not:unnat'
      WHEN 5 THEN 'went:word' WHEN 7 THEN 'cats,:num' ELSE ':punc' END || ']' END, '' ORDER BY i) AS correction
  FROM m2_tokens GROUP BY row_id)
"""


@query("SELECT row_id, text FROM m2_rows")
def detokenise(spark: SparkSession, d: str) -> DataFrame:
    return K.detokenise(corpus_blocks(spark, d)).select("row_id", "text")


@query("""
SELECT r.row_id, CASE WHEN r.drop_reason LIKE 'unmapped%' OR r.drop_reason = 'span_out_of_range' THEN r.drop_reason END AS type_fault,
  count(*) FILTER (t.hit AND t.kind IN (6, 9) AND (r.drop_reason IS NULL OR r.drop_reason NOT LIKE 'unmapped%' OR t.i < f.i)) AS skipped,
  count(*) FILTER (t.hit AND t.kind IN (4, 5) AND (r.drop_reason IS NULL OR r.drop_reason NOT LIKE 'unmapped%' OR t.i < f.i)) AS other
FROM m2_rows r JOIN m2_tokens t ON t.row_id = r.row_id
LEFT JOIN (SELECT row_id, min(i) AS i FROM m2_tokens WHERE hit AND kind = 0 GROUP BY row_id) f ON f.row_id = r.row_id
GROUP BY r.row_id, r.drop_reason
""")
def map_error_types(spark: SparkSession, d: str) -> DataFrame:
    found = K.map_error_types(corpus_blocks(spark, d))
    return found.select(
        "row_id", "type_fault", F.size("skipped").cast("long").alias("skipped"),
        F.size("other_split").cast("long").alias("other"),
    )


@query("""
SELECT row_id, drop_reason, text, CASE WHEN drop_reason IS NULL THEN correction END AS correction,
  CASE WHEN drop_reason IS NULL THEN CAST(n_edits AS INTEGER) END AS n_edits,
  CASE WHEN drop_reason IS NULL THEN substr(sha256(text || chr(0) || correction), 1, 16) END AS row_uid FROM m2_rows
""")
def convert_corpus(spark: SparkSession, d: str) -> DataFrame:
    rows = K.convert_corpus(corpus_blocks(spark, d))
    kept = F.col("drop_reason").isNull()
    return rows.select(
        "row_id", "drop_reason", "text",
        *[F.when(kept, F.col(c)).alias(c) for c in ("correction", "n_edits", "row_uid")],
    )


SHARED["m2_kept"] = """
SELECT *, substr(sha256(text || chr(0) || correction), 1, 16) AS row_uid, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_words,
  CASE WHEN n_edits = 0 THEN 'clean' WHEN n_edits = 1 THEN 'one' WHEN n_edits <= 3 THEN 'few' ELSE 'many' END AS edit_bucket
FROM m2_rows WHERE drop_reason IS NULL
"""


@query("""
SELECT 'sentences' AS section, 'all' AS key, count(*) AS n FROM m2_rows
UNION ALL SELECT 'converted', 'all', count(*) FROM m2_kept
UNION ALL SELECT 'dropped', drop_reason, count(*) FROM m2_rows WHERE drop_reason IS NOT NULL GROUP BY drop_reason
UNION ALL SELECT 'buckets', edit_bucket, count(*) FROM m2_kept GROUP BY edit_bucket
UNION ALL SELECT 'cefr', cefr, count(*) FROM m2_kept GROUP BY cefr
UNION ALL SELECT 'tags', ['sp', 'agr', 'art', 'prep', 'unnat', 'word', '', 'num', 'punc'][CAST(kind AS INTEGER) + 1], count(*)
  FROM m2_tokens t JOIN m2_kept k ON k.row_id = t.row_id WHERE hit AND kind NOT IN (6, 9) GROUP BY kind
UNION ALL SELECT CASE WHEN kind IN (4, 5) THEN 'other_split' ELSE 'skipped_edits' END,
  CASE kind WHEN 4 THEN 'unnat' WHEN 5 THEN 'word' WHEN 6 THEN 'UNK' ELSE 'noop' END, count(*)
  FROM m2_tokens t JOIN m2_rows r ON r.row_id = t.row_id
  LEFT JOIN (SELECT row_id, min(i) AS i FROM m2_tokens WHERE hit AND kind = 0 GROUP BY row_id) f ON f.row_id = r.row_id
  WHERE hit AND kind IN (4, 5, 6, 9) AND (r.drop_reason IS NULL OR r.drop_reason NOT LIKE 'unmapped%' OR t.i < f.i) GROUP BY kind
""")
def import_stats(spark: SparkSession, d: str) -> DataFrame:
    return K.import_stats(K.convert_corpus(corpus_blocks(spark, d)))


SHARED["m2_imported"] = """
SELECT row_uid, edit_bucket, CAST(n_edits AS INTEGER) AS n_edits,
  CASE WHEN (('0x' || substr(sha256('17|' || row_uid), 1, 16))::UBIGINT % 10000)::DOUBLE / 10000 < 0.05::DOUBLE THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY edit_bucket ORDER BY sha256('17|' || row_uid)) AS r,
        greatest(1, CAST(floor(count(*) OVER () * 0.15::DOUBLE) AS BIGINT)) AS cap
      FROM (SELECT DISTINCT row_uid, edit_bucket, n_edits, n_words FROM m2_kept WHERE n_words >= 3))
WHERE r <= cap
"""


@query("SELECT row_uid, edit_bucket, n_edits, split FROM m2_imported")
def import_corpus(spark: SparkSession, d: str) -> DataFrame:
    rows = K.import_corpus(corpus_blocks(spark, d), seed=17)
    return rows.select("row_uid", "edit_bucket", "n_edits", "split")


@query("""
SELECT section, key, round(value, 6) AS value FROM (
  SELECT 'sentences' AS section, 'all' AS key, count(*)::DOUBLE AS value FROM m2_rows
  UNION ALL SELECT 'converted', 'all', count(*) FROM m2_kept
  UNION ALL SELECT 'conversion_rate', 'all', count(*) / (SELECT count(*) FROM m2_rows) FROM m2_kept
  UNION ALL SELECT 'duplicates_removed', 'all', count(*) - count(DISTINCT row_uid) FROM m2_kept
  UNION ALL SELECT 'fragments_removed', 'all', count(DISTINCT row_uid) FROM m2_kept WHERE n_words < 3
  UNION ALL SELECT 'capped_out', 'all', (SELECT count(DISTINCT row_uid) FROM m2_kept WHERE n_words >= 3) - count(*) FROM m2_imported
  UNION ALL SELECT 'split', split, count(*) FROM m2_imported GROUP BY split
  UNION ALL SELECT 'dropped', drop_reason, count(*) FROM m2_rows WHERE drop_reason IS NOT NULL GROUP BY drop_reason
  UNION ALL SELECT 'tags', ['sp', 'agr', 'art', 'prep', 'unnat', 'word', '', 'num', 'punc'][CAST(kind AS INTEGER) + 1], count(*)
    FROM m2_tokens t JOIN m2_kept k ON k.row_id = t.row_id WHERE hit AND kind NOT IN (6, 9) GROUP BY kind
  UNION ALL SELECT 'skipped_edits', CASE kind WHEN 6 THEN 'UNK' ELSE 'noop' END, count(*)
    FROM m2_tokens t JOIN m2_rows r ON r.row_id = t.row_id
    LEFT JOIN (SELECT row_id, min(i) AS i FROM m2_tokens WHERE hit AND kind = 0 GROUP BY row_id) f ON f.row_id = r.row_id
    WHERE hit AND kind IN (6, 9) AND (r.drop_reason IS NULL OR r.drop_reason NOT LIKE 'unmapped%' OR t.i < f.i) GROUP BY kind
  UNION ALL SELECT 'other_tag_share', 'all', 0.0)
""")
def import_report(spark: SparkSession, d: str) -> DataFrame:
    """What became of the sentences of the whole import."""
    report = K.import_with_report(corpus_blocks(spark, d), seed=17)[1]
    return report.withColumn("value", F.round("value", 6))


@query("""
SELECT r.s AS tokens, CAST(count(*) FILTER (t.hit) + any_value(CASE WHEN r.doc_id % 200 = 9 THEN 1 WHEN r.doc_id % 200 = 11 AND r.n_tokens >= 3 THEN 2 ELSE 0 END) AS INTEGER) AS n_edits,
  r.row_id IS NOT NULL AS read
FROM (SELECT m.*, regexp_replace(l.text, '([.,])', ' \\1', 'g') AS s FROM m2_rows m JOIN m2_lines l ON l.row_id = m.row_id) r
JOIN m2_tokens t ON t.row_id = r.row_id GROUP BY r.row_id, r.s
""")
def scan_m2(spark: SparkSession, d: str) -> DataFrame:
    """The corpus sentences written as annotation files and read back."""
    note = F.transform(
        "annotations",
        lambda a: F.concat_ws(
            "|||", F.concat_ws(" ", F.lit("A"), a["start"], a["end"]), a["type"], a["correction"],
            F.lit("REQUIRED"), F.lit("-NONE-"), a["coder"],
        ),
    )
    head = F.concat(F.lit("S "), F.array_join("tokens", " "))
    block = F.concat(F.array_join(F.concat(F.array(head), note), "\n"), F.lit("\n"))
    path = scratch(spark)
    corpus_blocks(spark, d).select(block.alias("value")).write.text(path)
    rows = readers.scan_m2(spark, path, coder="0")
    return rows.select(
        F.array_join("tokens", " ").alias("tokens"), F.size("annotations").alias("n_edits"),
        F.col("source").isNotNull().alias("read"),
    )
