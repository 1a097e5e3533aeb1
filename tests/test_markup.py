import pytest
from pyspark.sql import functions as F

from marginalia.functions.arrays import running_total
from marginalia.functions.markup import (
    band_of,
    corrected_text,
    parse_markup,
    penalty,
    render_markup,
    source_text,
)
from marginalia.functions.text import mentions, shape_fault, strip, units
from marginalia.operators import grading as G
from marginalia.operators import spans as S

GOOD = [
    ("plain words", "plain words", []),
    ("he [go>goes:agr] home", "he go home", [("go", "goes", "agr", 3, 5)]),
    ("a [very >:unnat]big dog", "a very big dog", [("very ", "", "unnat", 2, 7)]),
    ("[>The:art] cat", "cat", [("", "The", "art", 0, 0)]),
    ("see [>the:art] sea", "see sea", [("", "the", "art", 4, 4)]),
    ("come [>back:part]", "come", [("", "back", "part", 4, 4)]),
    ("come [>a:art][>b:sp]", "come", [("", "a", "art", 5, 5), ("", "b", "sp", 4, 4)]),
    ("[>a:art] [>b:art]", "", [("", "a", "art", 0, 0), ("", "b", "art", 0, 0)]),
    ("go [>to the:prep]shop", "go shop", [("", "to the", "prep", 3, 3)]),
    ("x [foo >bar:word][>y:art] z", "x foo z", [("foo ", "bar", "word", 2, 6), ("", "y", "art", 6, 6)]),
    (r"an \[aside\] and ] too", "an [aside] and ] too", []),
    (r"[\[hi\]>hi:punc] you", "[hi] you", [("[hi]", "hi", "punc", 0, 4)]),
    (r"back\slash [a>b\\:sp]", r"back\slash a", [("a", r"b\\", "sp", 11, 12)]),
    ("café 𝒳 [y>z:sp]", "café 𝒳 y", [("y", "z", "sp", 7, 8)]),
    ("", "", []),
]
BAD = [
    ("oops [x", "malformed_edit"),
    ("[a>b]", "malformed_edit"),
    ("[a>b:SP]", "malformed_edit"),
    ("[a[b>c:sp]", "malformed_edit"),
    ("[a>b:c:sp]", "malformed_edit"),
    ("[a>b:zzz]", "unknown_tag"),
    ("[>:sp]", "empty_edit"),
    ("[>:zzz]", "unknown_tag"),
    ("[a>b:zzz] then [", "unknown_tag"),
    ("[ then [a>b:zzz]", "malformed_edit"),
]


def parsed(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    rows = df.select("i", parse_markup(F.col("c")).alias("p")).orderBy("i").collect()
    return [r["p"] for r in rows]


def test_well_formed_markup(spark):
    for (source, text, edits), p in zip(GOOD, parsed(spark, [g[0] for g in GOOD])):
        assert p["error"] is None, source
        assert p["text"] == text, source
        assert [tuple(e) for e in p["edits"]] == edits, source


def test_first_error_wins(spark):
    found = parsed(spark, [b[0] for b in BAD])
    assert [p["error"] for p in found] == [b[1] for b in BAD]
    assert all(p["text"] is None for p in found)
    assert parsed(spark, [None]) == [None]


def test_render_is_the_inverse_of_parse(spark):
    canonical = [g[0] for g in GOOD if "][" not in g[0] and "] [" not in g[0] and "]shop" not in g[0]]
    canonical = [c for c in canonical if "]" not in c.replace(r"\]", "") or ">" in c]
    df = spark.createDataFrame([(c,) for c in canonical], "c string")
    rows = df.select("c", parse_markup(F.col("c")).alias("p")).select(
        "c", render_markup(F.col("p.text"), F.col("p.edits")).alias("r")
    )
    for row in rows.collect():
        assert row["r"] == row["c"]


def test_render_refuses_spans_that_do_not_fit(spark):
    schema = "text string, edits array<struct<original:string,replacement:string,tag:string,start:int,end:int>>"
    rows = [
        ("a cat", [("cat", "dog", "word", 2, 5)]),
        ("a cat", [("dog", "cat", "word", 2, 5)]),
        ("a cat", [("cat", "dog", "word", 2, 9)]),
        ("a cat", [("a c", "x", "sp", 0, 3), ("cat", "dog", "word", 2, 5)]),
    ]
    out = G.render_corrections(spark.createDataFrame(rows, schema)).collect()
    assert [r["correction"] for r in out] == ["a [cat>dog:word]", None, None, None]


def test_long_texts_neither_recurse_nor_backtrack(spark):
    texts = [
        "x y " * 50_000,
        "[" + "\\[" * 50_000 + ">b:sp] c",
        "\\[" * 100_000,
        "ab [c>d:sp] " * 3_000,
        "[" * 20_000,
    ]
    found = parsed(spark, texts)
    assert [p["error"] for p in found] == [None, None, None, None, "malformed_edit"]
    assert len(found[0]["text"]) == 200_000
    assert len(found[3]["edits"]) == 3_000
    assert found[3]["edits"][-1]["start"] == 2_999 * 5 + 3


def test_source_and_corrected_text(spark):
    rows = [
        ("he [go>goes:agr] home", "he go home", "he goes home"),
        ("the [the>:art] end", "the the end", "the end"),
        ("broken [x] here", "broken [x] here", "broken [x] here"),
        (" NULL ", "null", "null"),
        (None, "null", "null"),
        ("come [>back:part]", "come", "come back"),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "c string")
    out = df.select(source_text(F.col("c")), corrected_text(F.col("c"))).collect()
    assert [tuple(o) for o in out] == [r[1:] for r in rows]


def test_six_checks_in_order(spark):
    schema = "text string, correction string, meaning int, feedback string"
    rows = [
        ("a b", "a b", 3, "Good.", None),
        ("a b", None, 0, "Cannot be read.", None),
        ("a b", "a [b", 9, "", "malformed_edit"),
        ("a b", "a c", 9, "", "text_altered"),
        ("a b ", "a b", 3, "Good.", "text_altered"),
        ("a b", "a b", None, "Good.", "bad_type"),
        ("a b", "a b", 5, "", "meaning_range"),
        ("a b", "a b", 4, None, "bad_type"),
        ("a b", "a b", 4, " \t", "feedback_empty"),
        ("a b", "a b", 4, "One. Two here.", "feedback_multi_sentence"),
        ("a b", "a b", 4, "Use e.g. this word.", None),
    ]
    out = G.check_rows(spark.createDataFrame([r[:4] for r in rows], schema)).collect()
    assert [r["reject_reason"] for r in out] == [r[4] for r in rows]


def test_replies(spark):
    good = '{"correction": "a", "meaning": 2, "feedback": "x {y}"}'
    rows = [
        good,
        "thinking... " + good + " done",
        "two " + good + ' {"meaning": 4}',
        '{"meaning": true, "correction": null, "feedback": 1}',
        '{"meaning": 2.0, "correction": "a"}',
        "no object",
        '{"open": ',
        'a quote " then ' + good,
        "} " + good,
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, reply string")
    out = G.parse_responses(df).orderBy("i").collect()
    assert [r["meaning"] for r in out] == [2, 2, 2, None, None, None, None, None, None]
    assert out[0]["feedback"] == "x {y}"
    assert out[3]["meaning_type"] == "other" and out[3]["correction_type"] == "null"
    assert out[3]["feedback_type"] == "int"
    assert out[4]["meaning_type"] == "other" and out[4]["feedback_type"] is None
    # A stray quote or closing brace hides the object from a scan that tracks both.
    assert [out[i]["payload_keys"] for i in (5, 6, 7, 8)] == [None] * 4


def test_bands(spark):
    df = spark.createDataFrame(
        [
            ("one two three four", "one two three four"),
            ("one two three four", "one [two>too:sp] three four"),
            ("one two three four", "one [two>too:order] three [four>for:order]"),
            ("one two three four", "[one>won:unnat] two [three>x:word] four"),
            ("one two three four", None),
        ],
        "text string, correction string",
    )
    out = G.derive_bands(G.parse_corrections(df)).collect()
    assert [(r["grammar"], r["naturalness"]) for r in out] == [(4, 4), (2, 4), (0, 4), (4, 0), (0, 0)]
    edges = spark.range(1).select(*[band_of(F.lit(x)) for x in (0.0, 0.4, 0.41, 0.9, 1.6, 1.7)])
    assert list(edges.first()) == [4, 3, 2, 2, 1, 0]
    empty = spark.range(1).select(penalty(F.array(F.struct(F.lit("sp").alias("tag"))), F.lit(0), "correctness"))
    assert empty.first()[0] == 1.0


def test_units_and_offsets(spark):
    text = "I couldn't go, café don't_x 1990's"
    found = spark.range(1).select(units(F.lit(text)).alias("u")).first()["u"]
    tokens = [u["token"] for u in found]
    assert tokens == ["I", "could", "n't", "go", ",", "café", "don", "'", "t_x", "1990", "'", "s"]
    assert all(text[u["start"] : u["end"]] == u["token"] for u in found)


def test_line_edits_round_trip(spark):
    rows = [
        ("He go home.", "He [go>goes:agr] home."),
        ("He go home.", "He go [>right:word] home."),
        ("He go home", "He go home [>now:word]"),
        ("He go home.", "He go [home>:word]."),
        ("He go home.", "He go home."),
    ]
    df = spark.createDataFrame(rows, "text string, correction string")
    lined = S.edits_to_spans(df)
    assert [r["span_lines"] for r in lined.collect()] == [
        "2 3 agr goes", "3 3 word right", "4 4 word now", "3 4 word", "OK",
    ]
    back = S.spans_to_edits(lined.drop("correction")).collect()
    assert [r["correction"] for r in back] == [r[1] for r in rows]
    bad = spark.createDataFrame([("a b", "a [b"), ("a b", "null"), ("a b", None)], df.schema)
    assert [r["span_lines"] for r in S.edits_to_spans(bad).collect()] == ["NULL"] * 3


def test_line_edit_faults(spark):
    cases = {
        "OK": "valid",
        "nonsense": "valid",
        "1 2 sp x": "valid",
        "0 1 sp x": "start_out_of_bounds",
        "1 9 sp x": "invalid_span",
        "2 1 sp x": "invalid_span",
        "1 2 zzz x": "invalid_tag",
        "1 3 sp x\n2 3 sp y": "overlapping_span",
        "1 2 sp x\n2 2 art the": "valid",
    }
    df = spark.createDataFrame([("a b c", k) for k in cases], "text string, span_lines string")
    assert [r["span_fault"] for r in S.validate_spans(df).collect()] == list(cases.values())
    clash = spark.createDataFrame([("a b", "1 3 sp x\n2 3 sp y")], df.schema)
    assert S.spans_to_edits(clash).first()["correction"] == "a b"


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 100])
def test_running_total(spark, n):
    values = [(i * 7) % 5 for i in range(n)]
    want = [sum(values[:i]) for i in range(n + 1)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    assert df.select(running_total(F.col("v"))).first()[0] == want


def test_text_helpers(spark):
    cases = [
        ("  a b \n", "a b"),
        (" x ", "x"),
        (" \t\n ", ""),
        ("", ""),
    ]
    df = spark.createDataFrame(cases, "t string, w string")
    assert all(r[0] == r[1] for r in df.select(strip(F.col("t")), "w").collect())
    faults = ["", "ab", "abc", "x" * 601, "abc\ndef"]
    df = spark.createDataFrame([(f,) for f in faults], "t string")
    assert [r[0] for r in df.select(shape_fault(F.col("t"))).collect()] == [
        "empty", "too_short", None, "too_long", "multiline",
    ]
    pairs = [("She smiled brightly", "bright", True), ("It rang", "ring", False), ("x", "sb sth", True), ("He gave up", "give sth up", True)]
    df = spark.createDataFrame(pairs, "a string, b string, w boolean")
    assert all(r[0] == r[1] for r in df.select(mentions(F.col("a"), F.col("b")), "w").collect())


def plain_spans(text, unit_list, edits):
    """Spans of edits by looking through all units for each of them."""
    out = []
    for start, end, tag, new in edits:
        before = sum(s < start for s, _ in unit_list)
        if start == end:
            hit = [i for i, (s, _) in enumerate(unit_list) if s == start]
            a = b = hit[0] + 1 if hit else before + 1
        else:
            begins = [i + 1 for i, (s, _) in enumerate(unit_list) if s == start]
            a = begins[0] if begins else sum(e <= start for _, e in unit_list) + 1
            b = max((i + 2 for i, (s, _) in enumerate(unit_list) if s < end), default=a)
        out.append((a, b, tag, new))
    return out


def test_numbered_edits_equal_lookups_for_each_edit(spark):
    import random

    from marginalia.functions.spans import numbered_edits

    rng = random.Random(5)
    rows = []
    for _ in range(120):
        at, unit_list = rng.randrange(3), []
        for _ in range(rng.randrange(0, 12)):
            size = rng.randrange(1, 5)
            unit_list.append((at, at + size))
            at += size + rng.choice([0, 0, 1, 2])
        edits = []
        for _ in range(rng.randrange(0, 8)):
            a = rng.randrange(0, at + 3)
            edits.append((a, a + rng.choice([0, 0, 1, 3, 6]), "sp", "x"))
        rows.append((unit_list, edits))
    df = spark.createDataFrame(rows, "us array<struct<start:int,end:int>>, edits array<struct<start:int,end:int,tag:string,replacement:string>>")
    got = df.select(numbered_edits(F.col("us"), F.col("edits")).alias("s")).collect()
    assert [[tuple(x) for x in r["s"]] for r in got] == [plain_spans(None, u, e) for u, e in rows]


def test_a_long_text_with_many_edits_is_swept_once(spark):
    import time

    words = [f"word{i}" for i in range(20_000)]
    marked = " ".join(f"[{w}>fix{i}:sp]" if i % 7 == 3 else w for i, w in enumerate(words))
    df = spark.createDataFrame([(" ".join(words), marked)], "text string, correction string")
    assert S.edits_to_spans(df).first()["span_lines"] is not None
    start = time.perf_counter()
    lines = S.edits_to_spans(df).first()["span_lines"].split("\n")
    assert time.perf_counter() - start < 2
    assert len(lines) == 2857 and lines[:2] == ["4 5 sp fix3", "11 12 sp fix10"] and lines[-1] == "19996 19997 sp fix19995"


def test_scored_references_are_read_as_their_printed_lines(spark):
    from marginalia.functions.spans import lines_of_edits, read_correction, read_lines
    from marginalia.functions.text import units

    texts = [
        ("He go home .", "He [go>goes:agr] home ."), ("a b c", "a [b>  x  y :sp] [>new:art] c"), ("a b", "a [b>one\ntwo:sp]"),
        ("a b", "a [b>:sp]"), ("a b", "a [b"), ("a b", None), ("a b", "a b"), ("a", " "), ("it isn't", "it [isn't>is:form] [>now:word]"),
        ("a b", "other [text>words:sp] here"), ("a b", "a b [>\n:sp]"),
    ]
    df = spark.createDataFrame(texts, "text string, c string")
    both = df.select(
        read_correction(F.col("text"), F.col("c"), units(F.col("text"))).alias("a"),
        read_lines(lines_of_edits(F.col("text"), F.col("c"))).alias("b"),
    ).collect()
    assert all((r["a"]["signal"], r["a"]["spans"] or []) == (r["b"]["signal"], (r["b"]["spans"] if r["b"]["signal"] is None else None) or []) for r in both)


def test_plain_markup_is_read_like_markup_that_needs_a_closer_look(spark):
    from marginalia.functions import markup as P

    texts = [
        "a [>the:art] cat [sat>sits:tense] on it",
        "[>the:art] cat",
        "x [>a:art] ",
        "x [>a:art]",
        "x  [>a:art]",
        "x [>a:art] [>b:art]",
        "[>a:art] [>b:art]  y",
        "x[>a:art] y",
        "[a:c>d>e:sp] é𝒳 [b>:punc]] z",
        "plain [no>zzz:zzz]",
        "open [oops",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    drawn = P._drawn_in(F.col("c"))
    # A backslash behind the text makes every edit go the longer way; it is shown as it is.
    closer = P.parse_markup(F.concat(F.col("c"), F.when(F.endswith("c", F.lit("]")), "").otherwise("\\")))
    plain = df.select("c", P.parse_markup(F.col("c")).alias("p"), closer.alias("q"), drawn.isNotNull().alias("short"))
    for r in plain.collect():
        assert r["p"]["error"] == r["q"]["error"]
        if not r["c"].endswith("]") and not r["p"]["error"]:
            assert r["p"]["text"] + "\\" == r["q"]["text"] and r["p"]["edits"] == r["q"]["edits"]
    got = {r["c"]: r for r in plain.collect()}
    assert got["x [>a:art] "]["p"]["text"] == "x " and got["x [>a:art]"]["p"]["text"] == "x"
    assert [(e["start"], e["end"]) for e in got["x [>a:art]"]["p"]["edits"]] == [(1, 1)]
    assert [r["c"] for r in got.values() if not r["short"]] == ["x [>a:art] [>b:art]"]
    first = got["a [>the:art] cat [sat>sits:tense] on it"]["p"]
    assert first["text"] == "a cat sat on it"
    assert [tuple(e) for e in first["edits"]] == [("", "the", "art", 2, 2), ("sat", "sits", "tense", 6, 9)]


ODD_MARKUP = [
    "he [go>goes:sp] home", "he [>the:word] house [>too:coll]", "[>a:sp] b", "a [>x:sp] [>y:sp]", "a [b>c:sp][>d:sp] e",
    "don't [can't>can:sp] won'tx n't", "wo[rld>od:sp] it's", "[a b>:word] c", "x [ >:sp] y", "[a>b\n:sp]", "[a> b :sp] [c>d:zzz]",
    "[>:sp]", "\\[a [b>c:sp]", "a] [b>c:sp]", "[oops", "ⅷ² [é>e:sp]  中文", "😀 [a>b:sp]", "ࡰ [a>b:sp]", "null", "", " ", None, "plain",
]


def test_a_batch_reads_markup_as_the_expressions_do(spark):
    from marginalia.functions import batches
    from marginalia.functions.spans import lines_by_expression

    rows = [(i, t, c) for i, (t, c) in enumerate((t, c) for t in ["plain", "a b", None] for c in ODD_MARKUP)]
    df = spark.createDataFrame(rows, "i int, text string, c string")
    t, c = F.col("text"), F.col("c")
    got = df.select("c", lines_by_expression(t, c).alias("a"), batches.printed_edits(t, c).alias("b")).collect()
    left = {r["c"] for r in got if r["b"] is None}
    assert all(r["a"] == r["b"] for r in got if r["b"] is not None)
    # Only what has an escape, a fault, a torn bracket or an unsure letter is left to the expressions.
    assert left == {ODD_MARKUP[i] for i in (3, 4, 10, 11, 12, 14, 17)}


def test_rows_counted_in_a_batch_score_as_those_left_to_the_expressions(spark):
    from marginalia.operators.scoring import span_f05_scores

    lines = ["1 2 sp x", "2 2 word the", "OK", "NULL", "", "no line\n1 2 sp goes", "2 3 sp goes\n1 1 sp a", "0 1 sp x", "1 2 zzz x"]
    rows = [("he go home", p, c) for p in [*lines, None] for c in [*ODD_MARKUP, *lines]]
    plain = spark.createDataFrame(rows, "text string, prediction string, reference string")
    # A blank before each end of a line changes nothing, but is no line as it is printed.
    odd = plain.withColumn("prediction", F.regexp_replace("prediction", r"(?<=\w)$", " ")).withColumn(
        "prediction", F.regexp_replace("prediction", " ", "\t ")
    )
    assert span_f05_scores(plain).first() == span_f05_scores(odd).first()
