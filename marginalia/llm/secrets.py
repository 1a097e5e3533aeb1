"""Secret scanning by patterns and by a battery of randomness tests, in DataFrame functions only.

Three patterns find the plain cases. Beyond them, every run of 20 or more key characters gets the
narrowest encoding it can be in (hex, base32, base64; it has to hold digits and letters, for
base64 both cases). Under the hypothesis that its symbols are drawn uniformly, it gets three
p-values: chi-squared over the alphabet, runs above and below the middle of the alphabet, and
serial correlation of neighbours; three times the smallest one counts. Words, paths and
identifiers fail these tests. Which failures count is decided by the step-up procedure of
Benjamini and Hochberg for each encoding and length class, over all runs of the corpus: of the
strings drawn at random, at most the share ``rate`` of the rejected is expected to be lost. Runs
that are not rejected are spans of kind ``random``.

The rate does not hold for strings without such an encoding, which are never tested, or joined to a
name by ``=``, ``/``, ``_`` or ``-``, which are tested together with it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.arrays import bind, running_total, with_columns_once
from marginalia.llm.common import Scratch

KINDS = ("assign", "access", "hex", "random")
_NAMES = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)
    for name in ("password", "passwd", "secret", "token", "api_?key")
)
#: Fixed patterns; the last group of ``assign`` has to have ``LEAST["assign"]`` characters.
PATTERNS = {
    "assign": rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
    "random": r"[A-Za-z0-9+/_=-]{20,}",
}
VALUE = rf"^(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
LEAST_VALUE, LEAST_ACCESS = 6, 20
ALPHABETS = {
    1: "0123456789abcdef",
    2: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    3: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Lower ends of the length classes.
LENGTHS = (20, 28, 40, 64, 128)
#: Steps of -log10(p) that the step-up procedure tells apart, and where they end.
STEP, STEPS = 0.01, 4000
RATE = 0.01
MARK, OTHER = "\u0001", "\u0002"


def spans_of(text: Column, kind: str) -> Column:
    """Leftmost matches that do not overlap, as ``array<struct<s, e, m>>`` in code points.

    The matches are fenced with a character that is in none of the patterns, and the text is cut
    there; in the text itself that character is replaced first, which moves nothing.
    """
    pattern = PATTERNS[kind]

    def cut(parts: Column) -> Column:
        lengths = F.transform(parts, F.length)
        half = F.floor((F.size(parts) - 1) / 2).cast("int")
        return bind(
            running_total(lengths),
            lambda at: F.when(
                half > 0,
                F.transform(
                    F.sequence(F.lit(1), F.greatest(half, F.lit(1))),
                    lambda i: F.struct(
                        F.get(at, i * 2 - 1).alias("s"),
                        F.get(at, i * 2).alias("e"),
                        F.get(parts, i * 2 - 1).alias("m"),
                    ),
                ),
            ).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>")),
        )

    fenced = F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}")
    found = bind(F.split(fenced, MARK), cut)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the three patterns."""
    return {
        "assign": F.filter(
            spans_of(text, "assign"),
            lambda x: F.length(F.regexp_extract(x["m"], VALUE, 1)) >= LEAST_VALUE,
        ),
        "access": F.filter(spans_of(text, "access"), lambda x: x["e"] - x["s"] >= LEAST_ACCESS),
        "hex": spans_of(text, "hex"),
    }


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by the rational formula with an error below 1e-7."""

    def tail(z: Column) -> Column:
        x = F.abs(z) / math.sqrt(2.0)

        def half(t: Column) -> Column:
            series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
            return 0.5 * series * F.exp(-x * x)

        return bind(bind(1.0 / (1.0 + 0.3275911 * x), half), lambda h: F.when(z >= 0, h).otherwise(1.0 - h))

    return bind(z, tail)


def encoding_of(run: Column) -> Column:
    """1 hex, 2 base32, 3 base64, null for none."""
    digit, lower, upper = run.rlike("[0-9]"), run.rlike("[a-z]"), run.rlike("[A-Z]")
    return (
        F.when(run.rlike("^[0-9a-f]+$|^[0-9A-F]+$") & digit & (lower | upper), 1)
        .when(run.rlike("^[A-Z2-7]+$") & digit & upper, 2)
        .when(digit & lower & upper, 3)
    )


def _plain(run: Column, code: Column) -> Column:
    """The run in the spelling of its alphabet, without padding."""
    bare = F.regexp_replace(run, "^=+|=+$", "")
    return F.when(code == 1, F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))


def randomness_p(symbols: Column, alphabet: str) -> Column:
    """p-value of the battery for one string over one alphabet."""
    k, n = len(alphabet), F.length(symbols).cast("double")
    df = k - 1.0

    def count(c: Column) -> Column:
        return F.length(symbols) - F.length(F.replace(symbols, c, F.lit("")))

    # The sum of (count - expected)^2 / expected, with the square multiplied out.
    squares = F.aggregate(
        F.split(F.lit(alphabet), ""), F.lit(0.0), lambda acc, c: acc + F.pow(count(c).cast("double"), 2)
    )
    chi = _upper_tail(
        (F.pow((squares * k / n - n) / df, 1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    )
    halves = F.translate(symbols, alphabet, "0" * (k // 2) + "1" * (k - k // 2))

    def runs_of(halves: Column) -> Column:
        ones = F.length(F.replace(halves, F.lit("0"), F.lit(""))).cast("double")
        turns = sum(
            (F.length(halves) - F.length(F.replace(halves, F.lit(pair), F.lit("")))) / 2 for pair in ("01", "10")
        )

        def of_mean(mean: Column) -> Column:
            spread = (mean - 1) * (mean - 2) / (n - 1)
            return F.when(spread <= 0, 0.0).otherwise(2 * _upper_tail(F.abs((1 + turns - mean) / F.sqrt(spread))))

        return bind(1 + 2 * ones * (n - ones) / n, of_mean)

    def serial(off: Column) -> Column:
        products = F.zip_with(
            F.slice(off, F.lit(1), F.size(off) - 1), F.slice(off, F.lit(2), F.size(off) - 1), lambda a, b: a * b
        )
        total = F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
        # Symbols are uniform under the hypothesis, so each product has this variance.
        return total / (F.sqrt(n - 1) * ((k * k - 1) / 12))

    off = F.transform(F.split(symbols, ""), lambda c: F.instr(F.lit(alphabet), c) - F.lit((k + 1) / 2))
    lag = 2 * _upper_tail(F.abs(bind(off, serial)))
    return F.least(F.lit(1.0), 3 * F.least(chi, bind(halves, runs_of), lag))


def tested_runs(text: Column) -> Column:
    """``array<struct<s, e, code, class, step>>``: the runs of a text and how random they look.

    ``step`` is -log10 of the p-value in whole ``STEP`` s: the higher, the less random.
    """

    def tested(x: Column) -> Column:
        def of(code: Column) -> Column:
            def p_of(symbols: Column) -> Column:
                out = F.lit(None).cast("double")
                for c, alphabet in ALPHABETS.items():
                    out = F.when(code == c, randomness_p(symbols, alphabet)).otherwise(out)
                return out

            p = bind(_plain(x["m"], code), p_of)
            size = x["e"] - x["s"]
            kind = F.lit(0)
            for i, least in enumerate(LENGTHS):
                kind = F.when(size >= least, i).otherwise(kind)
            step = F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) / STEP)
            return F.struct(
                x["s"].alias("s"),
                x["e"].alias("e"),
                code.alias("code"),
                kind.alias("class"),
                F.least(step, F.lit(STEPS)).cast("int").alias("step"),
            )

        return bind(encoding_of(x["m"]), of)

    return F.filter(F.transform(spans_of(text, "random"), tested), lambda x: x["code"].isNotNull())


def rejection_steps(runs: DataFrame, rate: float = RATE) -> dict[tuple[int, int], int]:
    """For each encoding and length class the smallest ``step`` that counts as not random.

    ``runs`` has a column ``runs`` as ``tested_runs`` makes it. Only counts per class and step
    are gathered, at most ``len(ALPHABETS) * len(LENGTHS) * (STEPS + 1)`` rows; a p-value counts
    as the upper end of its step, so the bound holds for every run.
    """
    one = F.explode("runs").alias("r")
    counts = runs.select(one).groupBy("r.code", "r.class", "r.step").agg(F.count("*").alias("n"))
    per_class: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for row in counts.collect():
        per_class.setdefault((row["code"], row["class"]), []).append((row["step"], row["n"]))
    cuts = {}
    for key, steps in per_class.items():
        m, seen = sum(n for _, n in steps), 0
        for step, n in sorted(steps, reverse=True):
            seen += n
            if 10 ** (-step * STEP) <= rate * seen / m:
                cuts[key] = step
    return cuts


def _taken(runs: Column, cuts: dict[tuple[int, int], int], base: Column) -> Column:
    """Runs that are not rejected and meet no span of ``base``."""

    def kept(x: Column) -> Column:
        low = F.lit(STEPS + 1)
        for (code, kind), step in cuts.items():
            low = F.when((x["code"] == code) & (x["class"] == kind), step).otherwise(low)
        meets = F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        return (x["step"] < low) & ~meets

    return F.filter(runs, kept)


def _bare(spans: Column, kind: int) -> Column:
    return F.transform(
        spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"))
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))),
        ",",
    )


def _scanned(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep``, the ``base`` spans in order, how many there are of each kind, and the ``runs``.

    Every step is fenced, so that none of these long expressions is copied into the next.
    """
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, OTHER)
    rows = with_columns_once(docs.select(*keep, text.alias("_text")), **{f"_{k}": v for k, v in base_spans(F.col("_text")).items()})
    rows = with_columns_once(
        rows,
        base=F.array_sort(F.concat(*[_bare(F.col(f"_{k}"), i) for i, k in enumerate(KINDS[:3])])),
        runs=tested_runs(F.col("_text")),
    )
    return rows


def secret_spans(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs``.

    ``spans`` has all spans as ``kind:start:end``, ordered by start; ``base_sha256`` is the digest
    of those of the three patterns. Positions count code points, the end is exclusive. A null or
    empty text has no spans. Rows are judged one by one, so repeated rows and null ids make no
    difference. The text is read once: spans and tested runs are written, then the
    rejection steps, which need all runs, are applied to them.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(
        _scanned(docs, F.col("doc_id")).select(
            "doc_id",
            *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
            "base",
            "runs",
        )
    )
    cuts = rejection_steps(found, rate)
    random = _bare(_taken(F.col("runs"), cuts, F.col("base")), 3)
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS[:3]],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", random))).alias("spans"),
    )


def redacted(docs: DataFrame, rate: float = RATE, tag: str = "[secret]") -> DataFrame:
    """``docs`` with every secret span replaced by ``tag`` and ``n_chars`` set to the new length.

    Rows without a span come back as they are. Spans that overlap are replaced as one. The text
    is read twice, once for the rejection steps and once for the spans, so that it never moves
    between tasks.
    """
    cuts = rejection_steps(
        docs.select(tested_runs(F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, OTHER)).alias("runs")), rate
    )
    marked = _scanned(docs.select(F.struct("*").alias("_row"), "text"), F.col("_row")).select("_row", "runs", "base")
    spans = F.array_sort(F.concat("base", _bare(_taken(F.col("runs"), cuts, F.col("base")), 3)))
    # Overlapping spans become one: a span either starts beyond the last end or stretches it.
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["s"] < F.coalesce(F.get(acc, F.size(acc) - 1)["e"], F.lit(-1))),
            F.concat(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.get(acc, F.size(acc) - 1)["s"].alias("s"),
                        F.greatest(F.get(acc, F.size(acc) - 1)["e"], x["e"]).alias("e"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))),
    )
    text = F.col("_row.text")

    def clean(cuts_: Column) -> Column:
        n = F.size(cuts_)
        pieces = F.transform(
            F.sequence(F.lit(0), n),
            lambda i: F.substr(
                text,
                F.coalesce(F.get(cuts_, i - 1)["e"], F.lit(0)) + 1,
                F.coalesce(F.get(cuts_, i)["s"], F.length(text))
                - F.coalesce(F.get(cuts_, i - 1)["e"], F.lit(0)),
            ),
        )
        return F.array_join(pieces, tag)

    fresh = with_columns_once(marked, _cuts=merged).select("_row", "_cuts")
    new_text = F.when(F.size("_cuts") > 0, bind(F.col("_cuts"), clean)).otherwise(text)
    out = with_columns_once(fresh, _clean=new_text, _hit=F.size("_cuts") > 0)
    columns = []
    for name in docs.columns:
        old = F.col("_row").getField(name).alias(name)
        if name == "text":
            old = F.col("_clean").alias("text")
        elif name == "n_chars":
            old = F.when(F.col("_hit"), F.length("_clean").cast("long")).otherwise(old).alias("n_chars")
        columns.append(old)
    return out.select(*columns)
