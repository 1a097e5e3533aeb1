"""Fixed values and table schemas shared by every job."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: the edit taxonomy, its groups, weights and cut points ---------------
TAGS = [
    "punc", "sp", "art", "num", "poss", "prep", "part", "agr",
    "tense", "form", "pron", "order", "coll", "word", "unnat", "other",
]
USAGE_TAGS = ["coll", "word", "unnat"]
GROUPS = ["correctness", "usage"]
WEIGHTS = {
    "punc": 1, "sp": 1, "art": 1, "num": 1, "poss": 1, "prep": 2, "part": 2, "agr": 2,
    "tense": 2, "form": 2, "pron": 2, "order": 3, "coll": 2, "word": 2, "unnat": 3, "other": 2,
}
THRESHOLDS = [0.0, 0.4, 0.9, 1.6]
CONFUSABLE_PAIRS = [("word", "coll"), ("prep", "part")]
MIN_BAND, MAX_BAND = 0, 4

# --- fixed values: parts of speech -----------------------------------------------------
POS_MAP = {
    "n": "noun",
    "noun": "noun",
    "plural noun": "noun",
    "verb": "verb",
    "v": "verb",
    "auxiliary verb": "verb",
    "modal verb": "verb",
    "adjective": "adjective",
    "adj": "adjective",
    "adverb": "adverb",
    "idiom": "idiom",
    "phrasal verb": "phrasal verb",
    "collocation": "collocation",
    "phrase": "phrase",
    "exclamation": "exclamation",
    "interjection": "exclamation",
    "adjective, adverb": "adjective",
    "adverb, adjective": "adverb",
    "noun or exclamation": "noun",
}
POS_EXCLUDED = [
    "", "suffix", "prefix", "combining form", "abbreviation", "written abbreviation", "symbol",
    "number", "ordinal number", "modifier", "predeterminer", "indefinite article",
    "definite article", "preposition", "pronoun", "conjunction", "determiner", "trademark",
    "short form",
]
MULTIWORD_POS = ["idiom", "phrasal verb", "collocation", "phrase"]

# --- fixed values: corpus error types and token spacing --------------------------------
ERROR_TYPE_TAGS = {
    "SPELL": "sp", "ORTH": "sp", "CONTR": "sp", "VERB:SVA": "agr", "VERB:TENSE": "tense",
    "VERB:FORM": "form", "VERB:INFL": "form", "ADJ:FORM": "form", "MORPH": "form",
    "NOUN:INFL": "form", "DET": "art", "PREP": "prep", "PART": "part", "PRON": "pron",
    "WO": "order", "PUNCT": "punc", "NOUN:NUM": "num", "NOUN:POSS": "poss", "NOUN": "word",
    "VERB": "word", "ADJ": "word", "ADV": "word", "CONJ": "word",
}
SILENT_TYPES = ["noop", "UNK"]
NO_SPACE_BEFORE = ".,!?;:%)]}"
NO_SPACE_AFTER = "([{$#"
EDIT_BUCKETS = ["clean", "one", "few", "many"]

# --- fixed values: the request grid ----------------------------------------------------
MEANING_REQS = [0, 1, 2, 3, 4]
ERROR_SPECS = ["none", "one", "few", "many", "unreadable"]
SPECS_PER_BATCH = 6
UNKNOWN_PROFILE = "a language learner"

# --- fixed values: reports and gates ---------------------------------------------------
WEAK_METRICS = ["chrf", "judge_win_rate", "judge_discard_rate"]
CEILING_KEYS = {
    "meaning.qwk": "meaning_qwk",
    "correction.span_tag_f1": "correction_edit_f1",
}
STD_FLOOR = 1e-6
PROBABILITY_FLOOR = 1e-12

EDIT = T.StructType(
    [
        T.StructField("original", T.StringType()),
        T.StructField("replacement", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)


_TYPES = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _table(spec: str) -> T.StructType:
    pairs = [part.split() for part in spec.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# --- fixed values: the columns of each table, in order -----------------------------------
POOL = _table(
    "sense_uid string, source_sense_id string, target string, target_norm string, pos string, "
    "definition string, cefr string, is_multiword boolean, is_placeholder boolean, "
    "source_db_sha256 string"
)
QUARANTINE = _table("source_sense_id string, reason string, raw_pos string")
SPECS = _table(
    "spec_id string, batch_uid string, sense_uid string, target string, target_norm string, "
    "pos string, definition string, cefr string, is_multiword boolean, is_placeholder boolean, "
    "profile_id string, meaning_req int, error_spec string, seed bigint"
)
TEXTS = _table(
    "req_uid string, batch_uid string, spec_id string, sense_uid string, target string, "
    "target_norm string, pos string, definition string, cefr string, is_multiword boolean, "
    "is_placeholder boolean, profile_id string, meaning_req int, error_spec string, text string"
)
LABELS = _table(
    "req_uid string, sense_uid string, text string, correction string, meaning int, "
    "feedback string, grammar int, naturalness int, tags array<string>, n_edits int, "
    "n_words int, pass_index int, prompt_hash string"
)
PROFILES = _table(
    "id string, l1 string, cefr string, error_bias array<string>, length string, traits string"
)
ANSWER = _table("correction string, meaning int, feedback string")
PREDICTIONS = T.StructType(
    [
        *_table("req_uid string, text string, target string, definition string, pos string"),
        T.StructField("gold", ANSWER),
        T.StructField("prediction", ANSWER),
        *_table("meaning_confidence double, retries int, note string"),
    ]
)
LOG = _table("req_uid string, seq bigint, text string, reply string")
METRICS = _table("metric string, value double")
#: The only columns a grading step may read; request columns must not leak into labels.
GRADER_COLUMNS = ["req_uid", "sense_uid", "target", "pos", "definition", "text"]
POOL_COLUMNS = [
    "sense_uid", "target", "target_norm", "pos", "definition", "cefr", "is_multiword",
    "is_placeholder",
]


def literal_map(values: dict[str, object]) -> Column:
    """A constant map column built from a small fixed dict."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def literal_rows(spark: SparkSession, ddl: str, rows: list[tuple]) -> DataFrame:
    """A constant dimension table; it plans as a local relation, so its size is known."""

    def cell(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return f"{v!r}D" if isinstance(v, float) else repr(v)
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    schema = T.StructType.fromDDL(ddl)
    names = ", ".join(f.name for f in schema)
    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    df = spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def tag_table(spark: SparkSession, weights: dict[str, int] | None = None) -> DataFrame:
    """The 16-row tag dimension ``(tag, grp, weight)``."""
    weights = weights or WEIGHTS
    rows = [(t, "usage" if t in USAGE_TAGS else "correctness", weights[t]) for t in TAGS]
    return literal_rows(spark, "tag string, grp string, weight int", rows)


def check_band_config(
    weights: dict[str, int], groups: dict[str, list[str]], thresholds: list[float]
) -> None:
    """Refuse a config that leaves the taxonomy or whose cut points do not ascend."""
    if set(weights) != set(TAGS):
        raise ValueError(f"weights must cover the tags exactly: {sorted(set(weights) ^ set(TAGS))}")
    if any(w <= 0 for w in weights.values()):
        raise ValueError("each weight is above zero")
    if set(groups) != set(GROUPS):
        raise ValueError(f"groups must be {GROUPS}")
    members = [t for g in groups.values() for t in g]
    if sorted(members) != sorted(TAGS):
        raise ValueError("groups must be a disjoint partition of the tags")
    if len(thresholds) != MAX_BAND - MIN_BAND or list(thresholds) != sorted(thresholds):
        raise ValueError("four ascending thresholds are needed")


@dataclass(frozen=True)
class BandConfig:
    """How penalties become bands, as data: kept as one JSON object with these keys."""

    version: int
    calibrated: bool
    weights: dict[str, int]
    groups: dict[str, list[str]]
    thresholds: list[float]

    def __post_init__(self) -> None:
        if isinstance(self.version, bool) or not isinstance(self.version, int) or self.version < 1:
            raise ValueError("the version is a whole number above zero")
        check_band_config(self.weights, self.groups, self.thresholds)

    @classmethod
    def of_taxonomy(cls) -> BandConfig:
        """The weights, groups and cut points of the taxonomy, not yet calibrated."""
        usage = sorted(t for t in TAGS if t in USAGE_TAGS)
        rest = sorted(t for t in TAGS if t not in USAGE_TAGS)
        groups = {g: usage if g == "usage" else rest for g in GROUPS}
        return cls(1, False, dict(WEIGHTS), groups, list(THRESHOLDS))

    @classmethod
    def from_json(cls, text: str) -> BandConfig:
        """Read and check a config; a missing key is an error."""
        held = json.loads(text)
        missing = [f.name for f in fields(cls) if f.name not in held]
        if missing:
            raise ValueError(f"the band config has no {missing}")
        return cls(
            held["version"],
            bool(held["calibrated"]),
            {str(t): int(w) for t, w in held["weights"].items()},
            {str(g): sorted(map(str, ts)) for g, ts in held["groups"].items()},
            [float(x) for x in held["thresholds"]],
        )

    def to_json(self) -> str:
        """One line with sorted keys, so equal configs are equal texts."""
        return json.dumps(asdict(self), sort_keys=True, ensure_ascii=False)

    def require_calibrated(self) -> None:
        if not self.calibrated:
            raise ValueError(f"band config {self.version} is not calibrated; its bands would mean nothing")

    def with_thresholds(self, thresholds: list[float]) -> BandConfig:
        """The next version, calibrated to other cut points."""
        return replace(self, version=self.version + 1, calibrated=True, thresholds=list(thresholds))


def read_band_config(spark: SparkSession, path: str) -> BandConfig:
    """The config that ``write_band_config`` left at ``path``."""
    rows = spark.read.option("wholetext", True).text(path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} has to hold one band config")
    return BandConfig.from_json(rows[0][0])


def write_band_config(spark: SparkSession, config: BandConfig, path: str) -> None:
    """Write a config as one JSON line; an older one at ``path`` gives way."""
    literal_rows(spark, "value string", [(config.to_json(),)]).coalesce(1).write.mode("overwrite").text(path)
