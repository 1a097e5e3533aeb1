"""URL filtering by listed rules and by association rules, in DataFrame functions only.

FP-growth over the tokens of labelled urls finds token combinations that go with the label
``block``. Rules below the bars for support and confidence are pruned, and so are rules of which
a part is a rule already. An inverted index from each rule's rarest token to the rule gives the
few rules that a url has to be compared with.

Tokens that are in the same labelled urls throughout are one item, so a long url that is repeated
is one item and not all its subsets; tokens too rare for a rule, and those that are a rule by
themselves, stay out of the mining. What is left can still be exponential: one long url with many
tokens that differ in support and are all common among blocked urls without being a rule.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import Scratch
from marginalia.operators.ranking import checked_small, split_join

#: (verdict, host, path) of the listed rules.
LISTED = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SUPPORT, CONFIDENCE = 0.01, 0.8
BLOCK = "=block"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: str) -> tuple[Column, Column, Column]:
    """Host (A-Z in lower case), path and the rest of a url; empty without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + 1)
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    return ascii_lower(host), path, F.substr(after, F.length(path) + 1)


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """The longest listed rule that fits, as ``host/path`` text, and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column, more: Column) -> Column:
    """Distinct tokens: host labels, path parts and query names."""
    query = F.regexp_extract(more, r"^\?([^#]*)", 1)

    def named(prefix: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))

    return F.array_distinct(
        F.concat(
            named("h:", F.split(host, r"\.")),
            named("p:", F.split(path, "/")),
            named("q:", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))),
        )
    )


def _by_rarest(held: DataFrame, seen: DataFrame) -> DataFrame:
    """``token, rule_tokens``: the rules of ``held`` (``tokens, token``) by their rarest token in ``seen``."""
    often = seen.groupBy("token").agg(F.count("*").alias("n"))
    return (
        held.join(often, "token")
        .groupBy("tokens")
        .agg(F.min(F.struct("n", "token")).alias("rarest"))
        .select(F.col("rarest.token").alias("token"), F.col("tokens").alias("rule_tokens"))
    )


def token_items(baskets: DataFrame, support: float) -> DataFrame:
    """``token, item, n, hits`` of the tokens that are in enough blocked baskets to be in a rule.

    Tokens of the very same baskets, told by two hashes over them, are one item: any of them
    stands for all in a rule. ``n`` are the item's baskets, ``hits`` the blocked ones.
    """
    least = math.ceil(support * baskets.count())
    each = baskets.select("row", "block", F.explode("tokens").alias("token"))
    tokens = (
        each.groupBy("token")
        .agg(
            F.count("*").alias("n"), F.count(F.when(F.col("block"), 1)).alias("hits"),
            F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y"),
        )
        .where(F.col("hits") >= least)
    )
    same = ["n", "hits", "x", "y"]
    return tokens.join(tokens.groupBy(*same).agg(F.min("token").alias("item")), same).select("token", "item", "n", "hits")


def _named(rows: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """``key, items``: the distinct items of the ``tokens`` of each row; rows without any are left out."""
    small = checked_small(items.select("token", "item"))
    each = rows.select(key, F.explode("tokens").alias("token"))
    named = split_join(each, items.select("token", "item"), ["token"]) if small is None else each.join(small, "token")
    # At most the tokens of one url.
    return named.groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("items"))


def block_rules(
    labelled: DataFrame,
    scratch: Scratch,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
) -> tuple[DataFrame, DataFrame]:
    """Every rule kept as ``items``, and the ``token, item, n`` behind it, from rows ``tokens, block``.

    An item that is a rule by itself is left out of the mining: what contains it is idle.
    """
    baskets = scratch.save(
        labelled.where(F.col("block") | (F.size("tokens") > 0)).select("tokens", "block", F.monotonically_increasing_id().alias("row"))
    )
    items = scratch.save(token_items(baskets, support))
    alone = items.where(F.col("hits") / F.col("n") >= confidence)
    singles = alone.select(F.array("item").alias("tokens")).distinct()
    held = _named(baskets, items.where(F.col("hits") / F.col("n") < confidence), "row")
    some = F.coalesce("items", F.array().cast("array<string>"))
    mined = baskets.select("row", "block").join(held, "row", "left").select(
        F.when(F.col("block"), F.concat(some, F.array(F.lit(BLOCK)))).otherwise(some).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(mined)
    found = scratch.save(
        model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).select(F.array_sort("antecedent").alias("tokens"))
    )
    # A rule is idle if a part of it is a rule as well: look up the rules whose rarest token it has.
    each = found.select("tokens", F.explode("tokens").alias("token"))
    part = _by_rarest(each, each).withColumnRenamed("rule_tokens", "part")
    idle = (
        each.join(part, "token")
        .where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0))
        .select("tokens")
        .distinct()
    )
    rules = found.join(idle, "tokens", "left_anti").unionByName(singles)
    return rules.withColumnRenamed("tokens", "items"), items.drop("hits")


def judged_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules=LISTED,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (``page_id``, ``url``).

    A listed rule decides where one fits. Elsewhere a url is blocked when a mined rule holds, and
    allowed otherwise. Labelled are the pages a listed rule decides, and those with a row in
    ``labels`` (``doc_id`` = ``page_id``; quality 0 in any of its rows means block). Null urls and urls
    without ``://`` have empty host and path and are allowed. Repeated urls are compared once. An
    empty page table gives an empty result, and without labelled pages nothing is mined.
    """
    scratch = Scratch(pages.sparkSession)
    host, path, more = url_parts("url")
    cut = pages.select("page_id", host.alias("host"), path.alias("path"), more.alias("more"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    seen = cut.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"),
        url_tokens(F.col("host"), F.col("path"), F.col("more")).alias("tokens"),
    )
    seen = scratch.save(seen)
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("quality"))
    labelled = scratch.save(
        seen.join(marks, "page_id", "left")
        .where(F.col("listed").isNotNull() | F.col("quality").isNotNull())
        .select("tokens", F.coalesce(F.col("listed") == "block", F.col("quality") == 0).alias("block"))
    )
    listed_only = seen.select("page_id", "host", "path", "rule", F.col("listed").alias("verdict"))
    if labelled.isEmpty():
        return listed_only.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    mined, items = block_rules(labelled, scratch, support, confidence)
    mined = scratch.save(mined)
    index = scratch.save(
        mined.select("items", F.explode("items").alias("item"))
        .join(items.select("item", "n").distinct(), "item")
        .groupBy("items")
        .agg(F.min(F.struct("n", "item")).alias("rarest"))
        .select(F.col("rarest.item").alias("item"), F.col("items").alias("rule_items"))
    )
    small = checked_small(index)
    # Repeated urls are compared once; tokens that are in no item do not matter.
    open_urls = scratch.save(
        seen.where(F.col("listed").isNull()).select("tokens").distinct().withColumn("url", F.monotonically_increasing_id())
    )
    hit = (
        _named(open_urls, items, "url")
        .select("url", "items", F.explode("items").alias("item"))
        .join(index if small is None else small, "item")
        .where(F.size(F.array_except("rule_items", "items")) == 0)
        .select("url")
        .distinct()
        .join(open_urls, "url")
        .select("tokens", F.lit(True).alias("hit"))
    )
    return split_join(seen, scratch.save(hit), ["tokens"], "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("listed", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"),
    )
