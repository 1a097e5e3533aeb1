"""Secrets, mixing, packing and URL rules against plain versions; classifiers on held-out rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm.langid import _positions, fit_filters, gram_hashes, predict_languages
from marginalia.llm.mixing import mix, mixed_documents
from marginalia.llm.packing import encode, pack, packed, tokenizer_of
from marginalia.llm.quality import BYTE_CLASSES, CLASSES, class_prior, fit_quality, fit_scorer, good_documents, quality_scores
from marginalia.llm.secrets import ALPHABETS, LENGTHS, RATE, STEP, STEPS, redacted, secret_spans
from marginalia.llm.toxicity import LEAST, _buckets, _logistic, _probability, chain_probabilities, cue_counts, design, features, find_cues, fit_chain, lookup, toxicity_scores, two_kinds
from marginalia.llm.url_rules import judged_urls

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, _text int"
VOCABULARY = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


def frame(spark, rows):
    """Documents with extra columns whose names the operators use as well."""
    full = [(i, t, lang, src, None if t is None else len(t), "x", 1) for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def words(seed, n, letters):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))


# --- secrets


def plain_tests(run):
    """Encoding, class and step of one run, in plain arithmetic."""
    digit, low, up = (bool(re.search(p, run)) for p in ("[0-9]", "[a-z]", "[A-Z]"))
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", run) and digit and (low or up):
        code, symbols = 1, run.lower()
    elif re.fullmatch("[A-Z2-7]+", run) and digit and up:
        code, symbols = 2, run
    elif digit and low and up:
        code, symbols = 3, re.sub("^=+|=+$", "", run).replace("-", "+").replace("_", "/")
    else:
        return None
    alphabet = ALPHABETS[code]
    k, n = len(alphabet), len(symbols)

    def tail(z):
        return 0.5 * math.erfc(z / math.sqrt(2))

    chi2 = sum((symbols.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
    df = k - 1
    ps = [tail(((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))]
    half = [alphabet.index(c) >= k // 2 for c in symbols]
    ones = sum(half)
    mean = 1 + 2 * ones * (n - ones) / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    turns = 1 + sum(a != b for a, b in zip(half, half[1:]))
    ps.append(0.0 if spread <= 0 else min(1, 2 * tail(abs(turns - mean) / math.sqrt(spread))))
    off = [alphabet.index(c) - (k - 1) / 2 for c in symbols]
    serial = sum(a * b for a, b in zip(off, off[1:])) / (math.sqrt(n - 1) * (k * k - 1) / 12)
    ps.append(min(1, 2 * tail(abs(serial))))
    p = min(1, 3 * min(ps))
    return code, sum(len(run) >= x for x in LENGTHS) - 1, min(STEPS, math.floor(-math.log10(max(p, 1e-300)) / STEP))


def plain_spans(texts):
    assign = re.compile(r"(?:%s)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % "|".join(
        "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))
    base, runs = [], []
    for t in texts:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base.append(sorted(found))
        runs.append([(m.start(), m.end(), plain_tests(m[0])) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t)])
    classes = {}
    for r in (x for one in runs for x in one if x[2]):
        classes.setdefault(r[2][:2], []).append(r[2][2])
    cut = {}
    for key, steps in classes.items():
        ok = [s for s in set(steps) if 10 ** (-s * STEP) <= RATE * sum(x >= s for x in steps) / len(steps)]
        cut[key] = min(ok, default=STEPS + 1)
    extra = [[(s, 3, e) for s, e, x in one if x and x[2] < cut[x[:2]] and not any(b[0] < e and s < b[2] for b in mine)]
             for one, mine in zip(runs, base)]
    return base, extra


def told(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{s}:{e}" for s, k, e in sorted(spans))


def secret_texts():
    rng = random.Random(4)
    b64 = ALPHABETS[3]
    texts = [None, "", "no secrets here", "token = abc", "token=token:abcdefgh", 'PassWord" : "hunter22" é api_key=ab.cd-ef', "\x01token=\x01abcdef1",
             "secret: secret=abcdefg", "AKIA" + "A" * 15 + " AKIA" + "B7" * 9, "é" * 5 + "ab12" * 6 + "é", "0" * 23 + " " + "0123456789abcdef" * 4,
             "x " * 30_000 + "token='" + "q9Z" * 8 + "'", "apikey=1234567 apiKey:7654321 APIKEY=abcdefg"]
    texts += ["key " + "".join(rng.choice(b64[:-2]) for _ in range(40)) + " end" for _ in range(30)]
    texts += ["id " + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(32)) for _ in range(10)]
    texts += ["go /usr/share/Lib" + "/python3" * n + "/site-packages" for n in range(1, 12)]
    texts += ["see AnotherVeryLongIdentifierNameNumber" + str(n) for n in range(12)]
    return texts


def test_secret_spans_equal_plain_version(spark):
    texts = secret_texts()
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "token=abcdefgh", None, None)])
    texts.append("token=abcdefgh")
    base, extra = plain_spans(texts)
    assert sum(map(len, extra)) >= 30
    want = [
        (i if i < len(texts) - 1 else None, *(sum(x[1] == k for x in b) for k in range(3)),
         hashlib.sha256(told(b).encode()).hexdigest(), told(b + e))
        for i, (b, e) in enumerate(zip(base, extra))
    ]
    assert sorted(map(tuple, secret_spans(docs).collect()), key=repr) == sorted(want, key=repr)
    assert secret_spans(docs.limit(0)).count() == 0


def test_redaction_replaces_merged_spans(spark):
    texts = secret_texts()
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    base, extra = plain_spans(texts)
    got = redacted(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    for row in got.collect():
        t = texts[row["doc_id"]]
        merged = []
        for s, _, e in sorted(base[row["doc_id"]] + extra[row["doc_id"]]):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        for s, e in reversed(merged):
            t = t[:s] + "[secret]" + t[e:]
        assert row["text"] == t and row["n_chars"] == (None if t is None else len(t))


# --- mixing


def test_mix_meets_targets_and_agrees_with_itself(spark):
    rng = random.Random(2)
    rows = [(i, words(i, rng.randrange(0, 40), "abc"), None, rng.choice(["a", "a", "a", "b", "B", "é", None])) for i in range(600)]
    rows += [(7, "twice the same row", None, "b")] * 3 + [(None, None, None, "c"), (None, "x", None, "c"), (601, "", None, None)]
    docs = frame(spark, rows)
    got = mix(docs).drop("shuffled")
    first = sorted(map(tuple, got.collect()), key=repr)
    assert first == sorted(map(tuple, mix(docs.repartition(7)).drop("shuffled").collect()), key=repr)
    assert len(first) == len(rows)
    sizes, taken, target = {}, {}, {}
    for _, source, size, of_source, goal, some in first:
        sizes[source] = sizes.get(source, 0) + size
        taken[source] = taken.get(source, 0) + some
        target[source] = goal
        assert 0 <= some <= 2 * size
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        level = (budget - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and 2 * sizes[s] <= level * weight[s]}
        if not more:
            break
        capped |= more
    for s in order:
        assert target[s] == pytest.approx(2 * sizes[s] if s in capped else level * weight[s])
        assert abs(taken[s] - target[s]) <= 40
    assert sum(taken.values()) == math.floor(budget)
    assert mix(docs.limit(0)).count() == 0


def test_mixed_documents_repeat_whole_rows(spark):
    rows = [(i, words(i, 5 + i % 7, "abc"), None, "ab"[i % 2]) for i in range(200)] + [(900, "", None, "a"), (901, None, None, None)]
    docs = frame(spark, rows)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    times = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in mix(docs).collect():
        assert times.get(r["doc_id"], 0) == (r["taken"] // r["size"] if r["size"] else 1)
    assert mixed_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [(7,), (None,), (7, 8, None)])
def test_rows_that_repeat_an_id_are_taken_as_often_as_the_mix_takes_them(spark, ids):
    rows = [(ids[i % len(ids)], words(i, 10, "abc"), "en", "ab"[i % 2]) for i in range(60)] + [(100 + i, words(i, 10, "xyz"), "en", "c") for i in range(20)]
    docs = frame(spark, rows)
    taken = sum(r["taken"] // r["size"] for r in mix(docs).collect())
    out = mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == taken
    assert max(r["n"] for r in out.groupBy("text").agg(F.count("*").alias("n")).collect()) <= 2


# --- packing


def test_encoding_equals_the_tokenizer():
    slow = tokenizer_of(VOCABULARY[0])
    texts = ["", " ", "a  b\n\n c", "it's <|endoftext|> x", "naïve Straße 123 １２", "日本語 текст", "a\x85b c​d", "\x1c\x1d x", "é ɀ", "'S 'LL"]
    for t in texts:
        assert encode(t, *VOCABULARY).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_windows_are_full_or_a_power_of_two():
    rng = np.random.default_rng(1)
    tails = [rng.integers(0, 500, rng.integers(1, 1024)).astype(np.uint32) for _ in range(90)] + [np.zeros(3, np.uint32)] * 40
    seen = [[] for _ in tails]
    sizes = []
    for window in packed(tails):
        sizes.append(sum(n for *_, n in window))
        for i, start, n in window:
            seen[i].append((start, n))
    assert all(s == 1024 or s & (s - 1) == 0 for s in sizes) and sum(s < 1024 for s in sizes) <= 10
    for tail, pieces in zip(tails, seen):
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == len(tail)


def test_pack_round_trip(spark):
    rows = [(i, words(i, 3 + 37 * i % 700, "abcdé "), None, None) for i in range(60)]
    rows += [(100, None, None, None), (101, "", None, None), (102, words(9, 6000, "abc"), None, None), (7, rows[7][1], None, None), (None, "no id", None, None)]
    docs = frame(spark, rows)
    got = pack(docs, shard=16).collect()
    slow = tokenizer_of(VOCABULARY[0])
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 1024 or at & (at - 1) == 0
    for key in {r[0] for r in rows}:
        copies = [np.array([*slow.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows if r[0] == key]
        mine = [r for r in got if r["doc_id"] == key]
        assert sum(r["length"] for r in mine) == sum(map(len, copies))
        for r in mine:
            assert any(r["doc_tokens"] == len(c) and zlib.crc32(c[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for c in copies)
    assert pack(docs.limit(0)).count() == 0


def test_every_neighbour_is_found():
    """Large groups of copies, many small neighbours, and neighbours by the text before the remainder."""

    def mixed_windows(groups, tails, **more):
        return sum(len({groups[i] for i, *_ in one}) > 1 for one in packed(tails, **more))

    rng = np.random.default_rng(3)
    copy = rng.integers(0, 500, 100).astype(np.uint32)
    tails = [copy if i % 2 else rng.integers(1000, 60_000, 100).astype(np.uint32) for i in range(100)]
    # Others find nobody, so the copies that meet are those that a copy has found.
    assert sum(sum(i % 2 for i, *_ in one) >= 8 for one in packed(tails)) >= 4
    tails = [rng.integers(i % 8 * 20, i % 8 * 20 + 20, 20).astype(np.uint32) for i in range(400)]
    # A window takes 51 of 50: the last two of each are of other groups.
    first = [[i % 8 for i, *_ in one] for one in packed(tails)]
    assert all(max(map(one.count, one)) >= 40 for one in first[:4])
    whole = [np.unique(rng.integers(i % 4 * 300, i % 4 * 300 + 300, 900), return_counts=True) for i in range(80)]
    assert mixed_windows([i % 4 for i in range(80)], [np.full(64, 7, np.uint32)] * 80, bags=whole) <= 4


def test_frequencies_are_those_of_all_whole_documents(spark):
    from marginalia.llm.packing import Corpus, bag_of

    ids = np.array([5, 5, 9, 3, 5, 9, 0], np.uint32)
    head = np.concatenate(np.unique(ids[:4], return_counts=True)).astype(np.uint32)
    assert [x.tolist() for x in bag_of(ids[4:], head)] == [[3, 5, 9], [1, 3, 2]]
    rows = [(i, words(i % 7, 30 + i % 7 * 40, "abcdefgh"), None, None) for i in range(40)] + [(90, None, None, None)]
    slow = tokenizer_of(VOCABULARY[0])
    want = [slow.encode(t or "", add_special_tokens=False).ids for _, t, *_ in rows]
    seen = []
    import marginalia.llm.packing as module

    kept = module._packed
    module._packed = lambda window, shard, corpus: seen.append(corpus) or kept(window, shard, corpus)
    try:
        pack(frame(spark, rows), window=64, shard=8)
    finally:
        module._packed = kept
    df = {}
    for one in want:
        for i in set(one):
            df[i] = df.get(i, 0) + 1
    assert isinstance(seen[0], Corpus) and seen[0].n == 41 and seen[0].mean == pytest.approx(sum(map(len, want)) / 41)
    assert dict(zip(seen[0].ids.tolist(), seen[0].df.tolist())) == df


def test_similar_documents_share_shards_and_windows(spark):
    rng = random.Random(5)
    vocabulary = words(1, 400, "abcdefgh").split()
    texts = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(400)]
    rng.shuffle(kin := [k for k in range(20) for _ in range(5)])
    models = [rng.choices(vocabulary, k=40) for _ in range(20)]
    for k in kin:
        near = list(models[k])
        near[rng.randrange(40)] = rng.choice(vocabulary)
        texts.append(" ".join(near))
    got = pack(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), shard=32).collect()
    assert len({r["sequence_id"] >> 40 for r in got}) >= 12

    def beside(place):
        """Share of the planted documents that meet one of their kind in a place."""
        places = {}
        for r in got:
            if r["doc_id"] >= 400:
                places.setdefault((place(r), kin[r["doc_id"] - 400]), set()).add(r["doc_id"])
        return len(set().union(*(x for x in places.values() if len(x) > 1))) / 100

    assert beside(lambda r: r["sequence_id"] >> 40) >= 0.8 and beside(lambda r: r["sequence_id"]) >= 0.7


# --- urls


def test_urls_are_judged(spark):
    rows = [(1, "http://A.Example.ORG/en/12?x", "a.example.org", "/en/12", "example.org/en/1", "block"),
            (2, "https://example.org/en/2", "example.org", "/en/2", "org/", "allow"), (3, "http://org", "org", "", None, "allow"),
            (4, "http://borg/x", "borg", "/x", None, "allow"), (5, None, "", "", None, "allow"), (6, "no scheme", "", "", None, "allow"),
            (7, "ftp://x.com/de/://y", "x.com", "/de/://y", "com/de/", "block"), (8, "http://x.com?q=/de/", "x.com", "", None, "allow"),
            (9, "http://a.net/spam/1", "a.net", "/spam/1", None, "block"), (9, "http://a.net/spam/1", "a.net", "/spam/1", None, "block"),
            (None, "http://İ.com/fr/", "İ.com", "/fr/", "com/fr/", "allow"), (10, "", "", "", None, "allow")]
    labelled = [(100 + i, f"http://b{i % 5}.net/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)]
    pages = spark.createDataFrame([(p, u, "x") for p, u, *_ in rows] + [(p, u, "x") for p, u in labelled], "page_id bigint, url string, host string")
    labels = spark.createDataFrame([(p, 0 if "spam" in u else 1, 0) for p, u in labelled] + [(None, 0, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    got = judged_urls(pages, labels)
    want = [(p, h, path, rule, v) for p, _, h, path, rule, v in rows]
    assert sorted((tuple(r) for r in got.collect() if r["page_id"] is None or r["page_id"] < 100), key=repr) == sorted(want, key=repr)
    assert judged_urls(pages.limit(0), labels).count() == 0
    alone = judged_urls(pages.where("page_id < 7 AND page_id > 2"), labels.limit(0)).collect()
    assert {r["verdict"] for r in alone} == {"allow"}


def test_rules_of_every_length_hold(spark):
    """All combinations of two hosts, two by two path parts and two queries; one of them is blocked."""
    made = [(h, a, b, q) for h in "xy" for a in "pr" for b in "st" for q in "uv"]
    urls = [(f"http://{h}.net/{a}/{b}?{q}=1", ("h:net", f"h:{h}", f"p:{a}", f"p:{b}", f"q:{q}")) for h, a, b, q in made]
    rows = [(16 * k + i, *urls[i]) for k in range(8) for i in range(16)]
    block = {p for p, *_ in rows if p % 16 == 0}
    pages = spark.createDataFrame([(p, u) for p, u, _ in rows] + [(1000 + i, urls[i][0]) for i in range(16)], "page_id bigint, url string")
    labels = spark.createDataFrame([(p, int(p not in block)) for p, *_ in rows], "doc_id bigint, quality int")
    times = {}
    for p, _, tokens in rows:
        for n in range(1, 6):
            for some in itertools.combinations(tokens, n):
                hit = times.setdefault(some, [0, 0])
                hit[0] += p in block
                hit[1] += 1
    rules = [set(x) for x, (hit, n) in times.items() if hit >= math.ceil(0.01 * len(rows)) and hit / n >= 0.8]
    assert min(map(len, rules)) == 4
    want = {p: "block" if any(r <= set(t) for r in rules) else "allow" for p, _, t in rows + [(1000 + i, *urls[i]) for i in range(16)]}
    assert want[1000] == "block" and want[1001] == "allow"
    assert {r["page_id"]: r["verdict"] for r in judged_urls(pages, labels).collect()} == want


def test_parts_of_rules_make_them_idle(spark):
    from marginalia.llm.common import Scratch
    from marginalia.llm.url_rules import block_rules

    rows = [(["a", "b", "c", "d", "e"], True)] * 5 + [(list(x), False) for x in ("abce", "abde", "acde", "bcd")] * 5
    rows += [(["f", "a"], True)] * 5
    rules, items = block_rules(spark.createDataFrame(rows, "tokens array<string>, block boolean"), Scratch(spark))
    assert sorted(r["items"] for r in rules.collect()) == [["a", "b", "c", "d"], ["b", "c", "d", "e"], ["f"]]
    assert {r["token"] for r in items.collect()} == set("abcdef")


def test_a_long_url_that_is_repeated_is_mined_in_seconds(spark):
    """Half of the pages share a url of 40 parts; the parts are one item, and any of them makes the rule."""
    import time

    long = "http://deep.net/" + "/".join(f"part{k}" for k in range(40)) + "?a=1"
    rows = [(i, long if i % 2 else f"http://x{i % 9}.net/{'p' if i % 4 else 'q'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows + [(1000, "http://y.org.net/part7"), (1001, "http://y.org.net/other")], "page_id bigint, url string")
    for good_copies, verdict in ((0, "block"), (60, "allow")):
        labels = spark.createDataFrame([(i, int(not i % 2 or i < 2 * good_copies)) for i, _ in rows], "doc_id bigint, quality int")
        start = time.perf_counter()
        got = {r["page_id"]: r["verdict"] for r in judged_urls(pages, labels).collect()}
        assert time.perf_counter() - start < 30
        assert got[1] == got[1000] == verdict and got[0] == got[1001] == "allow"


# --- classifiers


def language_rows():
    letters = {"aa": "abcdefg ", "bb": "defghij ", "cc": "xyzéèü "}
    return [(i, words(i, 30, letters[k]), k, "s") for i in range(240) for k in [sorted(letters)[i % 3]]]


def test_languages_on_held_out_rows(spark):
    odd = [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "123 !!", "bb", "s"), (1003, "q", None, "s"), (None, "abcdefg abc", "aa", None)]
    docs = frame(spark, language_rows() + odd)
    got = {r["doc_id"]: r for r in predict_languages(docs).collect()}
    truth = {i: k for i, _, k, _ in language_rows()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i in truth)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] in ("aa", "bb", "cc")
    assert predict_languages(docs.limit(0)).count() == 0


def plain_grams(text):
    """Letter 3-grams as strings: lower case, one blank for whatever lies between words and at both ends."""
    line = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
    return [line[i : i + 3] for i in range(len(line) - 2)] if line.strip() else []


def test_languages_equal_counting_with_sets(spark):
    """Plain sets of strings in place of the filters, which are wide enough here to hold no false positive that counts."""
    rows = language_rows() + [(500, words(500, 9, "abcdé") + " 12--" + words(501, 9, "éxyz"), None, "s"), (501, "b", "bb", "s"), (None, "cab", "aa", "s")]
    counts = {}
    for i, text, lang, _ in rows:
        if lang is not None and zlib.crc32(b"" if i is None else str(i).encode()) % 3 != 1:
            for g in plain_grams(text):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    rate = {lang: {g: n / sum(of.values()) for g, n in of.items()} for lang, of in counts.items()}
    most = {g: max(of.get(g, 0.0) for of in rate.values()) for of in rate.values() for g in of}
    has = {lang: {g for g, r in of.items() if r >= 1e-5 and r >= 0.5 * most[g]} for lang, of in rate.items()}
    got = {r["doc_id"]: r for r in predict_languages(frame(spark, rows)).collect()}
    for i, text, _, _ in rows:
        hits = {lang: sum(g in has[lang] for g in plain_grams(text)) for lang in sorted(has)}
        best = max(sorted(hits), key=lambda lang: hits[lang])
        if sorted(hits.values())[-1] > sorted(hits.values())[-2]:
            assert got[i]["lang_pred"] == best
        assert got[i]["score"] == pytest.approx(hits[best] / sum(hits.values()), abs=2e-3)


def test_filters_hold_every_language_of_a_gram(spark):
    from marginalia.llm.common import Scratch

    rows = spark.createDataFrame([(f"l{i:02d}", "shared " * 5 + f"w{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(70)], "lang string, text string")
    langs, table = fit_filters(rows, Scratch(spark), slots=1 << 14)
    assert len(langs) == 70 and table.shape == (1 << 14, 2)
    grams = next(gram_hashes("shared"))
    a, b = _positions(grams, 1 << 14, 2)
    both = table[a] & table[b]
    assert all(int(lo) == (1 << 64) - 1 and int(hi) & 63 == 63 for lo, hi in both)


def quality_tables(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, ("BUY!! NOW!! $$$ " * 20 if i % 2 else words(i, 20, "abc").replace(" ", "### ")) if bad else words(i, 60, "abcdefgh") + ".", "en", "s"))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 0 if bad else 1, int(i % 7 == 0)))
    rows += [(1000, None, None, None), (1001, "", None, None), (None, "abc abc", None, None), (1002, "z" * 300_000, None, None)]
    return frame(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = quality_tables(spark)
    got = {r["doc_id"]: r for r in quality_scores(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and got[None]["held_out"]
    assert all(got[i]["predicted"] == 1 for i in held if i % 5)
    assert sum(got[i]["predicted"] == 0 for i in held if i % 5 == 0) >= 0.8 * sum(i % 5 == 0 for i in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert got[1000]["score"] == got[1001]["score"]
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    assert {r["score"] for r in quality_scores(docs, labels.limit(0)).collect()} == {1.0}
    assert quality_scores(docs.limit(0), labels).count() == 0


def plain_shape(text):
    """The features of a text, byte by byte and word by word."""
    data = (text or "").encode()
    pairs = [[0] * CLASSES for _ in range(CLASSES)]
    for a, b in zip(b"\n" + data, data):
        pairs[BYTE_CLASSES[a]][BYTE_CLASSES[b]] += 1
    out = [math.sqrt(n / max(1, len(data))) for line in pairs for n in line]
    found = data.split()
    if not found:
        return out + [0.0] * 8
    n, lines, sizes = len(found), data.split(b"\n"), [len(w) for w in found]
    mean = sum(sizes) / n
    spread = math.sqrt(sum((k - mean) ** 2 for k in sizes) / n)
    most = max(found.count(w) for w in set(found))
    again = sum(found[i] == found[i - 1] for i in range(1, n))
    return out + [math.log(1 + n), mean / 10, spread / 10, len(set(found)) / n, most / n, again / n, len(set(lines)) / len(lines), math.log(1 + n / len(lines))]


def test_quality_scores_equal_plain_ones(spark):
    docs, labels = quality_tables(spark)
    docs = docs.where("doc_id IS NULL OR doc_id <> 1002").union(frame(spark, [(1003, "wörter über\n\nwörter a a\tb|c", None, None)]))
    model = fit_quality(docs, labels)
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in quality_scores(docs, labels).collect():
        x = plain_shape(rows[r["doc_id"]])
        z = sum(w * min(4.0, max(-4.0, (v - m) / s)) for w, v, m, s in zip(model["w"], x, model["mean"], model["std"])) + model["w"][-1]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_the_scorer_has_the_least_non_negative_risk():
    rng = np.random.default_rng(6)
    good, bad = rng.normal(0.7, 1, (900, 3)), rng.normal(-0.7, 1, (900, 3))
    trusted, unlabelled = good[:500], np.concatenate([good[500:], bad[:600]])
    model = fit_scorer(trusted, unlabelled)
    prior = float(model["prior"][0])
    assert abs(prior - 0.4) < 0.1

    def risk(w):
        p, u = ([sum(a * b for a, b in zip(w, (x - model["mean"]) / model["std"])) + w[-1] for x in part] for part in (trusted, unlabelled))
        plus = sum(math.log1p(math.exp(-g)) for g in p) / len(p)
        minus = sum(math.log1p(math.exp(g)) for g in u) / len(u) - prior * sum(math.log1p(math.exp(g)) for g in p) / len(p)
        return prior * plus + max(0.0, minus) + 3e-3 / 2 * float(np.dot(w, w))

    least = risk(model["w"])
    assert all(least < risk(model["w"] + step) for step in rng.normal(0, 0.3, (20, 4)))


def test_scores_do_not_depend_on_partitions(spark):
    """Samples are drawn by hashes and summed in one order, so one partition and many give the same scores."""
    docs, labels = quality_tables(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for parts in (1, 4, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        some = docs.repartition(parts)
        seen.append([
            sorted(map(tuple, quality_scores(some, labels, fit_docs=40).select("doc_id", "score").collect()), key=repr),
            sorted(map(tuple, toxicity_scores(some, labels, fit_docs=150).select("doc_id", "p_toxic", "p_kind_2").collect()), key=repr),
            sorted(map(tuple, predict_languages(some, docs_per_lang=30).select("doc_id", "lang_pred", "score").collect()), key=repr),
        ])
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] == seen[2]


def test_clashing_column_names_change_nothing(spark):
    """Columns that carry names the operators use themselves, or that are no plain words."""
    docs, labels = quality_tables(spark)
    odd = docs.withColumns({n: F.lit(1) for n in ("label", "my col", "_row", "place", "fp", "size", "kind", "x", "rep", "`q`", "a.b")})
    for of in (quality_scores, toxicity_scores):
        assert sorted(map(tuple, of(odd, labels).collect()), key=repr) == sorted(map(tuple, of(docs, labels).collect()), key=repr)
    assert sorted(map(tuple, predict_languages(odd).collect()), key=repr) == sorted(map(tuple, predict_languages(docs).collect()), key=repr)
    kept = good_documents(odd, labels)
    assert kept.columns == odd.columns and kept.count() == good_documents(docs, labels).count()
    assert sorted(map(tuple, pack(odd).select("doc_id", "length", "ids_crc32").collect()), key=repr) == sorted(map(tuple, pack(docs).select("doc_id", "length", "ids_crc32").collect()), key=repr)
    mixed = mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == mixed_documents(docs).count()
    assert redacted(odd).columns == odd.columns and redacted(odd).count() == docs.count()


def test_class_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, 8000), rng.normal(-2, 1, 8000)
    mixed = np.concatenate([good[:2800], bad[:1200]])
    assert abs(class_prior(good[3000:], mixed) - 0.7) < 0.05


def test_toxicity_on_held_out_rows(spark):
    rows, labels = [], []
    for i in range(500):
        text = words(i, 50, "abcdefgh")
        if i % 4 == 0:
            text = text[:60] + " horrid villain " + text[60:] + (" horrid" * 4 if i % 8 == 0 else "")
        rows.append((i, text, "en", "s"))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = frame(spark, rows + [(1000, None, None, None), (None, "horrid villain", None, None)])
    marks = spark.createDataFrame(labels + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity_scores(docs, marks).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["toxic"] == (i % 4 == 0) for i in held)
    assert got[1000]["toxic"] == 0
    assert {r["p_toxic"] for r in toxicity_scores(docs, marks.where("toxic = 0")).collect()} == {0.0}
    assert toxicity_scores(docs.limit(0), marks).count() == 0


def test_chain_feeds_earlier_categories():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4)).astype(np.float32)
    first = (x[:, 0] > 0).astype(float)
    chain = fit_chain(x, {"first": first, "second": first})
    assert [len(w) for w in chain] == [5, 6] and chain[1][4] > 0.5
    p = chain_probabilities(x, chain)
    assert ((p[:, 1] > 0.5) == (first == 1)).mean() > 0.95


def test_a_later_category_gains_by_the_earlier_ones():
    """Both ends of a line are toxic: no linear model of the line alone can say so, one that sees the kinds can."""
    rng = np.random.default_rng(4)
    x = rng.uniform(-3, 3, size=(1500, 1)).astype(np.float32)
    low, high = (x[:, 0] < -1).astype(float), (x[:, 0] > 1).astype(float)
    toxic = low + high
    alone = chain_probabilities(x, fit_chain(x, {"toxic": toxic}))[:, -1]
    chained = chain_probabilities(x, fit_chain(x, {"kind_1": low, "kind_2": high, "toxic": toxic}))[:, -1]
    assert ((alone > 0.5) == toxic).mean() < 0.75 and ((chained > 0.5) == toxic).mean() > 0.9


def test_chain_equals_a_plain_one():
    """Every model fitted by itself: earlier probabilities of a row come from features and models made without its fold."""
    rng = np.random.default_rng(5)
    x, other = (rng.normal(size=(90, 3)).astype(np.float32) for _ in range(2))
    keys = rng.integers(0, 1000, 90)
    marks = {"a": (x[:, 0] > 0).astype(float), "b": (x[:, 1] > 0).astype(float)}
    fold = np.array([int(k) % 3 for k in keys])
    first = np.zeros((90, 1), np.float32)
    for i in range(90):
        mine = other * (fold[i] + 1)
        first[i] = _probability(mine[i : i + 1], _logistic(mine[fold != fold[i]], marks["a"][fold != fold[i]]))[0]
    got = fit_chain(x, marks, keys=keys, without=lambda k: other * np.float32(k + 1))
    assert np.allclose(got[0], _logistic(x, marks["a"]))
    assert np.allclose(got[1], _logistic(np.hstack([x, first]), marks["b"]), atol=1e-4)


def test_cues_equal_counting_and_are_chosen_without_each_fold(spark):
    rows = [(int(i % 3 == 0), words(i, 12, "abcd") + (" horrid" if i % 3 == 0 else "") + (" vile" if i % 2 else ""), i * 7919 % 101) for i in range(120)]
    rows += [(0, None, 3), (1, "", 4)]
    sets = find_cues(spark.createDataFrame(rows, "label int, text string, place bigint").repartition(5), cues=40)
    held = [(label, {int(g) for b in _buckets(text) for g in b}, place % 3) for label, text, place in rows]
    for left_out, got in zip([None, 0, 1, 2], sets):
        some = [(label, grams) for label, grams, fold in held if fold != left_out]
        bad, fine = sum(v == 1 for v, _ in some), sum(v == 0 for v, _ in some)
        score = {}
        for g in set().union(*(grams for _, grams in some)):
            a, b = sum(g in grams for v, grams in some if v), sum(g in grams for v, grams in some if not v)
            if a >= LEAST and a / bad > 2 * b / fine:
                n = bad + fine
                score[g] = n * (a * (fine - b) - b * (bad - a)) ** 2 / ((a + b) * (n - a - b + 1) * bad * fine)
        assert got.tolist() == sorted(sorted(score, key=lambda g: (-score[g], g))[:40])


def test_design_equals_features_row_by_row():
    texts = ["horrid villain horrid", "", None, "a quiet word of horrid sense"]
    every = np.unique(np.concatenate([b for t in texts for b in _buckets(t)]))
    kept = every[::3]
    doc, cue, count, total = [], [], [], []
    for i, t in enumerate(texts):
        counts, n = cue_counts(t, lookup(every))
        at = np.flatnonzero(counts)
        doc, cue, count, total = doc + [i] * len(at), cue + at.tolist(), count + counts[at].tolist(), total + [n]
    x = design(*(np.array(v, np.int64) for v in (doc, cue, count, total)), np.searchsorted(every, kept))
    assert np.array_equal(x, np.array([features(*cue_counts(t, lookup(kept))) for t in texts]))


def test_kinds_follow_what_occurs_together():
    one, two = np.tile([1.0, 1, 0, 0], (7, 1)), np.tile([0.0, 0, 2, 1], (4, 1))
    assert two_kinds(np.vstack([two, one])).tolist() == [1] * 4 + [0] * 7
    assert two_kinds(one).tolist() == [0] * 7 and two_kinds(one[:1]).tolist() == [0]
    assert two_kinds(np.zeros((2, 3))).tolist() == [0, 0]
