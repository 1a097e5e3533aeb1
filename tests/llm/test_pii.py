"""Personal data against the stated patterns and a plain bootstrapping over dictionaries."""

import hashlib
import random
import re

import pytest

from marginalia.llm.pii import KINDS, base_spans, joined_spans, look_alikes, personal_spans

DOCS = "doc_id bigint, text string, row int, places string, value double, `my col` int, spans string"
STATED = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def stated_spans(text):
    out = []
    for kind, pattern in STATED.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2:
                twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(x // 10 + x % 10 for x in twice) % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def plain(texts):
    """Base spans, and those found by contexts, of every text."""
    base = [stated_spans(t or "") for t in texts]
    places, edges, all_of, followed = [], {}, {}, {}
    for t, seeds in zip(texts, base):
        t = t or ""
        others = []
        for m in re.finditer(r"[A-Za-z0-9_@/.-]+", t):
            a, b = m.start() + len(m[0]) - len(m[0].lstrip("_/.-")), m.end()
            token = m[0].strip("_/.-")
            b = a + len(token)
            if 6 <= len(token) <= 64 and len(re.findall("[0-9]", token)) >= 4 and not any(s < b and a < e for s, _, e in seeds):
                others.append((a, 4, b))
        words = [(m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", t)]
        line = ["", ""] + [w for _, w in words]
        for i in range(1, len(line)):
            for p in (line[i], f"{line[i - 1]} {line[i]}"):
                all_of[p] = all_of.get(p, 0) + 1
        mine, slots = [], set()
        for s, k, e in sorted(seeds + others):
            at = sum(end <= s for end, _ in words) + 1
            two = (line[at], f"{line[at - 1]} {line[at]}")
            for p in two:
                edges.setdefault(p, {}).setdefault(t[s:e].lower(), k < 4)
                edges[p][t[s:e].lower()] |= k < 4
                followed[p] = followed.get(p, 0) + (at not in slots)
            slots.add(at)
            mine.append(((s, k, e), two))
        places.append(mine)
    gain = {}
    for _ in range(8):
        good = {}
        for p, values in edges.items():
            share = min(1.0, followed[p] / all_of[p])
            scores = [1.0 if seed else gain.get(v, 0.0) for v, seed in values.items()]
            if sum(x >= 0.6 for x in scores) >= 3 and share * sum(scores) / len(scores) >= 0.6:
                good[p] = share * sum(scores) / len(scores)
        fresh = {}
        for p, score in good.items():
            for v, seed in edges[p].items():
                if not seed:
                    fresh[v] = fresh.get(v, 1.0) * max(1 - score, 1e-12)
        fresh = {v: 1 - x for v, x in fresh.items() if 1 - x >= 0.6}
        if len(fresh) == len(gain):
            break
        gain = fresh
    return base, [[s for s, two in mine if s[1] == 4 and any(p in good for p in two)] for mine in places]


def told(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def texts():
    rng = random.Random(8)
    plain_words = "the of and la under once when house tree".split()

    def filler(n=6):
        return " ".join(rng.choice(plain_words) for _ in range(n))

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    out = [None, "", "no data", "a@b a@b.c.d@e.f x%+@y-z.example..com @@ a@@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 1..2.3.4.5 000000001.2.3.4",
           "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 11111111111111111111111", "+1 (555) 123-4567 +12 +1 2 3 + 4 +123456789.", "é" * 9 + "bob@x.yz" + "ß 10.0.0.1é"]
    # Seeds behind a cue; other cards fail the checksum and have to be found by the context.
    for i in range(40):
        out.append(f"{filler()} Card Number: 4111 1111 1111 1111 {filler()} reach me: user{i}@mail.example.com, {filler()}")
    out += [f"{filler()} reach me: USER-{digits(6)} {filler()}" for _ in range(2)]
    # A second generation: only values that the first cue promoted support this cue.
    shared = [f"AB{digits(7)}" for _ in range(3)]
    out += [f"{filler()} reach me: {v} {filler()} my badge is {v} end" for v in shared]
    out += [f"{filler()} my badge is {v} end" for v in (shared[0], f"ZZ{digits(7)}")]
    # A frequent word and a number behind it.
    out += [f"the {digits(6)} and the house of the tree" for _ in range(5)]
    out += ["copy " + "contact 10.1.2.3 now"] * 6
    out.append("x " * 30_000 + "reach me: " + "K9" * 5)
    return out


def test_base_spans_are_the_stated_ones():
    rng = random.Random(3)
    for n in range(3000):
        t = "".join(rng.choice("a1.2@ +-(0)9é%_3") for _ in range(rng.randrange(40)))
        assert base_spans(t) == stated_spans(t), t
        assert all(s[0] < s[2] for s in look_alikes(t, base_spans(t)))


def test_long_runs_are_read_in_linear_time():
    for t in ("a" * 400_000, "1" * 400_000, "@" * 400_000, "1." * 200_000, "+1(" * 100_000, "a@b" * 100_000, "1 " * 200_000, "a1_" * 100_000):
        base_spans(t)
        look_alikes(t, base_spans(t))


def test_spans_equal_plain_version(spark):
    ts = texts()
    base, extra = plain(ts)
    assert sum(map(len, extra)) >= 8
    rows = [(i if i % 7 else None, t, 1, "p", 0.5, 2, "s") for i, t in enumerate(ts)]
    got = personal_spans(spark.createDataFrame(rows, DOCS).repartition(4)).withColumn("spans", joined_spans("spans"))
    want = [
        (r[0], *(sum(s[1] == k for s in b) for k in range(4)), hashlib.sha256(told(b).encode()).hexdigest(), told(b + e))
        for r, b, e in zip(rows, base, extra)
    ]
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    # The badge cue has no seed behind it: it was learnt from promoted values.
    badge = [t[s:e] for t, x in zip(ts, extra) for s, _, e in x if "badge is" in t and t[:s].endswith("badge is ")]
    assert len(badge) == 5 and any(b.startswith("ZZ") for b in badge)


@pytest.mark.parametrize("blocks", [1, 40])
def test_patterns_in_blocks_give_the_same(spark, blocks):
    from marginalia.llm import pii
    from marginalia.llm.common import Scratch

    rows = [(i, t, 1, "p", 0.5, 2, "s") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, DOCS)
    scratch = Scratch(spark)
    made = scratch.save(df.select("doc_id", "text").mapInArrow(
        pii._scan, f"doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, places {pii.PLACES}"))
    graph = pii.pattern_graph(df, made.select("places"), scratch, block=10_000 // blocks if blocks > 1 else 1 << 18)
    good = sorted(r["pattern"] for r in pii.good_patterns(graph, scratch).collect())
    one, two = (k.tolist() for k in pii.context_keys("reach Me the".split(), pii.Keys()))
    assert len(good) >= 4 and two[2] in good and one[2] in good and one[3] not in good


def test_no_rows(spark):
    df = spark.createDataFrame([], DOCS)
    assert personal_spans(df).count() == 0
