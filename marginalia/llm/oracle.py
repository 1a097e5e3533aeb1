"""SQL twins of the operators that SQL can state."""

from __future__ import annotations

MIXING = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, source, md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight FROM s),
-- Sources that cannot meet their share come first; after how many of them is nobody above?
o AS (
  SELECT *, 2 * source_size / CAST(weight AS DOUBLE) AS ratio,
    row_number() OVER (ORDER BY 2 * source_size / CAST(weight AS DOUBLE), rank) - 1 AS place
  FROM w),
l AS (
  SELECT place, ratio,
    ((SELECT sum(source_size) FROM w) * CAST(1.5 AS DOUBLE)
      - coalesce(sum(2 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM o),
t AS (
  SELECT w.*, least(CAST(2 * source_size AS DOUBLE),
    (SELECT level FROM l WHERE ratio > level OR level = 0 ORDER BY place LIMIT 1) * weight) AS target
  FROM w),
q AS (
  SELECT d.id, d.doc_id, d.source, d.size, t.source_size, t.target, t.rank, t.weight,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffled, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CAST(pass * source_size + before + size AS DOUBLE) / weight AS finish
  FROM q CROSS JOIN (VALUES (0), (1)) AS p(pass)),
u AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY finish, rank, pass, before, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM c)
SELECT any_value(doc_id) AS doc_id, any_value(source) AS source, CAST(any_value(size) AS BIGINT) AS size,
  any_value(source_size) AS source_size, any_value(target) AS target,
  CAST(sum(greatest(0, least(size, CAST(floor((SELECT sum(source_size) FROM w) * CAST(1.5 AS DOUBLE)) AS BIGINT) - used))) AS BIGINT) AS taken
FROM u GROUP BY id
"""


def _listed(rules) -> tuple[str, str]:
    """Rule text and verdict as CASE expressions, the longest rule first."""
    rule = verdict = ""
    for what, host, path in sorted(rules, key=lambda r: -len(r[1]) - len(r[2])):
        fits = f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}')"
        rule += f" WHEN {fits} THEN '{host}{path}'"
        verdict += f" WHEN {fits} THEN '{what}'"
    return f"CASE{rule} END", f"CASE{verdict} END"


def url_rules(rules, support: float, confidence: float) -> str:
    """Every combination of up to three tokens of a labelled url is counted."""
    rule, verdict = _listed(rules)
    return rf"""
WITH a AS (
  SELECT row_number() OVER () AS id, page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (
  SELECT id, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(raw) + 1) AS after
  FROM b),
e AS (SELECT *, regexp_extract(after, '^[^?#]*') AS path FROM c),
f AS (
  SELECT *, {rule} AS rule, {verdict} AS listed,
    regexp_extract(substr(after, length(path) + 1), '^\?([^#]*)', 1) AS asked
  FROM e),
g AS (
  SELECT id, 'h:' || unnest(string_split(host, '.')) AS token FROM f
  UNION SELECT id, 'p:' || unnest(string_split(path, '/')) FROM f
  UNION SELECT id, 'q:' || regexp_extract(unnest(string_split(asked, '&')), '^[^=]*') FROM f),
k AS (SELECT * FROM g WHERE length(token) > 2),
m AS (
  SELECT id, coalesce(listed = 'block', quality = 0) AS block
  FROM f LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) AS l
    ON l.doc_id = page_id
  WHERE listed IS NOT NULL OR quality IS NOT NULL),
n AS (
  SELECT ceil(CAST({support} AS DOUBLE) * count(*)) AS least FROM m
  WHERE block OR id IN (SELECT id FROM k)),
x AS (
  SELECT m.id, m.block, token AS t1, '' AS t2, '' AS t3 FROM m JOIN k USING (id)
  UNION ALL
  SELECT m.id, m.block, k.token, k2.token, '' FROM m JOIN k USING (id) JOIN k AS k2 ON k2.id = m.id AND k.token < k2.token
  UNION ALL
  SELECT m.id, m.block, k.token, k2.token, k3.token FROM m JOIN k USING (id)
    JOIN k AS k2 ON k2.id = m.id AND k.token < k2.token JOIN k AS k3 ON k3.id = m.id AND k2.token < k3.token),
y AS (
  SELECT t1, t2, t3 FROM x GROUP BY t1, t2, t3
  HAVING count(*) FILTER (block) >= (SELECT least FROM n)
    AND count(*) FILTER (block) / CAST(count(*) AS DOUBLE) >= {confidence}),
z AS (
  SELECT DISTINCT k.id FROM k JOIN y ON y.t1 = k.token
  WHERE (y.t2 = '' OR EXISTS (SELECT 1 FROM k AS o WHERE o.id = k.id AND o.token = y.t2))
    AND (y.t3 = '' OR EXISTS (SELECT 1 FROM k AS o WHERE o.id = k.id AND o.token = y.t3)))
SELECT page_id, host, path, rule,
  coalesce(listed, CASE WHEN id IN (SELECT id FROM z) THEN 'block' ELSE 'allow' END) AS verdict
FROM f
"""


def secrets(patterns: dict[str, str], value: str, alphabets: dict[int, str], lengths, rate: float, step: float, steps: int) -> str:
    """The scan in SQL: matches are fenced with a character and placed by the lengths before them."""

    def quoted(pattern: str) -> str:
        return pattern.replace("'", "''")

    matches = "\n  UNION ALL ".join(
        f"""SELECT id, {k} AS kind, string_split(regexp_replace(t, '({quoted(patterns[name])})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM d"""
        for k, name in enumerate(("assign", "access", "hex", "random"))
    )
    tables = ", ".join(f"({c}, '{a}', {len(a)})" for c, a in alphabets.items())
    halves = "repeat('0', CAST(k // 2 AS INTEGER)) || repeat('1', CAST(k - k // 2 AS INTEGER))"
    classes = " + ".join(f"(e - s >= {x})::INT" for x in lengths)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
p AS ({matches}),
m AS (
  SELECT id, kind, p[i] AS m, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s,
    list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT AS e
  FROM (SELECT id, kind, p, unnest(range(2, len(p) + 1, 2)) AS i FROM p)),
b AS (
  SELECT id, kind, s, e FROM m WHERE kind = 2 OR (kind = 1 AND e - s >= 20)
    OR (kind = 0 AND length(regexp_extract(m, '{quoted(value)}', 1)) >= 6)),
c AS (
  SELECT id, s, e, m, {classes} - 1 AS class,
    CASE WHEN regexp_matches(m, '^[0-9a-f]+$|^[0-9A-F]+$') AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-fA-F]') THEN 1
      WHEN regexp_matches(m, '^[A-Z2-7]+$') AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') THEN 2
      WHEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') THEN 3 END AS code
  FROM m WHERE kind = 3),
y AS (
  SELECT id, s, e, code, class, alphabet, k::DOUBLE AS k,
    CASE WHEN code = 1 THEN lower(w) ELSE translate(w, '-_', '+/') END AS sym
  FROM (SELECT *, regexp_replace(m, '^=+|=+$', '', 'g') AS w FROM c)
  JOIN (VALUES {tables}) AS v(which, alphabet, k) ON which = code),
h AS (
  SELECT *, length(sym)::DOUBLE AS n, translate(sym, alphabet, {halves}) AS half,
    list_sum(list_transform(string_split(alphabet, ''), lambda x: (length(sym) - length(replace(sym, x, '')))::DOUBLE ** 2)) AS squares,
    list_transform(string_split(sym, ''), lambda x: strpos(alphabet, x) - (k + 1) / 2) AS off
  FROM y),
r AS (
  SELECT *, length(replace(half, '0', ''))::DOUBLE AS ones,
    1 + (length(half) - length(replace(half, '01', ''))) // 2 + (length(half) - length(replace(half, '10', ''))) // 2 AS turns
  FROM h),
z AS (
  SELECT *, 1 + 2 * ones * (n - ones) / n AS mean FROM r),
q AS (
  SELECT *, (mean - 1) * (mean - 2) / (n - 1) AS spread FROM z),
t AS (
  SELECT id, s, e, code, class, unnest([
      [1, (((squares * k / n - n) / (k - 1)) ** (1 / 3::DOUBLE) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1)))],
      [2, CASE WHEN spread > 0 THEN abs(turns - mean) / sqrt(spread) END],
      [2, abs(list_sum(list_transform(range(1, len(off)), lambda i: off[i] * off[i + 1])) / (sqrt(n - 1) * ((k * k - 1) / 12)))]]) AS test
  FROM q),
a AS (
  SELECT *, test[1] AS sides, test[2] AS z, abs(test[2]) / sqrt(2) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(test[2]) / sqrt(2)) AS u FROM t),
f AS (
  SELECT *, 0.5::DOUBLE * (u * (0.254829592::DOUBLE + u * (-0.284496736::DOUBLE + u * (1.421413741::DOUBLE
    + u * (-1.453152027::DOUBLE + u * 1.061405429::DOUBLE))))) * exp(-x * x) AS half FROM a),
g AS (
  SELECT id, s, e, code, class,
    least(1, 3 * min(CASE WHEN z IS NULL THEN 0 ELSE sides * CASE WHEN z >= 0 THEN half ELSE 1 - half END END)) AS p
  FROM f GROUP BY id, s, e, code, class),
o AS (
  SELECT *, least({steps}, floor(-log10(greatest(p, 1e-300::DOUBLE)) / {step}::DOUBLE))::INT AS step FROM g),
w AS (
  SELECT code, class, step, sum(n) OVER (PARTITION BY code, class ORDER BY step DESC) AS seen, sum(n) OVER (PARTITION BY code, class) AS m
  FROM (SELECT code, class, step, count(*) AS n FROM o GROUP BY code, class, step)),
l AS (
  SELECT code, class, min(step) AS low FROM w
  WHERE 10::DOUBLE ** (-step * {step}::DOUBLE) <= {rate}::DOUBLE * seen / m GROUP BY code, class),
x AS (
  SELECT id, 3 AS kind, s, e FROM o LEFT JOIN l USING (code, class)
  WHERE step < coalesce(low, {steps} + 1) AND NOT EXISTS (SELECT 1 FROM b WHERE b.id = o.id AND b.s < o.e AND o.s < b.e)),
j AS (SELECT * FROM b UNION ALL SELECT * FROM x),
k AS (
  SELECT id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex', 'random'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base,
    string_agg(['assign', 'access', 'hex', 'random'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS spans
  FROM j GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN k USING (id)
"""


def _leaf(text: str) -> str:
    """Digest of the columns of a document in SQL, with ``text`` for its text."""
    parts = []
    for c in ("doc_id", "source", "lang", "n_chars", text):
        v = f"CAST({c} AS VARCHAR)"
        parts.append(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END")
    return f"sha256({' || '.join(parts)})"


#: crc32 is not a function of the dialect: it is folded over the digits of the id.
MANIFEST = rf"""
WITH RECURSIVE
t AS (
  SELECT range AS byte, list_reduce(list_prepend(range, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS crc
  FROM range(256)),
tab AS (SELECT list(crc ORDER BY byte) AS crcs FROM t),
d AS (
  SELECT row_number() OVER () AS id, doc_id, source, {_leaf("text")} AS leaf,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: xor(c // 256, crcs[xor(c, b) % 256 + 1])), 4294967295) AS crc,
    {_leaf(r"replace(text, chr(10), '')")} AS bare
  FROM documents, tab),
e AS (
  SELECT id, doc_id, leaf, CASE WHEN crc % 2 = 0 THEN bare ELSE leaf END AS claim,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n
  FROM d),
up(level, tree, pos, n, digest) AS (
  SELECT 0, tree, pos, n, leaf FROM e
  UNION ALL
  SELECT level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY level, tree, pos // 3, n),
sub AS (SELECT tree, level AS height, digest FROM up WHERE n = 1),
top(level, tree, pos, n, digest) AS (
  SELECT 0, -1::BIGINT, tree, (SELECT count(*) FROM sub), digest FROM sub
  UNION ALL
  SELECT level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY level, tree, pos // 3, n),
runs AS (
  SELECT tree, level, pos // 3 AS run, list(digest ORDER BY pos) AS digests
  FROM (SELECT * FROM up UNION ALL SELECT * FROM top) WHERE n > 1 GROUP BY tree, level, pos // 3),
steps AS (
  SELECT e.id, r.level AS step, e.pos // (3 ** r.level)::BIGINT % 3 AS slot, digests
  FROM e JOIN (SELECT DISTINCT tree, level FROM runs) AS l ON l.tree = e.tree
  JOIN runs AS r ON r.tree = e.tree AND r.level = l.level AND r.run = e.pos // (3 ** (l.level + 1))::BIGINT
  UNION ALL
  SELECT e.id, s.height + r.level, e.tree // (3 ** r.level)::BIGINT % 3, digests
  FROM e JOIN sub AS s ON s.tree = e.tree CROSS JOIN (SELECT DISTINCT level FROM runs WHERE tree = -1) AS l
  JOIN runs AS r ON r.tree = -1 AND r.level = l.level AND r.run = e.tree // (3 ** (l.level + 1))::BIGINT),
fold(id, step, digest) AS (
  SELECT id, 0, claim FROM e
  UNION ALL
  SELECT f.id, f.step + 1, sha256(array_to_string(list_transform(digests, lambda x, i: CASE WHEN i = slot + 1 THEN f.digest ELSE x END), ''))
  FROM fold AS f JOIN steps AS s ON s.id = f.id AND s.step = f.step),
ends AS (SELECT id, arg_max(digest, step) AS folded_root FROM fold GROUP BY id),
proofs AS (
  SELECT id, sha256(string_agg(array_to_string(list_filter(digests, lambda x, i: i <> slot + 1), ''), '' ORDER BY step)) AS proof_sha256
  FROM steps GROUP BY id)
SELECT doc_id, leaf, sub.digest AS subroot, r.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
  folded_root = r.digest AS verified
FROM e JOIN sub USING (tree) JOIN ends USING (id) LEFT JOIN proofs USING (id) CROSS JOIN (SELECT digest FROM top WHERE n = 1) AS r
"""


RANKED = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
i AS (
  SELECT item, item_id, unnest(list_distinct(terms)) AS term
  FROM (SELECT row_number() OVER () AS item, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark)),
c AS (SELECT count(*) FILTER (len(terms) > 0) AS n, CAST(sum(len(terms)) AS BIGINT) AS total FROM d),
o AS (
  SELECT id, doc_id, size, term, count(*) AS tf
  FROM (SELECT id, doc_id, len(terms) AS size, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM o, c GROUP BY term, n),
s AS (
  SELECT item, item_id, id, doc_id,
    CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * size * n) // total)))) AS BIGINT) AS score
  FROM i JOIN o USING (term) JOIN w USING (term), c GROUP BY item, item_id, id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
