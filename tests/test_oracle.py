"""Registered queries against their SQL twins on the smallest tables.

All of them run with MARGINALIA_ORACLE=all; otherwise a selection does.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "curated_splits", "sense_quarantine", "cap_strata", "quota_sample", "strict_test", "expand_batches", "batch_members",
    "parse_corrections", "validate_rows", "convert_corpus", "correction_scores", "reliability_bins", "uniform_thresholds",
    "cache_lookup", "group_advantage", "bench_statistics", "pareto_frontier", "stream_latest_state",
]
from marginalia.plans import catalog

ORACLE = catalog.ORACLE
NAMES = sorted(ORACLE) if os.environ.get("MARGINALIA_ORACLE") == "all" else SOME


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return v


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    cursor = con.execute(ORACLE[name])
    cols = [c[0] for c in cursor.description]
    want = [dict(zip(cols, row)) for row in cursor.fetchall()]
    df = entry_points.queries()[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(cols)
    names = sorted(cols)

    def key(rows):
        return sorted((tuple(cell(r[c]) for c in names) for r in rows), key=repr)

    assert key(r.asDict() for r in df.collect()) == key(want)


def test_every_query_is_registered_with_a_callable():
    every = entry_points.queries()
    assert set(entry_points.oracle_sql()) <= set(every) and all(callable(q) for q in every.values())
    queries = catalog.QUERIES
    assert set(queries) - set(ORACLE) == {"rewrite_scores", "score_report"}
