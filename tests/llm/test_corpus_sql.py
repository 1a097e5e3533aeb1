"""The operators that SQL can state, against their SQL on the small tables."""

import os

import duckdb
import pytest

SF_DIR = "/root/testdata/sf0.001"
TABLES = "documents pages labels benchmark".split()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["op3_mixing", "op7_secrets", "op10_url_rules", "op11_ranked", "op13_manifest"])
def test_same_rows(spark, name):
    from marginalia.llm.catalog import ORACLE, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    cursor = con.execute(ORACLE[name])
    cols = [c[0] for c in cursor.description]
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(cols)
    want = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == want
