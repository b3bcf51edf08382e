"""All registered queries run; those with SQL match DuckDB."""

import os

import pytest

from trialmill.plans.registry import ORACLE_SQL, QUERIES

DIR = os.environ.get("TRIALMILL_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v) + 0.0:.10g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


def test_the_shuffle_keeps_all_rows(spark, duck):
    assert QUERIES["o09_seeded_shuffle"](spark, DIR).count() == duck.execute("SELECT count(*) FROM events").fetchone()[0]


def test_sources_of_truth_agree():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["u03_intersect_except", "u06_partition_test"])
def test_sets_meet_without_their_repeats(spark, name):
    assert "Join" not in QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()


def test_a_stream_lands_in_more_files_as_it_grows(spark, monkeypatch):
    from trialmill.plans import q_stream

    monkeypatch.setattr(q_stream, "FILE_ROWS", 100)
    rows = spark.range(1000)
    dealt, each = q_stream._dealt(rows)
    assert each == 4 and dealt.rdd.getNumPartitions() == 12 and dealt.count() == 1000
    assert q_stream._dealt(spark.range(5))[1] == 1
