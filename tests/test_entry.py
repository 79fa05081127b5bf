import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3
    assert {r["type"] for r in rows} == {"L", "M", "H"}


def test_oracles_cover_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_small_queries_run(spark):
    q = E.queries()
    for name in ["failure_rules", "batch_summary", "roc_auc", "hash_split", "daily_trend"]:
        assert q[name](spark, "/root/testdata/sf0.001").count() > 0


def test_queries_are_listed_without_a_session():
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 77 and len(e.oracle_sql()) >= 69"
    subprocess.run([sys.executable, "-c", code], cwd=repo, check=True)
