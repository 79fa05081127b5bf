import pytest

from ferrule.operators import summary as SU


def _scored(spark, rows):
    return spark.createDataFrame(rows, "uid long, ts timestamp, p double, machine_failure_pred int, "
                                 "most_likely_type string")


def test_batch_summary_empty(spark):
    r = SU.batch_summary(_scored(spark, [])).first()
    assert r["total_machines"] == 0 and r["failure_count"] == 0
    assert r["failure_rate"] == 0.0 and r["average_failure_probability"] == 0.0
    assert r["most_common_failure_type"] is None


def test_batch_summary_tie_first_seen(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    rows = [(5, t, 0.9, 1, "OSF"), (2, t, 0.8, 1, "TWF"), (7, t, 0.7, 1, "TWF"), (1, t, 0.6, 1, "OSF"),
            (3, t, 0.1, 0, "HDF")]
    r = SU.batch_summary(_scored(spark, rows)).first()
    assert r["total_machines"] == 5 and r["failure_count"] == 4
    assert r["failure_rate"] == pytest.approx(0.8)
    assert r["most_common_failure_type"] == "OSF"  # 2 vs 2, OSF seen first (uid 1)


def test_monitor_keeps_last_n(spark):
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), 0.9 if i >= 1100 else 0.1,
             1 if i >= 1100 else 0, "TWF") for i in range(1200)]
    r = SU.monitor_stats(_scored(spark, rows)).first()
    assert r["total_predictions"] == 1000 and r["failure_predictions"] == 100
    assert r["failure_rate"] == pytest.approx(0.1) and r["recent_failure_rate"] == 1.0
    assert r["failure_rate_band"] == "low"


def test_result_table_formatting(spark):
    df = spark.createDataFrame(
        [(1, "L", 300.25, 310.0, 1503.0, 42.75, 189.0, 0.4567, 0, "TWF")],
        "uid long, type string, air_temp_k double, process_temp_k double, rpm double, torque_nm double, "
        "tool_wear_min double, p double, machine_failure_pred int, most_likely_type string")
    r = SU.result_table(df).first()
    # exact ties round to even, like Python's format
    assert (r["air_temp"], r["torque"], r["speed"]) == (f"{300.25:.1f}", f"{42.75:.1f}", "1503")
    assert r["probability"] == f"{0.4567 * 100:.1f}%" and r["most_likely_failure"] == "N/A"


def test_dense_row_number(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(100)], "k long")
    out = SU.dense_row_number(df, "k").orderBy("k").collect()
    assert [r["row_no"] for r in out] == list(range(1, 101))
