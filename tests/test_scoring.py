import pytest
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.operators import scoring as SC


def _one(spark, p, type_="M", air=298.5, proc=308.7, rpm=1503.0, torque=42.8, wear=189.2, uid=1):
    return spark.createDataFrame(
        [(uid, type_, air, proc, rpm, torque, wear, p)],
        "uid long, type string, air_temp_k double, process_temp_k double, rpm double, torque_nm double, "
        "tool_wear_min double, p double")


def test_attribution_golden(spark):
    """FIXTURES.md §6: the README request with p = 0.4."""
    r = SC.attribute(_one(spark, 0.4)).first()
    assert r["prob_twf"] == pytest.approx(0.240674193, abs=1e-9)
    assert r["prob_hdf"] == pytest.approx(0.063603117, abs=1e-9)
    assert r["prob_pwf"] == pytest.approx(0.031801558, abs=1e-9)
    assert r["prob_osf"] == pytest.approx(0.063603117, abs=1e-9)
    assert r["prob_rnf"] == pytest.approx(0.000318016, abs=1e-9)
    assert r["most_likely_type"] == "TWF"
    assert r["maintenance_recommendation"] == S.RECOMMENDATIONS["TWF"]


def test_sums_to_p_and_bands(spark):
    rows = []
    for i, p in enumerate([0.0, 0.1999, 0.2, 0.4999, 0.5, 0.7, 1.0]):
        rows.append((i, "L", 300.0, 305.0, 1300.0, 60.0, 240.0, p))
    df = spark.createDataFrame(rows, "uid long, type string, air_temp_k double, process_temp_k double, "
                               "rpm double, torque_nm double, tool_wear_min double, p double")
    out = SC.display_bands(SC.attribute(df)).orderBy("uid").collect()
    for r in out:
        s = r["prob_twf"] + r["prob_hdf"] + r["prob_pwf"] + r["prob_osf"] + r["prob_rnf"]
        assert s == pytest.approx(r["p"], abs=1e-12)
    recs = [r["maintenance_recommendation"] for r in out]
    R = S.RECOMMENDATIONS
    assert recs[0] == R["none"] and recs[1] == R["none"]
    assert recs[2] != R["none"] and recs[3] != R["urgent"]
    assert recs[4] == R["urgent"] and recs[6] == R["urgent"]
    assert [r["risk_band"] for r in out] == ["low", "low", "low", "medium", "medium", "high", "high"]
    # p = 0: all zero, first type wins the tie
    assert out[0]["most_likely_type"] == "TWF"
    # strict p > 0.5
    assert [r["machine_failure_pred"] for r in out] == [0, 0, 0, 0, 0, 1, 1]


def test_unknown_type_uses_default_threshold(spark):
    # wear*torque = 12500: above the 12000 default, below H's 13000
    a = SC.attribute(_one(spark, 0.3, "Z", torque=50.0, wear=250.0)).first()
    b = SC.attribute(_one(spark, 0.3, "H", torque=50.0, wear=250.0)).first()
    assert a["prob_osf"] > b["prob_osf"]


def test_ranked_types_inside_row(spark):
    out = SC.ranked_types(SC.attribute(_one(spark, 0.4))).orderBy("rank").collect()
    assert [r["failure_type"] for r in out] == ["TWF", "HDF", "OSF", "PWF", "RNF"]
    probs = [r["prob"] for r in out]
    assert probs == sorted(probs, reverse=True)


def test_score_and_record(spark):
    df = _one(spark, 0.6).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    scored = SC.score(df)
    r = scored.first()
    assert r["machine_failure"] is True and r["failure_type"]["TWF"] > 0
    rec = SC.prediction_record(scored).first()
    assert rec["input"]["uid"] == 1 and rec["output"]["failure_probability"] == 0.6


def test_model_probability_fallback(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.0)], "uid long, prediction double")
    out = {r["uid"]: r["p"] for r in SC.model_probability(df).collect()}
    assert out == {1: 1.0, 2: 0.0}
