import json

import pytest
from pyspark.sql import functions as F

from ferrule.operators import scoring as SC
from ferrule.operators import summary as SU
from ferrule.sources import io


def test_csv_round_trip_dataset_names(spark, tmp_path, sensor_rows):
    back = {"uid": "UID", "type": "Type", "air_temp_k": "Air temperature [K]",
            "process_temp_k": "Process temperature [K]", "rpm": "Rotational speed [rpm]",
            "torque_nm": "Torque [Nm]", "tool_wear_min": "Tool wear [min]"}
    out = sensor_rows.select(F.col("uid").alias("UID"), F.lit("L47181").alias("Product ID"),
                             *[F.col(k).alias(v) for k, v in back.items() if k != "uid"])
    io.write_table(out, str(tmp_path / "csv"), fmt="csv")
    df = io.read_sensor_csv(spark, str(tmp_path / "csv"))
    assert set(df.columns) >= {"uid", "type", "air_temp_k", "tool_wear_min"}
    assert df.count() == 5 and df.schema["rpm"].dataType.typeName() == "double"


def test_batch_request_and_response(spark, tmp_path):
    body = {"machines": [
        {"air_temperature": 298.5, "process_temperature": 308.7, "rotational_speed": 1503,
         "torque": 42.8, "tool_wear": 189.2, "machine_type": "M"},
        {"air_temperature": 300.0, "process_temperature": 305.0, "rotational_speed": 1300,
         "torque": 60.0, "tool_wear": 240.0, "machine_type": "L"},
    ]}
    path = tmp_path / "req.json"
    path.write_text(json.dumps(body))
    rows = io.read_batch_request(spark, str(path)).withColumnRenamed("position", "uid")
    assert rows.count() == 2 and "tool_wear_min" in rows.columns
    scored = SC.score(rows.withColumn("p", F.lit(0.4)), ts_col=None)
    preds, summary = io.batch_response(scored, SU.batch_summary(scored))
    doc = json.loads(preds.orderBy("uid").first()["prediction"])
    assert doc["failure_probability"] == 0.4 and set(doc["failure_type"]) == {"TWF", "HDF", "PWF", "OSF", "RNF"}
    s = json.loads(summary.first()["summary"])
    assert s["total_machines"] == 2 and s["failure_count"] == 0


def test_dead_letters_on_any_layout(spark, tmp_path):
    good = {"uid": "7", "air_temperature": 298.5, "process_temperature": 308.7, "rotational_speed": 1503, "torque": 42.8, "tool_wear": 0, "machine_type": "M"}
    docs = [json.dumps({"machines": [{**good, "uid": str(k)}, {**good, "torque": None}, {**good, "rotational_speed": "fast"}, {**good, "machine_type": "X"}, None]}) for k in range(20)]
    docs += [docs[0], "", "  ", docs[1][:-3], "nonsense", "[1, 2]", json.dumps({"machines": []}), json.dumps({"other": 1}), json.dumps({"machines": None})]
    seen = []
    for files in (1, 8):
        folder = tmp_path / str(files)
        folder.mkdir()
        for f in range(files):
            (folder / f"{f}.json").write_text("".join(d + "\n" for d in docs[f::files]))
        rows, dead = io.read_request_documents(spark, str(folder))
        assert rows.count() == 21 and rows.schema["rpm"].dataType.typeName() == "double"
        reasons = {r["reason"]: r["count"] for r in dead.groupBy("reason").count().collect()}
        assert reasons == {"missing_value": 42, "not_a_number": 21, "unknown_type": 21, "not_json": 3, "no_machines": 3}
        assert all(r["record"] and r["file"].startswith("file:") for r in dead.collect())
        key = lambda d: sorted(str(tuple(r)) for r in d.collect())
        seen.append((key(rows), key(dead.drop("file"))))
    assert seen[0] == seen[1]


def test_bucketed_tables_are_bound_without_a_shuffle(spark, tmp_path):
    left = spark.range(1000).selectExpr("id as uid", "id * 2 as x").repartition(7)
    right = spark.range(500, 1500).selectExpr("id as uid", "id * 3 as y").repartition(3)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    io.write_bucketed(left, a, buckets=6)
    io.write_bucketed(right, b, buckets=6)
    want = sorted(tuple(r) for r in io.bind_features_targets(left, right).collect())
    for session in (spark, spark.newSession()):
        bound = io.bind_bucketed(session, a, b)
        assert sorted(tuple(r) for r in bound.collect()) == want
        plan = bound._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    # registered anew from the files alone
    spark.sql(f"DROP TABLE {io._bucketed_name(a)}")
    assert io.read_bucketed(spark, a)[1:] == ("uid", 6)
    assert io.bind_bucketed(spark, a, b).count() == 500
    # written anew with other rows and buckets
    io.write_bucketed(right.limit(0), b, buckets=4)
    with pytest.raises(ValueError, match="into 4"):
        io.bind_bucketed(spark, a, b)
    left.write.parquet(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="no bucketed table"):
        io.read_bucketed(spark, str(tmp_path / "c"))
