"""Sensor readings derived from the driver's ``events`` table.

The test tables carry no machine sensor table, so readings are a fixed,
deterministic projection of ``events``: one reading per event, machine =
user.  The same expressions run in Spark (``selectExpr``) and in DuckDB (the
oracle SQL), so both engines see bit-identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed projection (shared with the DuckDB oracle): (expression, alias).
READING_EXPRS: list[tuple[str, str]] = [
    ("event_id", "uid"),
    ("user_id", "machine_id"),
    ("ts", "ts"),
    (
        "CASE WHEN user_id % 10 < 5 THEN 'L' WHEN user_id % 10 < 8 THEN 'M' ELSE 'H' END",
        "type",
    ),
    ("CAST(295 AS DOUBLE) + (event_id * 7919 % 1000) / CAST(100 AS DOUBLE)", "air_temp_k"),
    ("CAST(305 AS DOUBLE) + (event_id * 6007 % 1000) / CAST(100 AS DOUBLE)", "process_temp_k"),
    ("CAST(1250 + (user_id * 37 + event_id * 31) % 500 AS DOUBLE)", "rpm"),
    ("ROUND(CAST(20 AS DOUBLE) + value % CAST(50 AS DOUBLE), 2)", "torque_nm"),
    ("(event_id * 1237 % 2500) / CAST(10 AS DOUBLE)", "tool_wear_min"),
    ("CASE WHEN event_id % 1000 = 7 THEN 1 ELSE 0 END", "rnf_flag"),
]

# Raw (string-typed) request rows with the defects a real feed has: a missing
# torque for error events with out-of-range values, an unparsable speed for
# some signup events and an unknown machine type for some purchase events.
RAW_EXPRS: list[tuple[str, str]] = [
    ("event_id", "uid"),
    ("user_id", "machine_id"),
    (
        "CASE WHEN event_type = 'purchase' AND user_id % 7 = 0 THEN 'X' "
        "WHEN user_id % 10 < 5 THEN 'L' WHEN user_id % 10 < 8 THEN 'M' ELSE 'H' END",
        "machine_type",
    ),
    ("CAST(CAST(295 AS DOUBLE) + (event_id * 7919 % 1000) / CAST(100 AS DOUBLE) AS VARCHAR(32))", "air_temperature"),
    ("CAST(CAST(305 AS DOUBLE) + (event_id * 6007 % 1000) / CAST(100 AS DOUBLE) AS VARCHAR(32))", "process_temperature"),
    (
        "CASE WHEN event_type = 'signup' AND value > 300 THEN 'n/a' "
        "ELSE CAST(1250 + (user_id * 37 + event_id * 31) % 500 AS VARCHAR(32)) END",
        "rotational_speed",
    ),
    (
        "CASE WHEN event_type = 'error' AND value > 250 THEN NULL "
        "ELSE CAST(ROUND(CAST(20 AS DOUBLE) + value % CAST(50 AS DOUBLE), 2) AS VARCHAR(32)) END",
        "torque",
    ),
    ("CAST((event_id * 1237 % 2500) / CAST(10 AS DOUBLE) AS VARCHAR(32))", "tool_wear"),
]


def _select_sql(exprs: list[tuple[str, str]], source: str) -> str:
    cols = ",\n       ".join(f"{e} AS {a}" for e, a in exprs)
    return f"SELECT {cols}\nFROM {source}"


READINGS_SQL = _select_sql(READING_EXPRS, "events")
RAW_READINGS_SQL = _select_sql(RAW_EXPRS, "events")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readings_from_events(events: DataFrame) -> DataFrame:
    """Project ``events`` to the sensor-reading schema (narrow, codegen)."""
    return events.selectExpr(*[f"{e} AS {a}" for e, a in READING_EXPRS])


def machine_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_events(read_table(spark, sf_dir, "events"))


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return events.selectExpr(*[f"{e} AS {a}" for e, a in RAW_EXPRS])
