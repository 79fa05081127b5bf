"""Registered queries: data quality options (C1, C2, C5), drift and
performance monitoring (C6, C7), time-based aggregates (W1, W2)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.functions import features as FE
from ferrule.operators import monitor as MO
from ferrule.operators import quality as Q
from ferrule.operators import sketch as SK
from ferrule.operators.scoring import evaluation_frame
from ferrule.plans.sqltext import RAW_CTE, with_base
from ferrule.session import scratch_path
from ferrule.sources import io
from ferrule.sources.readings import machine_readings, raw_readings


def minmax_scaled(spark, sf_dir):
    df = machine_readings(spark, sf_dir)
    return Q.minmax_scale(df, S.SENSORS).select(S.UID, *[f"{c}_mm" for c in S.SENSORS])


def _minmax_sql() -> str:
    cols = ",\n       ".join(
        f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}_mm" for c in S.SENSORS
    )
    return with_base(f"SELECT uid,\n       {cols}\nFROM r")


def imputed(spark, sf_dir):
    """C2 on the raw feed: torque by mean, speed by exact median."""
    checked = Q.validate_requests(raw_readings(spark, sf_dir))
    df = Q.impute(checked, [S.TORQUE], "mean")
    df = Q.impute(df, [S.RPM], "median")
    return df.select(S.UID, F.round(S.TORQUE, 6).alias(S.TORQUE), F.round(S.RPM, 6).alias(S.RPM), "status")


IMPUTED_SQL = f"""WITH {RAW_CTE},
c AS (
SELECT uid, machine_type, TRY_CAST(torque AS DOUBLE) AS torque_nm, TRY_CAST(rotational_speed AS DOUBLE) AS rpm,
       torque IS NULL AS missing,
       rotational_speed IS NOT NULL AND TRY_CAST(rotational_speed AS DOUBLE) IS NULL AS bad_cast
FROM raw
)
SELECT uid,
       round(coalesce(torque_nm, avg(torque_nm) OVER ()), 6) AS torque_nm,
       round(coalesce(rpm, quantile_cont(rpm, 0.5) OVER ()), 6) AS rpm,
       CASE WHEN missing THEN 'missing_value' WHEN bad_cast THEN 'not_a_number'
            WHEN machine_type IS NULL OR machine_type NOT IN ('L', 'M', 'H') THEN 'unknown_type'
            ELSE 'valid' END AS status
FROM c"""

CLIP_COLS = [S.TORQUE, S.RPM, "tool_wear_torque", "power_w"]


def outliers_clipped(spark, sf_dir):
    df = FE.with_columns(machine_readings(spark, sf_dir), FE.domain_columns())
    out = Q.clip_outliers(df, CLIP_COLS)
    return out.select(S.UID, *[F.round(c, 6).alias(c) for c in CLIP_COLS])


def _clip_sql() -> str:
    src = {
        S.TORQUE: S.TORQUE,
        S.RPM: S.RPM,
        "tool_wear_torque": "tool_wear_min * torque_nm",
        "power_w": "rpm * torque_nm * (2 * pi() / 60)",
    }
    inner = ", ".join(f"{e} AS {c}" for c, e in src.items())
    q = ",\n       ".join(
        f"quantile_cont({c}, 0.25) OVER () AS {c}_q1, quantile_cont({c}, 0.75) OVER () AS {c}_q3" for c in CLIP_COLS
    )
    out = ",\n       ".join(
        f"round(least(greatest({c}, {c}_q1 - 1.5 * ({c}_q3 - {c}_q1)), {c}_q3 + 1.5 * ({c}_q3 - {c}_q1)), 6) AS {c}"
        for c in CLIP_COLS
    )
    return with_base(
        f""", v AS (SELECT uid, {inner} FROM r),
qq AS (SELECT *,
       {q}
FROM v)
SELECT uid,
       {out}
FROM qq"""
    )


DRIFT_COLS = S.SENSORS


def drift_psi(spark, sf_dir):
    return MO.drift_psi(machine_readings(spark, sf_dir), DRIFT_COLS)


def _drift_sql() -> str:
    stacked = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, "
        f"CASE WHEN epoch_us(ts) < (SELECT mid FROM m) THEN 'reference' ELSE 'current' END AS period FROM r"
        for c in DRIFT_COLS
    )
    return with_base(
        f""", m AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) / 2 AS mid FROM r),
st AS ({stacked}),
rg AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM st WHERE period = 'reference' GROUP BY feature),
b AS (
SELECT st.feature, period,
       CAST(CASE WHEN hi - lo = 0 THEN 0 ELSE least(greatest(floor((value - lo) / (hi - lo) * 10), 0), 9) END AS INT) AS bin
FROM st JOIN rg USING (feature)
),
cnt AS (
SELECT feature, bin, sum(CASE WHEN period = 'reference' THEN 1 ELSE 0 END) AS n_ref,
       sum(CASE WHEN period = 'current' THEN 1 ELSE 0 END) AS n_cur
FROM b GROUP BY feature, bin
),
sh AS (
SELECT feature, greatest(n_ref / sum(n_ref) OVER (PARTITION BY feature), 0.0001) AS r,
       greatest(n_cur / sum(n_cur) OVER (PARTITION BY feature), 0.0001) AS c
FROM cnt
),
p AS (SELECT feature, round(sum((c - r) * ln(c / r)), 6) AS psi FROM sh GROUP BY feature)
SELECT feature, psi,
       CASE WHEN psi > 0.2 THEN 'significant' WHEN psi > 0.1 THEN 'moderate' ELSE 'none' END AS drift
FROM p"""
    )


QUANTILES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def _stored_sketches(spark, sf_dir) -> tuple[DataFrame, dt.date]:
    """The sensors' sketches by day, written and read again, and the day in the
    middle of theirs."""
    path = scratch_path(spark, f"sketches-{uuid.uuid4().hex}")
    io.write_table(SK.value_sketches(machine_readings(spark, sf_dir), DRIFT_COLS), path)
    stored = spark.read.parquet(path)
    middle = F.date_add(F.min("day"), F.floor(F.datediff(F.max("day"), F.min("day")) / 2).cast("int"))
    return stored, stored.agg(middle.alias("d")).first()["d"]


def sketch_drift(spark, sf_dir):
    """C6 of the later days against the earlier, from stored sketches."""
    return SK.sketch_psi(*_stored_sketches(spark, sf_dir))


def sketch_quantiles(spark, sf_dir):
    """Quantiles of the later days, from stored sketches."""
    stored, middle = _stored_sketches(spark, sf_dir)
    return SK.quantiles(SK.merged(stored, first=middle), QUANTILES)


_SKETCH_CTES = (", st AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(ts AS DATE) AS day, CAST({c} AS DOUBLE) AS value FROM r" for c in DRIFT_COLS) + f"""),
k AS (
SELECT feature, day, value, CASE WHEN value < 0 THEN -1 ELSE 1 END * CASE WHEN abs(value) >= CAST({SK.LEAST!r} AS DOUBLE) THEN
         greatest(CAST(ceil(ln(greatest(abs(value), CAST({SK.LEAST!r} AS DOUBLE))) / CAST({SK.log_growth()!r} AS DOUBLE)) AS BIGINT) - {SK.first_bucket() - 1}, 1)
       ELSE 0 END AS bucket
FROM st
),
m AS (SELECT min(day) + CAST((max(day) - min(day)) // 2 AS INTEGER) AS middle FROM k)""")

SKETCH_QUANTILES_SQL = with_base(_SKETCH_CTES + f""",
sk AS (SELECT feature, bucket, count(*) AS n, min(value) AS lo, max(value) AS hi FROM k, m WHERE day >= middle GROUP BY ALL),
cum AS (SELECT *, CAST(sum(n) OVER (PARTITION BY feature ORDER BY bucket) AS BIGINT) AS upto,
               CAST(sum(n) OVER (PARTITION BY feature) AS BIGINT) AS total FROM sk),
p AS (SELECT CAST(unnest({QUANTILES}) AS DOUBLE) AS q)
SELECT feature, q, total AS n, lo AS low, hi AS high FROM cum, p
WHERE greatest(ceil(q * total), 1) <= upto AND greatest(ceil(q * total), 1) > upto - n""")


def _sketch_drift_sql(bins: int = 10, floor: str = "CAST(0.0001 AS DOUBLE)") -> str:
    place = lambda x: f"CAST(CASE WHEN hi0 = lo0 THEN 0 ELSE least(greatest(floor(({x} - lo0) / (hi0 - lo0) * {bins}), 0), {bins - 1}) END AS INT)"
    share = lambda side, total, cond: f"greatest(sum(CASE WHEN {side} AND {cond} THEN n ELSE 0 END) / max({total}), {floor})"
    shares = ", ".join(
        f"{share(side, total, cond)} AS {p}{k}" for side, total, p in (("early", "n_ref", "r"), ("NOT early", "n_cur", "c"))
        for k, cond in (("", "mid = bin"), ("0", "a = b"), ("1", "true")))
    gap = lambda r, c: f"({c} - {r}) * ln({c} / {r})"
    corners = ", ".join(gap(r, c) for r in ("r0", "r1") for c in ("c0", "c1"))
    return with_base(_SKETCH_CTES + f""",
sk AS (SELECT feature, day < middle AS early, bucket, count(*) AS n, min(value) AS lo, max(value) AS hi FROM k, m GROUP BY ALL),
w AS (SELECT feature, min(lo) FILTER (early) AS lo0, max(hi) FILTER (early) AS hi0, sum(n) FILTER (early) AS n_ref, sum(n) FILTER (NOT early) AS n_cur
      FROM sk GROUP BY feature),
pl AS (SELECT feature, early, n, n_ref, n_cur, {place('lo')} AS a, {place('hi')} AS b, {place('(lo + hi) / 2')} AS mid FROM sk JOIN w USING (feature)),
ex AS (SELECT *, unnest(range(a, b + 1)) AS bin FROM pl),
sh AS (SELECT feature, bin, {shares} FROM ex GROUP BY feature, bin),
o AS (
SELECT feature, round(sum({gap('r', 'c')}), 6) AS psi,
       round(sum(CASE WHEN c0 > r1 THEN {gap('r1', 'c0')} WHEN r0 > c1 THEN {gap('r0', 'c1')} ELSE 0 END), 6) AS psi_low,
       round(sum(greatest({corners})), 6) AS psi_high
FROM sh GROUP BY feature
)
SELECT *, CASE WHEN psi > 0.2 THEN 'significant' WHEN psi > 0.1 THEN 'moderate' ELSE 'none' END AS drift FROM o""")


def performance_alert(spark, sf_dir):
    return MO.performance_alert(evaluation_frame(machine_readings(spark, sf_dir)))


PERFORMANCE_ALERT_SQL = with_base(
    """, d AS (
SELECT CAST(ts AS DATE) AS d, count(*) AS n_readings, sum(CASE WHEN y = pred THEN 1 ELSE 0 END) AS n_correct
FROM e GROUP BY 1
),
b AS (
SELECT sum(n_correct) / sum(n_readings) AS base FROM d WHERE d < (SELECT min(d) FROM d) + INTERVAL 7 DAY
)
SELECT strftime(d, '%Y-%m-%d') AS day, n_readings,
       round(n_correct / n_readings, 6) AS accuracy, round(base, 6) AS base_accuracy,
       CASE WHEN n_correct / n_readings < base * (1 - 0.1) THEN 1 ELSE 0 END AS alert
FROM d, b"""
)

LOOKBACK_S = 6 * 3600


def rolling_machine_features(spark, sf_dir):
    ev = evaluation_frame(machine_readings(spark, sf_dir))
    out = MO.rolling_per_machine(
        ev,
        LOOKBACK_S,
        {
            "n_6h": (F.count, F.lit(1)),
            "failures_6h": (F.sum, F.col("y").cast("long")),
            "_avg_torque": (F.avg, F.col(S.TORQUE)),
            "max_wear_6h": (F.max, F.col(S.WEAR)),
        },
    )
    return out.select(
        S.UID, S.MACHINE_ID, "n_6h", "failures_6h",
        F.round("_avg_torque", 6).alias("avg_torque_6h"), "max_wear_6h",
    )


ROLLING_SQL = with_base(
    f"""SELECT uid, machine_id,
       count(*) OVER w AS n_6h,
       CAST(sum(y) OVER w AS BIGINT) AS failures_6h,
       round(avg(torque_nm) OVER w, 6) AS avg_torque_6h,
       max(tool_wear_min) OVER w AS max_wear_6h
FROM e
WINDOW w AS (PARTITION BY machine_id ORDER BY epoch_us(ts) RANGE BETWEEN {LOOKBACK_S * 1_000_000} PRECEDING AND CURRENT ROW)"""
)


def daily_trend(spark, sf_dir):
    return MO.daily_trend(evaluation_frame(machine_readings(spark, sf_dir)))


DAILY_TREND_SQL = with_base(
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_readings,
       CAST(sum(y) AS BIGINT) AS n_failures, CAST(sum(pred) AS BIGINT) AS n_predicted,
       round(avg(p), 6) AS avg_p, round(avg(y), 6) AS failure_rate
FROM e GROUP BY 1"""
)


QUERIES = {
    "minmax_scaled": (minmax_scaled, _minmax_sql()),
    "imputed": (imputed, IMPUTED_SQL),
    "outliers_clipped": (outliers_clipped, _clip_sql()),
    "drift_psi": (drift_psi, _drift_sql()),
    "sketch_drift": (sketch_drift, _sketch_drift_sql()),
    "sketch_quantiles": (sketch_quantiles, SKETCH_QUANTILES_SQL),
    "performance_alert": (performance_alert, PERFORMANCE_ALERT_SQL),
    "rolling_machine_features": (rolling_machine_features, ROLLING_SQL),
    "daily_trend": (daily_trend, DAILY_TREND_SQL),
}
