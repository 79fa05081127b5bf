"""SQL text shared by the DuckDB oracle queries.

The oracle queries restate each operator in plain ANSI SQL over the
driver's views; these fragments are the common prefixes (readings, flags,
scores) so each query only writes its own part.
"""

from __future__ import annotations

from ferrule import schema as S
from ferrule.functions.scoring import LINEAR_SCORE_SQL
from ferrule.sources.readings import RAW_READINGS_SQL, READINGS_SQL

POWER_SQL = "(rpm * torque_nm * (2 * pi() / 60))"
OSF_THRESHOLD_SQL = (
    "CASE type WHEN 'L' THEN CAST(11000 AS DOUBLE) WHEN 'M' THEN CAST(12000 AS DOUBLE) "
    "WHEN 'H' THEN CAST(13000 AS DOUBLE) END"
)

FLAGS_SQL = f"""
       CASE WHEN tool_wear_min > 200 THEN 1 ELSE 0 END AS twf,
       CASE WHEN abs(air_temp_k - process_temp_k) < 8.6 AND rpm < 1380 THEN 1 ELSE 0 END AS hdf,
       CASE WHEN {POWER_SQL} < 3500 OR {POWER_SQL} > 9000 THEN 1 ELSE 0 END AS pwf,
       CASE WHEN tool_wear_min * torque_nm > {OSF_THRESHOLD_SQL} THEN 1 ELSE 0 END AS osf,
       rnf_flag AS rnf"""

# r: readings; f: readings + failure flags; s: f + score p, pred, y
BASE_CTES = f"""r AS (
{READINGS_SQL}
),
f0 AS (
SELECT *,{FLAGS_SQL}
FROM r
),
f AS (
SELECT *, CASE WHEN twf + hdf + pwf + osf + rnf > 0 THEN 1 ELSE 0 END AS machine_failure
FROM f0
),
s AS (
SELECT *, {LINEAR_SCORE_SQL} AS p
FROM f
),
e AS (
SELECT uid, machine_id, ts, type, air_temp_k, process_temp_k, rpm, torque_nm, tool_wear_min,
       machine_failure AS y, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS pred, p
FROM s
)"""

RAW_CTE = f"""raw AS (
{RAW_READINGS_SQL}
)"""


def with_base(body: str) -> str:
    return f"WITH {BASE_CTES}\n{body}"


# Failure-type attribution in SQL (A3-A9): a: s + normalised type scores.
ATTRIBUTION_CTES = f"""sc AS (
SELECT *,
       CASE WHEN tool_wear_min > 200 THEN least(0.9, tool_wear_min / 250.0)
            ELSE greatest(0.1, tool_wear_min / 250.0) END AS r_twf,
       CASE WHEN process_temp_k - air_temp_k < 8.6 AND rpm < 1380 THEN 0.8 ELSE 0.2 END AS r_hdf,
       CASE WHEN {POWER_SQL} < 3500 OR {POWER_SQL} > 9000 THEN 0.7 ELSE 0.1 END AS r_pwf,
       CASE WHEN tool_wear_min * torque_nm > coalesce({OSF_THRESHOLD_SQL}, CAST(12000 AS DOUBLE))
            THEN 0.8 ELSE 0.2 END AS r_osf,
       0.001 AS r_rnf
FROM s
),
sn AS (
SELECT *, CAST(r_twf AS DOUBLE) + CAST(r_hdf AS DOUBLE) + CAST(r_pwf AS DOUBLE)
          + CAST(r_osf AS DOUBLE) + CAST(r_rnf AS DOUBLE) AS r_total
FROM sc
),
a0 AS (
SELECT *,
       CAST(r_twf AS DOUBLE) / r_total * p AS prob_twf,
       CAST(r_hdf AS DOUBLE) / r_total * p AS prob_hdf,
       CAST(r_pwf AS DOUBLE) / r_total * p AS prob_pwf,
       CAST(r_osf AS DOUBLE) / r_total * p AS prob_osf,
       CAST(r_rnf AS DOUBLE) / r_total * p AS prob_rnf
FROM sn
),
a AS (
SELECT *,
       CASE WHEN prob_twf >= prob_hdf AND prob_twf >= prob_pwf AND prob_twf >= prob_osf AND prob_twf >= prob_rnf THEN 'TWF'
            WHEN prob_hdf >= prob_pwf AND prob_hdf >= prob_osf AND prob_hdf >= prob_rnf THEN 'HDF'
            WHEN prob_pwf >= prob_osf AND prob_pwf >= prob_rnf THEN 'PWF'
            WHEN prob_osf >= prob_rnf THEN 'OSF'
            ELSE 'RNF' END AS most_likely_type,
       CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS machine_failure_pred
FROM a0
)"""


def with_attribution(body: str) -> str:
    return f"WITH {BASE_CTES},\n{ATTRIBUTION_CTES}\n{body}"


def sql_quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


RECOMMENDATION_SQL = f"""CASE WHEN p < 0.2 THEN {sql_quote(S.RECOMMENDATIONS['none'])}
            WHEN p < 0.5 THEN CASE most_likely_type
                 WHEN 'TWF' THEN {sql_quote(S.RECOMMENDATIONS['TWF'])}
                 WHEN 'HDF' THEN {sql_quote(S.RECOMMENDATIONS['HDF'])}
                 WHEN 'PWF' THEN {sql_quote(S.RECOMMENDATIONS['PWF'])}
                 WHEN 'OSF' THEN {sql_quote(S.RECOMMENDATIONS['OSF'])}
                 ELSE {sql_quote(S.RECOMMENDATIONS['other'])} END
            ELSE {sql_quote(S.RECOMMENDATIONS['urgent'])} END"""
