"""Schemas, column names and the fixed constants of the failure model.

Everything downstream refers to the snake_case names defined here; the
reference's display names only appear in ``DATASET_NAMES`` / ``API_NAMES``
(used by ``sources.io.rename_to_internal``).
"""

from __future__ import annotations

import math

from pyspark.sql import types as T

# --- column names ---------------------------------------------------------
UID = "uid"
MACHINE_ID = "machine_id"
TS = "ts"
TYPE = "type"
AIR = "air_temp_k"
PROCESS = "process_temp_k"
RPM = "rpm"
TORQUE = "torque_nm"
WEAR = "tool_wear_min"
RNF_FLAG = "rnf_flag"

SENSORS = [AIR, PROCESS, RPM, TORQUE, WEAR]
MACHINE_TYPES = ["L", "M", "H"]
FAILURE_TYPES = ["TWF", "HDF", "PWF", "OSF", "RNF"]

DOMAIN_FEATURES = [
    "temp_diff",
    "power_w",
    "tool_wear_rate",
    "torque_per_rpm",
    "tool_wear_torque",
    "temp_efficiency",
    "critical_operation",
]

SENSOR_SCHEMA = T.StructType(
    [
        T.StructField(UID, T.LongType(), False),
        T.StructField("product_id", T.StringType(), True),
        T.StructField(TYPE, T.StringType(), True),
        T.StructField(AIR, T.DoubleType(), True),
        T.StructField(PROCESS, T.DoubleType(), True),
        T.StructField(RPM, T.DoubleType(), True),
        T.StructField(TORQUE, T.DoubleType(), True),
        T.StructField(WEAR, T.DoubleType(), True),
    ]
)

# Failure labels, where a file has them
LABEL_SCHEMA = T.StructType(
    [T.StructField(n, T.IntegerType(), True) for n in ("twf", "hdf", "pwf", "osf", "rnf", "machine_failure")]
)

# Request body of the batch scoring endpoint: {"machines": [ {...}, ... ]}
MACHINE_REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("air_temperature", T.DoubleType(), True),
        T.StructField("process_temperature", T.DoubleType(), True),
        T.StructField("rotational_speed", T.DoubleType(), True),
        T.StructField("torque", T.DoubleType(), True),
        T.StructField("tool_wear", T.DoubleType(), True),
        T.StructField("machine_type", T.StringType(), True),
    ]
)
BATCH_REQUEST_SCHEMA = T.StructType(
    [T.StructField("machines", T.ArrayType(MACHINE_REQUEST_SCHEMA), True)]
)

# --- fixed values that must equal the reference's -------------------------
# Column names of the public sensor data set and of the scoring API, mapped to ours.
DATASET_NAMES = {
    "UID": UID,
    "Product ID": "product_id",
    "Type": TYPE,
    "Air temperature [K]": AIR,
    "Process temperature [K]": PROCESS,
    "Rotational speed [rpm]": RPM,
    "Torque [Nm]": TORQUE,
    "Tool wear [min]": WEAR,
    "TWF": "twf",
    "HDF": "hdf",
    "PWF": "pwf",
    "OSF": "osf",
    "RNF": "rnf",
    "Machine failure": "machine_failure",
    "Target": "machine_failure",
    "Failure Type": "failure_type",
}
API_NAMES = {
    "air_temperature": AIR,
    "process_temperature": PROCESS,
    "rotational_speed": RPM,
    "torque": TORQUE,
    "tool_wear": WEAR,
    "machine_type": TYPE,
}

# Overstrain thresholds by machine type, and the default used
# by the scoring path for an unknown type.
OSF_THRESHOLDS = {"L": 11000.0, "M": 12000.0, "H": 13000.0}
OSF_DEFAULT_THRESHOLD = 12000.0

# Rule limits.
TWF_WEAR_LIMIT = 200.0
HDF_TEMP_DIFF_LIMIT = 8.6
HDF_RPM_LIMIT = 1380.0
PWF_POWER_LOW = 3500.0
PWF_POWER_HIGH = 9000.0
WEAR_NORMALISER = 250.0
RPM_TO_RAD_S = 2 * math.pi / 60

# Heuristic failure-type scores of the scoring path.
TWF_SCORE_MIN, TWF_SCORE_MAX = 0.1, 0.9
HDF_SCORE_HIT, HDF_SCORE_MISS = 0.8, 0.2
PWF_SCORE_HIT, PWF_SCORE_MISS = 0.7, 0.1
OSF_SCORE_HIT, OSF_SCORE_MISS = 0.8, 0.2
RNF_SCORE = 0.001

# Recommendation cut-offs and texts.
RECOMMEND_NONE_BELOW = 0.2
RECOMMEND_URGENT_FROM = 0.5
RECOMMENDATIONS = {
    "none": "No maintenance required at this time. Continue regular monitoring.",
    "TWF": "Schedule tool inspection within the next 48 hours. Tool wear is approaching critical levels.",
    "HDF": "Check cooling system and improve heat dissipation. Monitor temperature differential.",
    "PWF": "Inspect power system and adjust rotational speed/torque parameters to optimal range.",
    "OSF": "Reduce operational load or replace tool to prevent overstrain failure.",
    "other": "Schedule preventive maintenance within the next week.",
    "urgent": "URGENT: Immediate maintenance required. High risk of machine failure detected.",
}

# Display bands of the UI.
RISK_HIGH_FROM, RISK_MEDIUM_FROM = 0.7, 0.3
BAR_RED_ABOVE, BAR_AMBER_ABOVE = 0.3, 0.1
MONITOR_HIGH_RATE_ABOVE = 0.3

# Retention of the monitoring history.
HISTORY_KEEP = 1000
RECENT_KEEP = 100

NO_FAILURE = "No Failure"
