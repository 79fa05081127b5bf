"""Failure rules (L1-L8) and the overstrain threshold lookup.

The type -> threshold lookup is a three-entry constant, so it is written as a
``CASE`` expression (what a broadcast join of a 3-row table compiles to,
without the join); ``threshold_table`` gives the same lookup as a DataFrame
for users that want to join their own thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.functions.features import power_w, temp_diff


def osf_threshold(type_col: str = S.TYPE, default: float | None = None) -> Column:
    """J2 (default None: unknown type -> null -> rule false) / J3 (default 12000)."""
    expr = None
    for t, v in S.OSF_THRESHOLDS.items():
        expr = (F.when if expr is None else expr.when)(F.col(type_col) == t, F.lit(v))
    return expr.otherwise(F.lit(default) if default is not None else F.lit(None).cast("double"))


def threshold_table(spark: SparkSession) -> DataFrame:
    rows = [(t, v) for t, v in S.OSF_THRESHOLDS.items()]
    return spark.createDataFrame(rows, "type string, osf_threshold double")


def twf(wear: str = S.WEAR) -> Column:
    return F.col(wear) > S.TWF_WEAR_LIMIT


def hdf(signed: bool = False) -> Column:
    """L2.  signed=False: |air - process| < 8.6 (data-set rule);
    signed=True: process - air < 8.6 (demo / scoring rule)."""
    td = temp_diff() if signed else F.abs(F.col(S.AIR) - F.col(S.PROCESS))
    return (td < S.HDF_TEMP_DIFF_LIMIT) & (F.col(S.RPM) < S.HDF_RPM_LIMIT)


def pwf() -> Column:
    pw = power_w()
    return (pw < S.PWF_POWER_LOW) | (pw > S.PWF_POWER_HIGH)


def osf(default: float | None = None) -> Column:
    """L4: wear*torque above the type's threshold; unknown type -> false."""
    return F.coalesce(
        F.col(S.WEAR) * F.col(S.TORQUE) > osf_threshold(S.TYPE, default), F.lit(False)
    )


def failure_flag_columns(signed_hdf: bool = False, rnf_col: str = S.RNF_FLAG) -> dict[str, Column]:
    """L1-L6 as 0/1 ints.  RNF is an input flag (the random draw is a simulator)."""
    flags = {
        "twf": twf().cast("int"),
        "hdf": hdf(signed_hdf).cast("int"),
        "pwf": pwf().cast("int"),
        "osf": osf().cast("int"),
        "rnf": F.coalesce(F.col(rnf_col).cast("int"), F.lit(0)),
    }
    total = flags["twf"] + flags["hdf"] + flags["pwf"] + flags["osf"] + flags["rnf"]
    flags["machine_failure"] = (total > 0).cast("int")
    return flags


def label_failures(df: DataFrame, signed_hdf: bool = False, rnf_col: str = S.RNF_FLAG) -> DataFrame:
    flags = failure_flag_columns(signed_hdf, rnf_col)
    return df.select("*", *[c.alias(n) for n, c in flags.items()])


def failure_type(order: str = "first", flags: tuple[str, ...] = ("twf", "hdf", "pwf", "osf", "rnf")) -> Column:
    """One failure name per row.

    order="first": the stated priority TWF > HDF > PWF > OSF > RNF.
    order="last":  later rules overwrite earlier ones (RNF > OSF > PWF > HDF > TWF),
                   which is what the reference's assignment sequence produces.
    """
    names = list(zip(flags, S.FAILURE_TYPES))
    if order == "last":
        names = names[::-1]
    elif order != "first":
        raise ValueError("order must be 'first' or 'last'")
    expr = None
    for col, name in names:
        cond = F.col(col) == 1
        expr = (F.when if expr is None else expr.when)(cond, F.lit(name))
    return expr.otherwise(F.lit(S.NO_FAILURE))
