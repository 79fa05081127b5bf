"""Input validation (P4-P6) and the declared-but-unbuilt data-quality options
(C1 min-max scaling, C2 imputation, C5 outlier clipping)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.operators import ranking


def rename_to_internal(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """P5: API / data-set names -> snake_case names (absent names ignored)."""
    mapping = names or {**S.API_NAMES, **S.DATASET_NAMES}
    present = {k: v for k, v in mapping.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(present) if present else df


def validate_requests(raw: DataFrame) -> DataFrame:
    """Rename, ``try_cast`` every sensor to double and tag each row
    with a status: missing_value, not_a_number, unknown_type or valid."""
    missing_cols = [c for c in S.API_NAMES if c not in raw.columns and S.API_NAMES[c] not in raw.columns]
    if missing_cols:
        raise ValueError(f"missing required columns: {missing_cols}")
    df = rename_to_internal(raw, S.API_NAMES)
    casts = {c: F.col(c).try_cast("double") for c in S.SENSORS}
    missing = None
    bad = None
    for c in S.SENSORS:
        m = F.col(c).isNull()
        b = F.col(c).isNotNull() & casts[c].isNull()
        missing = m if missing is None else missing | m
        bad = b if bad is None else bad | b
    status = (
        F.when(missing, F.lit("missing_value"))
        .when(bad, F.lit("not_a_number"))
        .when(F.col(S.TYPE).isNull() | ~F.col(S.TYPE).isin(*S.MACHINE_TYPES), F.lit("unknown_type"))
        .otherwise(F.lit("valid"))
    )
    keep = [c for c in df.columns if c not in S.SENSORS]
    return df.select(*keep, *[casts[c].alias(c) for c in S.SENSORS], status.alias("status"))


def validation_summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(S.WEAR), 6).alias("avg_tool_wear")
    )


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("status") == "valid").drop("status")


def minmax_scale(df: DataFrame, cols: list[str], suffix: str = "_mm") -> DataFrame:
    """(x - min) / (max - min); a constant column scales to 0.
    One global aggregate (partial per partition), joined back as literals."""
    stats = df.agg(*[F.min(c).alias(f"mn_{i}") for i, c in enumerate(cols)],
                   *[F.max(c).alias(f"mx_{i}") for i, c in enumerate(cols)]).first()
    out = []
    for i, c in enumerate(cols):
        mn, mx = stats[f"mn_{i}"], stats[f"mx_{i}"]
        rng = (mx - mn) if mn is not None and mx is not None else None
        if not rng:
            out.append(F.lit(0.0).alias(c + suffix) if rng == 0 else F.lit(None).cast("double").alias(c + suffix))
        else:
            out.append(((F.col(c) - F.lit(mn)) / F.lit(rng)).alias(c + suffix))
    return df.select("*", *out)


def impute(df: DataFrame, cols: list[str], strategy: str = "mean") -> DataFrame:
    """Fill nulls by the column mean, exact median, or drop the row.
    The median is exact and distributed (ranking.exact_quantiles), never a
    collect of the column."""
    if strategy == "drop":
        return df.dropna(subset=cols)
    if strategy == "mean":
        stats = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    elif strategy == "median":
        med = ranking.exact_quantiles_multi(df, cols, [0.5])
        stats = {c: med[c][0] for c in cols}
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return df.select(
        *[
            F.coalesce(F.col(c), F.lit(stats[c])).alias(c) if c in cols else F.col(c)
            for c in df.columns
        ]
    )


def clip_outliers(df: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    """Clip to the Tukey fences q1 - k*IQR, q3 + k*IQR (exact quartiles)."""
    exprs = {}
    quart = ranking.exact_quantiles_multi(df, cols, [0.25, 0.75])
    for c in cols:
        q1, q3 = quart[c]
        if q1 is None:
            continue
        lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        exprs[c] = F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))
    return df.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns])


def robust_scale(df: DataFrame, cols: list[str], suffix: str = "_rs") -> DataFrame:
    """C1 'robust': (x - median) / (q3 - q1) with exact quartiles; a zero
    inter-quartile range divides by 1."""
    qs = ranking.exact_quantiles_multi(df, cols, [0.25, 0.5, 0.75])
    out = []
    for c in cols:
        q1, med, q3 = qs[c]
        if med is None:
            out.append(F.lit(None).cast("double").alias(c + suffix))
            continue
        iqr = (q3 - q1) or 1.0
        out.append(((F.col(c) - F.lit(med)) / F.lit(iqr)).alias(c + suffix))
    return df.select("*", *out)


def column_modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent non-null value per column; ties -> the smallest value.
    One pass per value type: unpivot to (column, value), count per pair
    (partial aggregation), then one ``min_by`` per column over those counts."""
    types = dict(df.dtypes)
    out = {}
    groups: dict[str, list[str]] = {}
    for c in cols:
        groups.setdefault("STRING" if types[c] == "string" else "DOUBLE", []).append(c)
    for typ, members in groups.items():
        parts = ", ".join(f"'{c}', CAST(`{c}` AS {typ})" for c in members)
        picked = (
            df.select(F.expr(f"stack({len(members)}, {parts}) AS (feature, value)"))
            .filter(F.col("value").isNotNull())
            .groupBy("feature", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("feature")
            .agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("m"))
            .collect()
        )
        for r in picked:
            out[r["feature"]] = r["m"]
    for c in cols:
        out.setdefault(c, None)
    return out


def impute_mode(df: DataFrame, cols: list[str]) -> DataFrame:
    """C2 'mode'."""
    modes = column_modes(df, cols)
    return df.select(
        *[F.coalesce(F.col(c), F.lit(modes[c])).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def split_features_target(df: DataFrame, target: str | None, keep: list[str] | None = None) -> DataFrame:
    """Feature / target split without separating rows from their truth:
    the key, the allowed features and (when present) the target stay in the
    same row; ``target`` absent -> features only."""
    feats = [c for c in (keep or df.columns) if c != target]
    cols = feats + ([target] if target and target in df.columns else [])
    return df.select(*cols)


def id_column(df: DataFrame, explicit: str | None = None) -> str:
    """The explicit id column, else the first column whose name
    contains 'id' (the reference's discovery rule)."""
    if explicit:
        if explicit not in df.columns:
            raise ValueError(f"id column {explicit} not found")
        return explicit
    for c in df.columns:
        if "id" in c.lower():
            return c
    raise ValueError("no id column")
