"""Feature expressions.

All features are plain column expressions; ``add_*`` helpers apply them in one
``select`` so the whole set stays inside a single whole-stage-codegen span.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule import schema as S


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def temp_diff(air: str = S.AIR, process: str = S.PROCESS) -> Column:
    return _c(process) - _c(air)


def power_w(rpm: str = S.RPM, torque: str = S.TORQUE) -> Column:
    # operand order rpm * torque * (2*pi/60) kept: it decides the last bit
    return _c(rpm) * _c(torque) * F.lit(S.RPM_TO_RAD_S)


def domain_columns(
    air: str = S.AIR,
    process: str = S.PROCESS,
    rpm: str = S.RPM,
    torque: str = S.TORQUE,
    wear: str = S.WEAR,
) -> dict[str, Column]:
    """F1-F7 as named expressions (power and temp_diff defined once)."""
    td = temp_diff(air, process)
    pw = power_w(rpm, torque)
    as_int = lambda c: c.cast("int")
    return {
        "temp_diff": td,
        "power_w": pw,
        "tool_wear_rate": _c(wear) / (pw + F.lit(1.0)),
        "torque_per_rpm": _c(torque) / (_c(rpm) + F.lit(1.0)),
        "tool_wear_torque": _c(wear) * _c(torque),
        "temp_efficiency": _c(air) / (_c(process) + F.lit(1.0)),
        # product binds first: (td<8.6)*(pw<3500) + (pw>9000) + (wear>200)
        "critical_operation": as_int(td < S.HDF_TEMP_DIFF_LIMIT) * as_int(pw < S.PWF_POWER_LOW)
        + as_int(pw > S.PWF_POWER_HIGH)
        + as_int(_c(wear) > S.TWF_WEAR_LIMIT),
    }


def tool_wear_frac(wear: str = S.WEAR) -> Column:
    """F8: wear normalised to the tool life (the demo data's meaning)."""
    return _c(wear) / F.lit(S.WEAR_NORMALISER)


# Fixed value: the interaction pairs, in the reference's order.
INTERACTION_PAIRS = [(S.AIR, S.PROCESS), (S.RPM, S.TORQUE), (S.WEAR, S.TORQUE), (S.WEAR, S.RPM)]


def interaction_columns(columns: list[str]) -> dict[str, Column]:
    """products of the fixed pairs where both columns exist."""
    present = set(columns)
    return {
        f"{a}_{b}_interaction": _c(a) * _c(b)
        for a, b in INTERACTION_PAIRS
        if a in present and b in present
    }


def polynomial_columns(numeric: list[str], degree: int = 2) -> dict[str, Column]:
    """all monomials of degree 2..d (degree-1 terms are the originals).

    Names follow the usual ``a^2`` / ``a b`` convention; term order is by
    degree, then lexicographic over the input order.
    """
    out: dict[str, Column] = {}
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(range(len(numeric)), d):
            counts: dict[int, int] = {}
            for i in combo:
                counts[i] = counts.get(i, 0) + 1
            name = " ".join(
                numeric[i] if k == 1 else f"{numeric[i]}^{k}" for i, k in sorted(counts.items())
            )
            expr = None
            for i in combo:
                term = _c(numeric[i]).cast("double")
                expr = term if expr is None else expr * term
            out[name] = expr
    return out


def power_columns(numeric: list[str]) -> dict[str, Column]:
    """square, cube and sqrt(|x|) of every numeric column."""
    out: dict[str, Column] = {}
    for c in numeric:
        x = _c(c).cast("double")
        out[f"{c}_squared"] = x * x
        # x*x*x, not pow: JVM and C pow may differ in the last bit
        out[f"{c}_cubed"] = x * x * x
        out[f"{c}_sqrt"] = F.sqrt(F.abs(x))
    return out


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Integer / double columns, in schema order."""
    ok = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, ok) and f.name not in exclude]


def require_columns(df: DataFrame, required: list[str]) -> None:
    """Fail (instead of silently skipping) when a sensor is absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def with_columns(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Append many named expressions in one projection."""
    return df.select("*", *[c.alias(n) for n, c in cols.items()])


def engineer(
    df: DataFrame,
    domain: bool = True,
    polynomial: bool = False,
    interactions: bool = True,
    powers: bool = False,
    degree: int = 2,
    numeric: list[str] | None = None,
) -> DataFrame:
    """domain -> polynomial -> interactions -> powers; later steps see
    the columns of earlier steps.  ``numeric`` restricts the columns the
    polynomial step expands (default: every numeric column except keys and
    flags); the power step expands those and what the steps between added."""
    out = df
    if domain:
        require_columns(out, S.SENSORS)
        out = with_columns(out, domain_columns())
    keys = (S.UID, S.MACHINE_ID, S.RNF_FLAG, "machine_failure", "label", "y")
    before = set(out.columns)
    if polynomial:
        cols = numeric or numeric_columns(out, keys)
        out = with_columns(out, polynomial_columns(cols, degree))
    if interactions:
        out = with_columns(out, interaction_columns(out.columns))
    if powers:
        cols = [*numeric, *(c for c in out.columns if c not in before)] if numeric else numeric_columns(out, keys)
        out = with_columns(out, power_columns(cols))
    return out


def engineered_names(
    input_columns: list[str],
    domain: bool = True,
    interactions: bool = True,
    polynomial: bool = False,
    powers: bool = False,
    degree: int = 2,
    numeric: list[str] | None = None,
) -> list[str]:
    """names added by ``engineer``, in the order in which it adds them;
    ``numeric`` as there (default: the input columns and the domain features)."""
    names = list(domain_columns().keys()) if domain else []
    expand = numeric or [*input_columns, *names]
    n_domain = len(names)
    if polynomial:
        names += list(polynomial_columns(expand, degree).keys())
    if interactions:
        names += list(interaction_columns([*input_columns, *names]).keys())
    if powers:
        names += list(power_columns([*expand, *names[n_domain:]]).keys())
    return names
