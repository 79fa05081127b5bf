import pytest

from ferrule.functions import features as FE
from ferrule.ml.stages import FeatureEngineer

GOLDEN = {  # FIXTURES.md §6, per input row
    1: (10, 5497.787144, 0.018185829, 0.023317788, 3500, 0.964401294, 0, 91784, 52500, 3500, 150000),
    2: (10, 6492.624817, 0.018479663, 0.025789813, 4800, 0.964630225, 0, 93000, 62000, 4800, 186000),
    3: (10, 7539.822369, 0.019891730, 0.028107433, 6750, 0.964856230, 0, 94224, 72000, 6750, 240000),
    4: (10, 6167.993577, 0.021073129, 0.024500322, 4940, 0.964743590, 0, 93611, 58900, 4940, 201500),
    5: (10, 5811.946409, 0.018923278, 0.024650233, 4070, 0.964516129, 0, 92391, 55500, 4070, 165000),
}
COLS = ["temp_diff", "power_w", "tool_wear_rate", "torque_per_rpm", "tool_wear_torque", "temp_efficiency",
        "critical_operation", "air_temp_k_process_temp_k_interaction", "rpm_torque_nm_interaction",
        "tool_wear_min_torque_nm_interaction", "tool_wear_min_rpm_interaction"]


def test_demo_golden(sensor_rows):
    out = FE.engineer(sensor_rows)
    rows = {r["uid"]: r for r in out.collect()}
    for uid, vals in GOLDEN.items():
        for c, v in zip(COLS, vals):
            assert rows[uid][c] == pytest.approx(v, rel=1e-8, abs=1e-8), (uid, c)


def test_shape_six_to_seventeen(sensor_rows):
    df = sensor_rows.drop("uid")
    assert len(df.columns) == 6
    assert len(FeatureEngineer().transform(df).columns) == 17


def test_names_match_width(sensor_rows):
    fe = FeatureEngineer()
    added = fe.output_names(sensor_rows.columns)
    out = fe.transform(sensor_rows)
    assert added == [c for c in out.columns if c not in sensor_rows.columns]


def test_missing_sensor_raises(sensor_rows):
    with pytest.raises(ValueError):
        FE.engineer(sensor_rows.drop("torque_nm"))


def test_polynomial_names_and_count(sensor_rows):
    cols = FE.polynomial_columns(["a", "b", "c"], 2)
    assert list(cols) == ["a^2", "a b", "a c", "b^2", "b c", "c^2"]
    out = FE.engineer(sensor_rows, polynomial=True, interactions=False,
                      numeric=["air_temp_k", "process_temp_k", "rpm", "torque_nm", "tool_wear_min",
                               "temp_diff", "power_w", "tool_wear_rate", "torque_per_rpm",
                               "tool_wear_torque", "temp_efficiency", "critical_operation"])
    # 12 numeric inputs -> 78 degree-2 terms
    assert len(out.columns) == len(sensor_rows.columns) + 7 + 78


def test_powers(sensor_rows):
    out = FE.engineer(sensor_rows, domain=False, interactions=False, powers=True,
                      numeric=["torque_nm"]).orderBy("uid").first()
    assert out["torque_nm_squared"] == 35.0 ** 2
    assert out["torque_nm_cubed"] == pytest.approx(35.0 ** 3)
    assert out["torque_nm_sqrt"] == pytest.approx(35.0 ** 0.5)
