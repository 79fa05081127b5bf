import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ferrule.session import local_session

    s = local_session("8", "ferrule-tests")
    yield s
    s.stop()


@pytest.fixture
def sensor_rows(spark):
    """The five-row feature demo of the reference (FIXTURES.md §6)."""
    rows = [
        (1, "L", 298.0, 308.0, 1500.0, 35.0, 100.0),
        (2, "M", 300.0, 310.0, 1550.0, 40.0, 120.0),
        (3, "H", 302.0, 312.0, 1600.0, 45.0, 150.0),
        (4, "M", 301.0, 311.0, 1550.0, 38.0, 130.0),
        (5, "L", 299.0, 309.0, 1500.0, 37.0, 110.0),
    ]
    return spark.createDataFrame(
        rows, "uid long, type string, air_temp_k double, process_temp_k double, rpm double, "
        "torque_nm double, tool_wear_min double"
    )
