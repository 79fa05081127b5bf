from ferrule.functions import rules


def _df(spark, rows):
    return spark.createDataFrame(
        rows, "uid long, type string, air_temp_k double, process_temp_k double, rpm double, "
        "torque_nm double, tool_wear_min double, rnf_flag int")


def test_boundaries(spark):
    rows = [
        (1, "L", 300.0, 308.5, 1379.0, 40.0, 200.0, 0),   # td 8.5<8.6, rpm<1380 -> HDF; wear=200 not TWF
        (2, "L", 300.0, 308.6, 1379.0, 40.0, 200.1, 0),   # td = 8.6 not < 8.6; TWF
        (3, "L", 300.0, 308.0, 1380.0, 40.0, 10.0, 0),    # rpm = 1380 not < 1380
        (4, "M", 300.0, 310.0, 1500.0, 20.0, 10.0, 0),    # power 3141.6 < 3500 -> PWF
        (5, "H", 300.0, 310.0, 1500.0, 60.0, 10.0, 0),    # power 9424.8 > 9000 -> PWF
        (6, "L", 300.0, 310.0, 1500.0, 50.0, 221.0, 0),   # 11050 > 11000 -> OSF (L)
        (7, "H", 300.0, 310.0, 1500.0, 50.0, 221.0, 0),   # 11050 < 13000 -> no OSF (H)
        (8, "X", 300.0, 310.0, 1500.0, 50.0, 260.0, 1),   # unknown type -> no OSF; RNF flag
    ]
    out = {r["uid"]: r for r in rules.label_failures(_df(spark, rows)).collect()}
    assert out[1]["hdf"] == 1 and out[1]["twf"] == 0
    assert out[2]["hdf"] == 0 and out[2]["twf"] == 1
    assert out[3]["hdf"] == 0
    assert out[4]["pwf"] == 1 and out[5]["pwf"] == 1
    assert out[6]["osf"] == 1 and out[7]["osf"] == 0 and out[8]["osf"] == 0
    assert out[8]["rnf"] == 1 and out[8]["machine_failure"] == 1
    assert out[3]["machine_failure"] == 0


def test_hdf_signed_vs_abs(spark):
    # process below air: |d| = 12 (no HDF), signed d = -12 < 8.6 (HDF)
    df = _df(spark, [(1, "L", 310.0, 298.0, 1300.0, 40.0, 10.0, 0)])
    r = df.select(rules.hdf(False).alias("a"), rules.hdf(True).alias("s")).first()
    assert (r["a"], r["s"]) == (False, True)


def test_failure_type_orders(spark):
    df = spark.createDataFrame([(1, 1, 0, 1, 0, 1), (2, 0, 0, 0, 0, 0), (3, 0, 1, 0, 1, 0)],
                               "uid long, twf int, hdf int, pwf int, osf int, rnf int")
    first = {r["uid"]: r["t"] for r in df.select("uid", rules.failure_type("first").alias("t")).collect()}
    last = {r["uid"]: r["t"] for r in df.select("uid", rules.failure_type("last").alias("t")).collect()}
    assert first == {1: "TWF", 2: "No Failure", 3: "HDF"}
    assert last == {1: "RNF", 2: "No Failure", 3: "OSF"}


def test_threshold_lookup_default(spark):
    df = spark.createDataFrame([("L",), ("M",), ("H",), ("Q",)], "type string")
    r = df.select("type", rules.osf_threshold("type").alias("a"),
                  rules.osf_threshold("type", 12000.0).alias("b")).collect()
    got = {x["type"]: (x["a"], x["b"]) for x in r}
    assert got == {"L": (11000.0, 11000.0), "M": (12000.0, 12000.0), "H": (13000.0, 13000.0),
                   "Q": (None, 12000.0)}
