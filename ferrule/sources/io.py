"""Sources and sinks.

Readers always take an explicit schema (no inference pass over the data) and
fail fast on malformed rows; writers are plain DataFrame writers, so every
sink is a distributed write, never a collect to the driver.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule import schema as S
from ferrule.operators import quality


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first line (one small read on the driver)."""
    return spark.read.option("header", True).csv(path).columns


def read_sensor_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                    extra: T.StructType | None = None, drop_unknown: bool = False) -> DataFrame:
    """Header CSV, typed, FAILFAST, bound by *name* in whatever order the
    file has its columns.  Names may be the data set's or ours.

    ``schema``: the columns that must be there (default: the sensor schema);
    ``extra``: more columns to keep where present (default: the label columns).
    Missing names are refused, and unknown ones too unless ``drop_unknown``."""
    need = schema or S.SENSOR_SCHEMA
    more = extra or S.LABEL_SCHEMA
    types = {f.name: f.dataType for f in [*more.fields, *need.fields]}
    header = _header(spark, path)
    own = [S.DATASET_NAMES.get(h, h) for h in header]
    missing = [f.name for f in need.fields if f.name not in own]
    unknown = [h for h, o in zip(header, own) if o not in types]
    double = sorted({o for o in own if own.count(o) > 1})
    if missing or double or (unknown and not drop_unknown):
        raise ValueError(f"{path}: missing columns {missing}, unknown columns {unknown}, named twice {double}")
    typed = T.StructType([T.StructField(h, types.get(o, T.StringType()), True) for h, o in zip(header, own)])
    df = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(typed).csv(path)
    keep = {o: h for h, o in zip(header, own) if o in types}
    return df.select(*[F.col(f"`{keep[c]}`").alias(c) for c in types if c in keep and c in need.fieldNames()],
                     *[F.col(f"`{keep[c]}`").alias(c) for c in types if c in keep and c not in need.fieldNames()])


def read_labelled_csv(spark: SparkSession, path: str, extra: T.StructType) -> DataFrame:
    """S1 for tables that must carry the label columns ``extra`` too."""
    return read_sensor_csv(spark, path, T.StructType([*S.SENSOR_SCHEMA.fields, *extra.fields]))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Distributed write; CSV with header and no index column."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.format(fmt).save(path)


def bind_features_targets(features: DataFrame, targets: DataFrame, key: str = S.UID) -> DataFrame:
    """Rows of the two tables matched by key (not by position)."""
    return features.join(targets, key, "inner")


def write_bucketed(df: DataFrame, path: str, key: str = S.UID, buckets: int = 200) -> None:
    """Parquet in ``buckets`` files, a hash of the key each and sorted by
    it, so that tables written alike are bound without a shuffle.  Choose
    ``buckets`` for files of about a gigabyte.  Schema, key and buckets are
    written beside the files at last, so half a table is none; a rerun writes it
    anew."""
    spark, name = df.sparkSession, _bucketed_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.repartition(buckets, F.col(f"`{key}`")).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option(
        "path", path).saveAsTable(name)
    layout = json.dumps({"key": key, "buckets": buckets, "schema": df.schema.jsonValue()})
    spark.createDataFrame([(layout,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{_LAYOUT}")


_LAYOUT = "_layout"  # a hidden name: no rows of the table


def _bucketed_name(path: str) -> str:
    return "bucketed_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:24]


def read_bucketed(spark: SparkSession, path: str) -> tuple[DataFrame, str, int]:
    """A table of ``write_bucketed``, also by another session: the table, its
    key and its number of buckets."""
    try:
        layout = json.loads(spark.read.text(f"{path}/{_LAYOUT}").first()["value"])
    except AnalysisException as e:
        raise ValueError(f"{path} is no bucketed table") from e
    key, buckets, schema = layout["key"], layout["buckets"], T.StructType.fromJson(layout["schema"])
    name, columns = _bucketed_name(path), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name), key, buckets


def bind_bucketed(spark: SparkSession, features_path: str, targets_path: str) -> DataFrame:
    """S3/J1 of two bucketed tables: a merge join of their files, bucket by
    bucket, with no shuffle.  Tables of other keys or buckets are refused."""
    features, key, buckets = read_bucketed(spark, features_path)
    targets, *other = read_bucketed(spark, targets_path)
    if other != [key, buckets]:
        raise ValueError(f"bucketed by {key} into {buckets} and by {other[0]} into {other[1]}")
    return bind_features_targets(features, targets.hint("merge"), key)


def read_batch_request(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents {"machines": [ {...}, ... ]} -> one row per machine,
    renamed to internal names, with ``request`` (the file, and a number that no
    other document of this read has) and ``position`` in the request."""
    raw = spark.read.schema(S.BATCH_REQUEST_SCHEMA).option("mode", "FAILFAST").json(path)
    request = F.concat_ws("#", "_metadata.file_path", F.monotonically_increasing_id().cast("string"))
    keyed = raw.select(request.alias("request"), "machines")
    rows = keyed.select("request", F.posexplode("machines").alias("position", "m")).select("request", "position", "m.*")
    return quality.rename_to_internal(rows, S.API_NAMES)


def read_request_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S12/P4 for feeds that hold bad records: (good rows, dead letters).

    One JSON document {"machines": [ {...}, ... ]} a line; blank lines don't
    count.  Good rows are cast and renamed, with ``request`` and ``position``.
    Dead letters have file, request, position, reason and the record as it
    came: of a document (position null) that is ``not_json`` or has
    ``no_machines``, or of a row that validation refuses (its status is the
    reason; a null row misses its values).  ``request`` is the SHA-256 of the
    document, the same however the feed is cut into files; a document sent
    twice has it twice.  Values are read as text, so a number that is none is a
    reason, not a broken document."""
    machine = T.StructType([T.StructField(c, T.StringType()) for c in [S.UID, *S.API_NAMES]])
    schema = T.StructType([T.StructField("machines", T.ArrayType(machine)), T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    read = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    docs = lines.select(
        F.col("_metadata.file_path").alias("file"), F.sha2("value", 256).alias("request"), F.col("value").alias("record"), read.alias("d"))
    docs = docs.withColumn("reason", F.when(F.col("d").isNull() | F.col("d._corrupt").isNotNull(), "not_json").when(
        F.coalesce(F.size("d.machines"), F.lit(0)) <= 0, "no_machines"))
    rows = docs.filter("reason is null").select("file", "request", F.posexplode("d.machines").alias("position", "m"))
    checked = quality.validate_requests(rows.select("file", "request", "position", F.to_json("m").alias("record"), "m.*"))
    key = ["file", "request", "position"]
    bad_rows = checked.filter("status <> 'valid'").select(*key, F.col("status").alias("reason"), F.coalesce("record", F.lit("null")).alias("record"))
    bad_docs = docs.filter("reason is not null").select("file", "request", F.lit(None).cast("int").alias("position"), "reason", "record")
    return quality.valid_rows(checked).drop("file", "record"), bad_docs.unionByName(bad_rows)


def batch_response(scored: DataFrame, summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions stay rows (JSON per row), the summary is one row."""
    preds = scored.select(
        S.UID,
        F.to_json(F.struct(
            "machine_failure", "failure_probability",
            F.date_format("prediction_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("prediction_time"),
            "failure_type", "maintenance_recommendation",
        )).alias("prediction"),
    )
    return preds, summary.select(F.to_json(F.struct("*")).alias("summary"))


def prediction_sink(scored: DataFrame, id_col: str = S.UID, label: str | None = None,
                    n_classes: int = 2, prob_col: str = "probability") -> DataFrame:
    """Id, prediction, probability per class, true value when present.
    Class probabilities come from ``prob_col`` (an array or a vector) where
    there is one, else from ``p`` for two classes."""
    from pyspark.ml.functions import vector_to_array

    cols = [F.col(id_col), F.col("pred").alias("prediction")]
    if prob_col in scored.columns:
        kind = scored.schema[prob_col].dataType
        arr = F.col(prob_col) if isinstance(kind, T.ArrayType) else vector_to_array(prob_col)
        cols += [arr[i].alias(f"probability_class_{i}") for i in range(n_classes)]
    elif n_classes == 2 and "p" in scored.columns:
        cols += [(F.lit(1.0) - F.col("p")).alias("probability_class_0"), F.col("p").alias("probability_class_1")]
    if label and label in scored.columns:
        cols.append(F.col(label).alias("true_value"))
    return scored.select(*cols)


def evaluation_report(ranked: DataFrame, metric: str = "accuracy",
                      names: tuple[str, ...] = ("accuracy", "precision_weighted", "recall_weighted",
                                                "f1_weighted", "roc_auc")) -> DataFrame:
    """One JSON-ready row {metrics: {model: {metric: value}}, best_model,
    best_score} from the ranked model table (``evaluate.best_model``).
    One aggregate over one row per model; no join."""
    per_model = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
    return ranked.agg(
        F.map_from_entries(F.collect_list(F.struct("model", per_model))).alias("metrics"),
        F.min_by("model", f"rank_{metric}").alias("best_model"),
        F.min_by(F.col(metric), f"rank_{metric}").alias("best_score"),
    )


def error_report(cells: DataFrame, top_k: int = 5) -> DataFrame:
    """E11-E13 in one row, computed from the confusion cells alone
    (k*k rows) with one aggregate and array functions; no join."""
    lst = F.collect_list(F.struct("true_label", "predicted_label", "count"))
    err = F.sum(F.when(F.col("true_label") != F.col("predicted_label"), F.col("count")).otherwise(0))
    agg = cells.agg(lst.alias("cells"), (err / F.sum("count")).alias("error_rate"))
    labels = F.array_sort(F.array_distinct(F.transform("cells", lambda x: x["true_label"])))

    def class_rate(lab):
        mine = F.filter("cells", lambda x: x["true_label"] == lab)
        tot = F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a + x["count"])
        wrong = F.aggregate(F.filter(mine, lambda x: x["predicted_label"] != lab),
                            F.lit(0).cast("long"), lambda a, x: a + x["count"])
        return F.struct(lab.cast("string").alias("k"), (wrong / tot).alias("v"))

    errors = F.filter("cells", lambda x: (x["true_label"] != x["predicted_label"]) & (x["count"] > 0))
    ranked = F.array_sort(
        errors,
        lambda a, b: F.when(a["count"] > b["count"], -1).when(a["count"] < b["count"], 1)
        .when(a["true_label"] < b["true_label"], -1).when(a["true_label"] > b["true_label"], 1)
        .when(a["predicted_label"] < b["predicted_label"], -1)
        .when(a["predicted_label"] > b["predicted_label"], 1).otherwise(0),
    )
    return agg.select(
        "error_rate",
        F.map_from_entries(F.transform(labels, class_rate)).alias("error_rate_by_class"),
        F.col("cells").alias("confusion_matrix"),
        F.slice(ranked, 1, top_k).alias("top_misclassifications"),
    )
