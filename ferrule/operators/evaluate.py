"""Evaluation (E1-E17) on a prediction frame (uid, y, pred, p, features...).

Every metric is computed from small aggregates of the prediction frame:
the confusion cells (k*k rows) for accuracy / P / R / F1 / reports, and the
two-level prefix sums of ``ranking`` for AUC / ROC / PR / AP.  The frame is
transformed once; callers may ``persist`` it and run many metrics from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators import ranking

def class_pairs(df: DataFrame, y: str = "y", pred: str = "pred", groups: list[str] | None = None) -> DataFrame:
    """(groups, true_label, predicted_label, count) of the pairs that occur:
    one aggregate with map-side partial sums, whatever the number of classes.
    Rows without a true or a predicted label are not counted."""
    gs = list(groups or [])
    yc, pc = F.col(y).cast("int"), F.col(pred).cast("int")
    return df.filter(yc.isNotNull() & pc.isNotNull()).groupBy(
        *gs, yc.alias("true_label"), pc.alias("predicted_label")).agg(F.count(F.lit(1)).alias("count"))


def _class_list(pairs: DataFrame, labels: list[int] | None, gs: list[str]) -> DataFrame:
    """(groups, label): the given labels, and every label that occurs."""
    both = F.explode(F.array("true_label", "predicted_label")).alias("label")
    found = pairs.select(*gs, both).distinct()
    if labels:
        given = F.explode(F.array(*[F.lit(int(v)) for v in labels])).alias("label")
        base = pairs.select(*gs).distinct() if gs else pairs.sparkSession.range(1)
        found = found.unionByName(base.select(*gs, given)).distinct()
    return found


def confusion_cells(df: DataFrame, y: str = "y", pred: str = "pred", labels: list[int] | None = None,
                    groups: list[str] | None = None) -> DataFrame:
    """(true_label, predicted_label, count) for every pair of classes,
    zeros included.  ``labels`` adds classes that need not occur."""
    gs = list(groups or [])
    pairs = class_pairs(df, y, pred, gs)
    classes = _class_list(pairs, labels, gs)
    # the grid is the result's own size: classes x classes
    every = classes.groupBy(*gs).agg(F.collect_list("label").alias("_l"))
    grid = every.select(*gs, "_l", F.explode("_l").alias("true_label")).select(
        *gs, "true_label", F.explode("_l").alias("predicted_label"))
    other = pairs.select(*[F.col(c).alias(f"_r_{c}") for c in [*gs, "true_label", "predicted_label"]], "count")
    cond = (F.col("true_label") == F.col("_r_true_label")) & (F.col("predicted_label") == F.col("_r_predicted_label"))
    for g in gs:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_r_{g}"))
    return grid.join(other, cond, "left").select(
        *gs, "true_label", "predicted_label", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def per_class(df: DataFrame, y: str = "y", pred: str = "pred", labels: list[int] | None = None,
              groups: list[str] | None = None) -> DataFrame:
    """Per label: tp, predicted, support, precision, recall, f1 (zero
    division -> 0), for every label that occurs and those in ``labels``; from
    the pair counts, no join."""
    gs = list(groups or [])
    pairs = class_pairs(df, y, pred, gs)
    hit = F.col("true_label") == F.col("predicted_label")
    # a pair counts once for its true and once for its predicted class
    sides = F.explode(F.array(
        F.struct(F.col("true_label").alias("label"), F.when(hit, F.col("count")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("predicted"), F.col("count").alias("support")),
        F.struct(F.col("predicted_label").alias("label"), F.lit(0).cast("long").alias("tp"),
                 F.col("count").alias("predicted"), F.lit(0).cast("long").alias("support")),
    )).alias("x")
    rows = pairs.select(*gs, sides).select(*gs, "x.*")
    if labels:
        none = [F.lit(0).cast("long").alias(c) for c in ("tp", "predicted", "support")]
        given = F.explode(F.array(*[F.lit(int(v)).cast(pairs.schema["true_label"].dataType) for v in labels])).alias("label")
        # the labels that occur are in the rows; only with groups is the input asked for these
        base = pairs.select(*gs).distinct() if gs else pairs.sparkSession.range(1)
        rows = rows.unionByName(base.select(*gs, given, *none))
    t = rows.groupBy(*gs, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
    zero = F.lit(0.0)
    return t.select(
        *gs, F.col("label").cast("int").alias("label"), "tp", "predicted", "support",
        F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(zero).alias("precision"),
        F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(zero).alias("recall"),
        F.when(F.col("predicted") + F.col("support") > 0,
               2 * F.col("tp") / (F.col("predicted") + F.col("support"))).otherwise(zero).alias("f1"),
    )


def summary_metrics(df: DataFrame, y: str = "y", pred: str = "pred", labels: list[int] | None = None,
                    groups: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 (one row per group)."""
    gs = list(groups or [])
    pc = per_class(df, y, pred, labels, gs)
    r = lambda c: F.round(c, digits)
    n = F.sum("support")
    return pc.groupBy(*gs).agg(
        n.alias("n_rows"),
        r(F.sum("tp") / n).alias("accuracy"),
        r(F.sum(F.col("precision") * F.col("support")) / n).alias("precision_weighted"),
        r(F.sum(F.col("recall") * F.col("support")) / n).alias("recall_weighted"),
        r(F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
    )


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred", labels: list[int] | None = None,
                          digits: int = 6) -> DataFrame:
    """E5: per-class rows, then accuracy, macro avg, weighted avg; all from
    the pair counts (the per-class table has k rows)."""
    pc = per_class(df, y, pred, labels)
    r = lambda c: F.round(c, digits)
    n = F.sum("support")
    summary = pc.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(
                "label", r(F.col("precision")).alias("precision"), r(F.col("recall")).alias("recall"),
                r(F.col("f1")).alias("f1"), F.col("support").cast("long").alias("support")))),
            lambda x: x.withField("label", x["label"].cast("string"))).alias("classes"),
        r(F.sum("tp") / n).alias("acc"),
        r(F.avg("precision")).alias("mp"), r(F.avg("recall")).alias("mr"), r(F.avg("f1")).alias("mf"),
        r(F.sum(F.col("precision") * F.col("support")) / n).alias("wp"),
        r(F.sum(F.col("recall") * F.col("support")) / n).alias("wr"),
        r(F.sum(F.col("f1") * F.col("support")) / n).alias("wf"),
        n.cast("long").alias("n"),
    )
    none = F.lit(None).cast("double")
    tail = F.array(
        F.struct(F.lit("accuracy").alias("label"), none.alias("precision"), none.alias("recall"),
                 F.col("acc").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support")),
    )
    return summary.select(F.explode(F.concat("classes", tail)).alias("row")).select("row.*")


def roc_auc(df: DataFrame, score: str = "p", y: str = "y", groups: list[str] | None = None,
            ranges: int = ranking.RANGES) -> DataFrame:
    """Exact ROC AUC (mid-ranks for ties) = Mann-Whitney U / (P*N) of labels
    0 and 1; null where another label occurs, or one of the two doesn't.  U is a
    sum of integers and halves, so it is exact in double arithmetic."""
    gs = list(groups or [])
    label = F.col(y).cast("long")
    counts = {"pos": (label == 1).cast("long"), "neg": (label == 0).cast("long"), "other": (~label.isin(0, 1)).cast("long")}
    pre = ranking.ordered_prefix(df, score, counts, True, ranges, gs)
    u = F.sum(F.col("pos") * (F.col("total_neg") - F.col("cum_neg") + F.col("neg") * 0.5))
    area = F.try_divide(u, F.first("total_pos") * F.first("total_neg"))
    return pre.groupBy(*gs).agg(
        F.when(F.first("total_other") == 0, area).alias("roc_auc"),
        F.first("total_pos").alias("n_pos"),
        F.first("total_neg").alias("n_neg"),
    )


def average_precision(df: DataFrame, score: str = "p", y: str = "y", groups: list[str] | None = None,
                      digits: int = 6, ranges: int = ranking.RANGES) -> DataFrame:
    """Sum over thresholds of (R_k - R_{k-1}) * P_k, no interpolation."""
    gs = list(groups or [])
    pre = ranking.score_prefix(df, score, y, ranges, gs)
    term = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return pre.groupBy(*gs).agg(
        F.round(F.try_divide(F.sum(term), F.first("total_pos")), digits).alias("average_precision")
    )


def roc_curve(df: DataFrame, score: str = "p", y: str = "y", drop_intermediate: bool = True,
              ranges: int = ranking.RANGES) -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score, descending, after a
    leading (inf, 0, 0).  Collinear points are dropped: a point stays when the
    second difference of fps or tps is non-zero there, which reduces to the
    next point's (neg, pos) differing from this point's."""
    pre = ranking.score_prefix(df, score, y, ranges)
    first = (F.col("cum_pos") + F.col("cum_neg")) == (F.col("pos") + F.col("neg"))
    last = F.col("next_pos").isNull()
    keep = first | last | (F.col("next_neg") != F.col("neg")) | (F.col("next_pos") != F.col("pos"))
    pts = pre.filter(keep) if drop_intermediate else pre
    curve = pts.select(
        F.col(score).alias("threshold"),
        F.try_divide(F.col("cum_neg").cast("double"), F.col("total_neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("total_pos")).alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(curve)


def pr_curve(df: DataFrame, score: str = "p", y: str = "y", ranges: int = ranking.RANGES) -> DataFrame:
    """(threshold, precision, recall) at each distinct score, plus the end
    point precision 1, recall 0 (threshold null)."""
    pre = ranking.score_prefix(df, score, y, ranges)
    curve = pre.select(
        F.col(score).alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.when(F.col("total_pos") == 0, F.lit(1.0))
        .otherwise(F.col("cum_pos") / F.col("total_pos")).alias("recall"),
    )
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return curve.unionByName(end)


def model_metrics(df: DataFrame, model_col: str = "model", y: str = "y", pred: str = "pred",
                  score: str = "p", digits: int = 6) -> DataFrame:
    """E9 input: one row per model with accuracy, weighted P/R/F1 and AUC,
    computed for all models in the same jobs (model is a group key)."""
    m = summary_metrics(df, y, pred, None, [model_col], digits)
    auc = roc_auc(df, score, y, [model_col]).select(model_col, F.round("roc_auc", digits).alias("roc_auc"))
    return m.join(auc, model_col, "left")


def best_model(metrics: DataFrame, order: dict[str, int], metric: str = "accuracy",
               model_col: str = "model") -> DataFrame:
    """Highest ``metric``; ties go to the earlier model in ``order``
    (strictly-greater replacement in a loop).  Adds ``train_order``,
    ``rank_<metric>`` and ``is_best_<metric>`` columns."""
    expr = None
    for name, pos in order.items():
        expr = (F.when if expr is None else expr.when)(F.col(model_col) == name, F.lit(pos))
    ranked = metrics.withColumn("train_order", expr.otherwise(F.lit(len(order))))
    from pyspark.sql import Window

    # at most one row per model: a tiny table, a global window is fine here
    w = Window.orderBy(F.desc(metric), F.asc("train_order"))
    return ranked.withColumn(f"rank_{metric}", F.row_number().over(w)).withColumn(
        f"is_best_{metric}", (F.col(f"rank_{metric}") == 1).cast("int")
    )


def error_frame(df: DataFrame, y: str = "y", pred: str = "pred", p: str | None = "p",
                probability: str | None = None, n_classes: int = 2) -> DataFrame:
    """Rows keep features, truth and prediction together (no positional
    bind), with one probability column a class: from the array ``probability`` of
    ``n_classes``, or for two classes from ``p``, that of class 1."""
    cols = [F.col("*"), (F.col(y) != F.col(pred)).cast("int").alias("is_error")]
    if probability:
        cols += [F.get(probability, F.lit(i)).alias(f"prob_class_{i}") for i in range(n_classes)]
    elif n_classes != 2:
        raise ValueError("more than two classes need the array of their probabilities")
    elif p:
        cols += [(F.lit(1.0) - F.col(p)).alias("prob_class_0"), F.col(p).alias("prob_class_1")]
    return df.select(*cols)


def error_rates(errors: DataFrame, y: str = "y", digits: int = 6) -> DataFrame:
    """Overall error rate and error rate per true class, as rows
    (scope, label, n_rows, error_rate); one rollup pass."""
    g = errors.withColumnRenamed(y, "label").rollup("label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg("is_error"), digits).alias("error_rate"),
        F.grouping("label").alias("_g"),
    )
    return g.select(
        F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.lit("class")).alias("scope"),
        "label", "n_rows", "error_rate",
    )


def top_misclassified(errors: DataFrame, y: str = "y", pred: str = "pred", k: int = 5) -> DataFrame:
    """Most frequent (true, predicted) error pairs; the top-k is the
    feature (TakeOrderedAndProject, no global sort)."""
    return (
        errors.filter(F.col("is_error") == 1)
        .groupBy(F.col(y).alias("true_label"), F.col(pred).alias("predicted_label"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("true_label"), F.asc("predicted_label"))
        .limit(k)
    )


def _stack(columns: list[str], value_type: str) -> Column:
    parts = ", ".join(f"'{c}', CAST(`{c}` AS {value_type})" for c in columns)
    return F.expr(f"stack({len(columns)}, {parts}) AS (feature, value)")


def column_kinds(df: DataFrame, columns: list[str], max_categories: int = 10) -> DataFrame:
    """Distinct count per column (0 if it holds nulls only) and kind
    (string, or fewer than 10 distinct values -> categorical).  Values are
    told apart by a 64-bit hash, so no text is shuffled, and repeated values
    meet in map-side partial aggregates."""
    string_cols = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    parts = ", ".join(f"'{c}', IF(`{c}` IS NULL, NULL, xxhash64(`{c}`))" for c in columns)
    stacked = df.select(F.expr(f"stack({len(columns)}, {parts}) AS (feature, value)"))
    counts = stacked.distinct().groupBy("feature").agg(F.count("value").alias("n_distinct"))
    is_string = F.col("feature").isin(*string_cols) if string_cols else F.lit(False)
    return counts.select(
        "feature", "n_distinct",
        F.when(is_string | (F.col("n_distinct") < max_categories), F.lit("categorical"))
        .otherwise(F.lit("numeric")).alias("kind"),
    )


def error_dist_categorical(errors: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per (feature, value, is_error) for categorical columns."""
    return errors.select("is_error", _stack(columns, "STRING")).groupBy("feature", "value", "is_error").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def error_dist_numeric(errors: DataFrame, columns: list[str], bins: int = 20, digits: int = 6) -> DataFrame:
    """Equal-width histogram per numeric feature, bins shared by the
    error and non-error rows, last bin closed.  All features in one pass:
    unpivot, per-feature min/max (one row per feature, broadcast), bin, count."""
    stacked = errors.select("is_error", _stack(columns, "DOUBLE")).filter(F.col("value").isNotNull())
    rng = stacked.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.col("hi") - F.col("lo")
    raw_bin = F.floor((F.col("value") - F.col("lo")) / width * bins)
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(raw_bin, F.lit(bins - 1))).cast("int")
    binned = stacked.join(F.broadcast(rng), "feature").select("feature", "is_error", "lo", "hi", b.alias("bin"))
    return binned.groupBy("feature", "bin", "is_error").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.first("lo") + F.col("bin") * (F.first("hi") - F.first("lo")) / bins, digits).alias("bin_start"),
    )


def metrics_long(metrics: DataFrame, model_col: str = "model",
                 names: tuple[str, ...] = ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "roc_auc")) -> DataFrame:
    """Metric rows (model, metric, value) for the JSON report."""
    parts = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in names)
    return metrics.select(model_col, F.expr(f"stack({len(names)}, {parts}) AS (metric, value)"))
