"""Feature selection (C4): univariate F-test / chi-squared via Spark's
``UnivariateFeatureSelector``, and recursive elimination on tree importance or
on a linear model.
Selection returns names read from the assembler metadata."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import UnivariateFeatureSelector
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.ml import boost as BO
from ferrule.ml.train import slot_names

ELIMINATION = BO.Settings(n_estimators=10, max_depth=3, subsample=1.0, colsample_bytree=1.0)


def anova_f(prepared: DataFrame, label: str, features_col: str = "features") -> DataFrame:
    """ANOVA F statistic of every vector slot against the class label:
    (feature, f_value), from two small aggregates over the exploded slots
    (per slot and class, then per slot)."""
    names = slot_names(prepared, features_col)
    long = prepared.select(F.col(label).alias("y"), F.posexplode(vector_to_array(features_col)).alias("i", "x"))
    g = long.groupBy("i", "y").agg(F.count(F.lit(1)).alias("ng"), F.avg("x").alias("mg"),
                                   F.sum(F.col("x") * F.col("x")).alias("s2"))
    a = g.groupBy("i").agg(
        F.sum("ng").alias("n"), (F.sum(F.col("ng") * F.col("mg")) / F.sum("ng")).alias("m"),
        F.count(F.lit(1)).alias("k"), F.sum(F.col("ng") * F.col("mg") * F.col("mg")).alias("sb2"),
        F.sum("s2").alias("ss"),
    )
    between = (F.col("sb2") - F.col("n") * F.col("m") * F.col("m")) / (F.col("k") - 1)
    within = (F.col("ss") - F.col("sb2")) / (F.col("n") - F.col("k"))
    lookup = F.create_map(*[x for i, nm in enumerate(names) for x in (F.lit(i), F.lit(nm))])
    return a.select(lookup[F.col("i")].alias("feature"), F.try_divide(between, within).alias("f_value"))


def top_f(prepared: DataFrame, label: str, n: int = 5, features_col: str = "features") -> DataFrame:
    """The n slots with the highest F, as a DataFrame (no driver round trip)."""
    return anova_f(prepared, label, features_col).orderBy(F.desc_nulls_last("f_value"), "feature").limit(n)


def chi_squared(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Chi-squared of non-negative columns against the class: the sums of each
    column per class against those that the classes' sizes would give; (feature,
    chi2) from one aggregate of one row a class.  Null where a column sums to 0
    or holds a negative value; nulls count as 0, rows of null label not at all."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    per_class = df.filter(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(value(c)).alias(f"_s{i}") for i, c in enumerate(columns)],
        *[F.min(value(c)).alias(f"_m{i}") for i, c in enumerate(columns)])
    parts = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"_s{i}").alias("seen"), F.col(f"_m{i}").alias("least")) for i, c in enumerate(columns)]))
    rows = per_class.select("n", parts.alias("x")).select("n", "x.*")
    # sum (o - e)^2 / e with e = n / N * S is N / S * sum(o^2 / n) - S
    return rows.groupBy("feature").agg(
        F.when(F.min("least") >= 0, F.try_divide(F.sum("n") * F.sum(F.col("seen") * F.col("seen") / F.col("n")), F.sum("seen"))
               - F.sum("seen")).alias("chi2"))


def univariate(prepared: DataFrame, label: str, n: int = 5, method: str = "f_test",
               features_col: str = "features") -> list[str]:
    """'f_test': the n slots with the highest ANOVA F (ranked by the
    statistic itself, as SelectKBest does; p-values underflow to 0 and would
    tie); 'chi2': Spark's chi-squared selector (values taken as categories)."""
    if method == "f_test":
        rows = top_f(prepared, label, n, features_col).collect()
        return [r["feature"] for r in rows]
    feature_type = {"f_test": "continuous", "chi2": "categorical"}[method]
    sel = UnivariateFeatureSelector(
        featuresCol=features_col, labelCol=label, outputCol="selected",
        selectionMode="numTopFeatures",
    ).setFeatureType(feature_type).setLabelType("categorical").setSelectionThreshold(n)
    model = sel.fit(prepared)
    names = slot_names(prepared, features_col)
    return [names[i] for i in model.selectedFeatures]


def recursive_elimination(prepared: DataFrame, label: str, n: int = 5, step: int = 1,
                          features_col: str = "features") -> list[str]:
    """'rfe': fit a logistic regression, drop the ``step`` slots with the
    smallest |coefficient|, repeat until ``n`` remain.  Each round is a
    distributed fit; the driver only compares d coefficients."""
    from pyspark.ml.feature import VectorSlicer

    names = slot_names(prepared, features_col)
    keep = list(range(len(names)))
    data = prepared.select(label, features_col).persist()
    try:
        while len(keep) > n:
            sliced = VectorSlicer(inputCol=features_col, outputCol="_sel", indices=keep).transform(data)
            lr = LogisticRegression(featuresCol="_sel", labelCol=label, maxIter=100, tol=1e-4)
            coef = [abs(c) for c in lr.fit(sliced).coefficients.toArray()]
            drop = sorted(range(len(keep)), key=lambda i: (coef[i], i))[: min(step, len(keep) - n)]
            keep = [k for i, k in enumerate(keep) if i not in set(drop)]
    finally:
        data.unpersist()
    return [names[i] for i in keep]


def tree_elimination(prepared: DataFrame, label: str, n: int = 5, step: int = 1, settings: BO.Settings = ELIMINATION,
                     features_col: str = "features") -> DataFrame:
    """'rfe' on tree importance: boosted trees are fitted, the ``step`` slots of
    least importance go (ties: the later slot first), until ``n`` remain.  All
    rounds share the binned rows.  One row per slot: feature, ``round`` in which
    it went (null: it stays), and its importance then or, if it stays, in the
    last fit."""
    if n < 1 or step < 1:
        raise ValueError("n and step are 1 at least")
    cuts = BO.edges(prepared, features_col)
    names = slot_names(prepared, features_col) or [f"slot_{i}" for i in range(len(cuts))]
    table = BO.blocks(prepared, cuts, label, features_col)
    keep, rows, round_ = list(range(len(names))), [], 0
    while True:
        trees = BO.fit_many(table, cuts, [replace(settings, columns=tuple(keep))])[0]
        weight = BO.BoostedTreesModel.of(trees, cuts, features_col).featureImportances.toArray()
        if len(keep) <= n:
            break
        round_ += 1
        out = sorted(keep, key=lambda i: (weight[i], -i))[: min(step, len(keep) - n)]
        rows += [(names[i], round_, float(weight[i])) for i in out]
        keep = [i for i in keep if i not in set(out)]
    rows += [(names[i], None, float(weight[i])) for i in keep]
    return prepared.sparkSession.createDataFrame(rows, "feature string, round int, importance double")
