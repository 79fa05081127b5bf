"""Spark ML stages of our own (F12, T2) and the preparation block.

Both stages run JVM-side column expressions only; they are Python classes so
they are readable/writable with the default params persistence and fit in a
``Pipeline`` next to built-in stages.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.functions import features as FE
from ferrule.operators import ranking


class FeatureEngineer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """domain -> polynomial -> interactions -> powers, each switchable.
    Stateless: ``fit`` of the reference only remembered names."""

    domain = Param(Params._dummy(), "domain", "add the seven domain features", TypeConverters.toBoolean)
    polynomial = Param(Params._dummy(), "polynomial", "add degree-d monomials", TypeConverters.toBoolean)
    interactions = Param(Params._dummy(), "interactions", "add the four pair products", TypeConverters.toBoolean)
    powers = Param(Params._dummy(), "powers", "add square, cube, sqrt(|x|)", TypeConverters.toBoolean)
    degree = Param(Params._dummy(), "degree", "polynomial degree", TypeConverters.toInt)

    @keyword_only
    def __init__(self, domain=True, polynomial=False, interactions=True, powers=False, degree=2):
        super().__init__()
        self._setDefault(domain=True, polynomial=False, interactions=True, powers=False, degree=2)
        self._set(**self._input_kwargs)

    def _expanded(self) -> list[str]:
        """What the polynomial and power steps expand: sensors and domain
        features, never labels or flags that a table may also have."""
        return [*S.SENSORS, *(FE.domain_columns() if self.getOrDefault("domain") else [])]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return FE.engineer(
            dataset,
            numeric=self._expanded(),
            domain=self.getOrDefault("domain"),
            polynomial=self.getOrDefault("polynomial"),
            interactions=self.getOrDefault("interactions"),
            powers=self.getOrDefault("powers"),
            degree=self.getOrDefault("degree"),
        )

    def output_names(self, input_columns: list[str]) -> list[str]:
        """names this stage adds."""
        get = self.getOrDefault
        return FE.engineered_names(
            input_columns, get("domain"), get("interactions"), get("polynomial"), get("powers"), get("degree"), self._expanded()
        )


class _ScalerParams(HasInputCols, HasOutputCols):
    pass


class PopulationStandardScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """(x - centre) / scale per column; a zero scale divides by 1.

    ``method``: 'standard' (mean, *population* std), 'minmax' (min, max - min)
    or 'robust' (median, q3 - q1, exact).  Fit is one global aggregate, or the
    distributed quantiles of ``ranking``."""

    method = Param(Params._dummy(), "method", "standard, minmax or robust", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, method="standard"):
        super().__init__()
        self._setDefault(method="standard")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "PopulationStandardScalerModel":
        cols, method = self.getInputCols(), self.getOrDefault("method")
        if method == "robust":
            qs = ranking.exact_quantiles_multi(dataset, cols, [0.25, 0.5, 0.75])
            means = [float(qs[c][1] or 0.0) for c in cols]
            stds = [float((qs[c][2] or 0.0) - (qs[c][0] or 0.0)) for c in cols]
        elif method in ("standard", "minmax"):
            lo, hi = (F.avg, F.stddev_pop) if method == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
            row = dataset.agg(
                *[lo(c).alias(f"m{i}") for i, c in enumerate(cols)],
                *[hi(c).alias(f"s{i}") for i, c in enumerate(cols)],
            ).first()
            means = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
            stds = [float(row[f"s{i}"] or 0.0) for i in range(len(cols))]
        else:
            raise ValueError(f"unknown scaling {method}")
        return PopulationStandardScalerModel(
            inputCols=cols, outputCols=self.getOutputCols(), means=means, stds=stds
        )


class PopulationStandardScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "column means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population standard deviations", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols, outs = self.getInputCols(), self.getOutputCols()
        means, stds = self.getOrDefault("means"), self.getOrDefault("stds")
        exprs = [
            ((F.col(c) - F.lit(m)) / F.lit(s if s != 0 else 1.0)).alias(o)
            for c, o, m, s in zip(cols, outs, means, stds)
        ]
        return dataset.select("*", *exprs)


def preparation_stages(
    numeric: list[str],
    categorical: str = S.TYPE,
    features_col: str = "features",
    passthrough: list[str] | None = None,
    scaling: str = "standard",
    encoding: str = "onehot",
    label: str | None = None,
) -> list:
    """Encoded type (one-hot: categories sorted H, L, M; unknown
    -> all zero), scaled numerics, passthrough columns; assembled in that
    order.  ``scaling`` 'none' takes the numerics as they are."""
    encoded = {"onehot": f"{categorical}_ohe", "label": f"{categorical}_label", "target": f"{categorical}_target"}
    if scaling == "none":
        scaled, scalers = list(numeric), []
    else:
        scaled = [f"{c}_scaled" for c in numeric]
        scalers = [PopulationStandardScaler(inputCols=numeric, outputCols=scaled, method=scaling)]
    return [
        *encoding_stages(categorical, encoding, label),
        *scalers,
        VectorAssembler(
            inputCols=[encoded[encoding], *scaled, *(passthrough or [])],
            outputCol=features_col,
            handleInvalid="error",
        ),
    ]


def encoding_stages(column: str = S.TYPE, method: str = "onehot", label: str | None = None,
                    smoothing: float = 0.0) -> list:
    """C3: 'onehot' (T1), 'label' (index by sorted category, unknown -> k),
    'target' (per-category label mean, blended with the global mean by
    ``smoothing``; Spark's ``TargetEncoder``)."""
    if method == "onehot":
        return [
            StringIndexer(inputCol=column, outputCol=f"{column}_idx", stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{column}_idx"], outputCols=[f"{column}_ohe"], dropLast=True),
        ]
    idx = StringIndexer(inputCol=column, outputCol=f"{column}_label", stringOrderType="alphabetAsc",
                        handleInvalid="keep")
    if method == "label":
        return [idx]
    if method == "target":
        from pyspark.ml.feature import TargetEncoder

        if label is None:
            raise ValueError("target encoding needs the label column")
        return [idx, TargetEncoder(inputCols=[f"{column}_label"], outputCols=[f"{column}_target"],
                                   labelCol=label, targetType="binary", smoothing=smoothing,
                                   handleInvalid="keep")]
    raise ValueError(f"unknown encoding {method}")
