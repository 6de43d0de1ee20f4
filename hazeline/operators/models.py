"""Model families on ``spark.ml``: fit, compare, select."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.operators.forests import Forest, HistogramForest
from hazeline.operators.metrics import error_columns
from hazeline.operators.supervised import FEATURE_COLUMNS, TARGET

BASELINE = "Persistence (baseline)"
SEED = 42

# The compared families and their settings.
RIDGE_ALPHA = 1.0
FOREST = {"numTrees": 120, "maxDepth": 16, "minInstancesPerNode": 10, "featureSubsetStrategy": "sqrt"}
BOOSTED = {
    "maxIter": 600,
    "stepSize": 0.05,
    "maxDepth": 8,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
}
BACKTEST_ROUNDS = 400
#: Rows that one task of a tree fit holds, about.
TREE_PART_ROWS = 500_000
#: Forests up to this depth are fitted by ``spark.ml``, which shuffles a histogram of every node.
SHALLOW_DEPTH = 10


def ridge_penalty(alpha: float, n: int, label_deviation: float, sample_scaled: bool = True) -> float:
    """``regParam`` that equals a penalty of ``alpha * |w|²`` on the summed squared error.

    ``LinearRegression`` penalises the mean error of a label divided by its deviation.
    ``StandardScaler`` divides by the sample deviation where the penalty is meant for the
    population deviation; ``sample_scaled`` makes up for it.
    """
    return alpha * ((n - 1) / n if sample_scaled else 1.0) * label_deviation / n


def scaling(features=FEATURE_COLUMNS) -> list:
    """Stages that fill missing inputs with their mean and standardise them."""
    filled = [f"{c}__filled" for c in features]
    return [
        Imputer(strategy="mean", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="assembled"),
        StandardScaler(inputCol="assembled", outputCol="features", withMean=True, withStd=True),
    ]


def ridge(train: DataFrame, features=FEATURE_COLUMNS, label: str = TARGET, alpha: float = RIDGE_ALPHA) -> Pipeline:
    """Standardised ridge for these training rows, which set the scale of its penalty."""
    n, sd = train.agg(F.count(label), F.stddev_pop(label)).first()
    return Pipeline(
        stages=[
            *scaling(features),
            LinearRegression(
                labelCol=label,
                regParam=ridge_penalty(alpha, n, sd or 0.0),
                elasticNetParam=0.0,
                standardization=False,
                solver="normal",
            ),
        ]
    )


class _TreePipeline(Pipeline):
    """A pipeline whose fit reads its input in parts of about ``TREE_PART_ROWS`` rows.

    Tree fits keep each part as objects, many times larger than the file it came from, so a part is
    bounded by rows. Files are split where they allow it: store large tables in files of such a size.
    """

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        conf, name = dataset.sparkSession.conf, "spark.sql.files.minPartitionNum"
        before = conf.get(name, None)
        parts = -(-dataset.count() // TREE_PART_ROWS)
        least = int(before) if before else dataset.sparkSession.sparkContext.defaultParallelism
        if parts <= least:
            return super()._fit(dataset)
        conf.set(name, str(parts))
        try:
            return super()._fit(dataset)
        finally:
            conf.set(name, before) if before else conf.unset(name)


def _trees(estimator, features) -> Pipeline:
    # a missing input stays missing (NaN) and takes the right branch at every split
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return _TreePipeline(stages=[assembler, estimator])


def forest(features=FEATURE_COLUMNS, label: str = TARGET, **settings) -> Pipeline | HistogramForest:
    """A random forest; deep trees are grown on histograms, a task a tree."""
    asked = {**FOREST, **settings}
    if asked["maxDepth"] > SHALLOW_DEPTH and asked.keys() == FOREST.keys() and asked["featureSubsetStrategy"] == "sqrt":
        return HistogramForest(features, label, seed=SEED, **asked)
    return _trees(RandomForestRegressor(labelCol=label, seed=SEED, **asked), features)


def boosted(features=FEATURE_COLUMNS, label: str = TARGET, **settings) -> Pipeline:
    return _trees(GBTRegressor(labelCol=label, seed=SEED, **{**BOOSTED, **settings}), features)


def numeric_inputs(rows: DataFrame, features=FEATURE_COLUMNS) -> DataFrame:
    """Model inputs as doubles; other columns stay."""
    return rows.withColumns({c: F.col(c).cast("double") for c in features if dict(rows.dtypes)[c] != "double"})


@dataclass
class Fitted:
    name: str
    model: PipelineModel | Forest

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a ``prediction`` column."""
        typed = rows.withColumn("_horizon", F.col("horizon")) if "horizon" in rows.columns else rows
        out = self.model.transform(numeric_inputs(typed))
        extra = [c for c in out.columns if c in ("assembled", "features") or c.endswith("__filled")]
        out = out.drop(*extra)
        return out.withColumn("horizon", F.col("_horizon")).drop("_horizon") if "_horizon" in out.columns else out


def fit_candidates(train: DataFrame, pipelines: dict[str, Pipeline]) -> dict[str, Fitted]:
    rows = numeric_inputs(train)
    return {name: Fitted(name, pipeline.fit(rows)) for name, pipeline in pipelines.items()}


def compare(valid: DataFrame, fitted: dict[str, Fitted]) -> DataFrame:
    """Error of every family and of persistence on the same rows, best first; one scan for all."""
    scored, names = valid.withColumn("_p0", F.col("aqi_anchor")), [BASELINE, *fitted]
    for i, model in enumerate(fitted.values(), 1):
        scored = model.predict(scored).withColumnRenamed("prediction", f"_p{i}")
    errors = scored.agg(
        *[F.struct(F.lit(name).alias("model"), *error_columns(TARGET, f"_p{i}")).alias(f"_e{i}") for i, name in enumerate(names)]
    )
    return errors.select(F.inline(F.array(*[f"_e{i}" for i in range(len(names))]))).orderBy("rmse")
