"""Regressors and classifiers on Spark ML: grids, sub-models, scoreboards."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from staywise.operators.metrics import classification_metrics, regression_metrics, roc_auc

SEED = 2
FOLDS = 3


@dataclass(frozen=True)
class GridResult:
    """Best fitted model, the mean fold score of every parameter set, and which one won."""

    model: PipelineModel
    scores: DataFrame
    best: Mapping[str, object]

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def assembled(features: Sequence[str], scale: bool = True) -> list[Estimator]:
    """Feature vector, standardised on the rows it is fitted on; rows with NULLs are left out."""
    raw = "raw_features" if scale else "features"
    stages: list[Estimator] = [VectorAssembler(inputCols=list(features), outputCol=raw, handleInvalid="skip")]
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol="features", withMean=True, withStd=True))
    return stages


def _params(params: Mapping) -> dict[str, object]:
    return {p.name: v for p, v in params.items()}


def grid_search(
    train: DataFrame,
    features: Sequence[str],
    estimator: Estimator,
    grid: Mapping[str, Sequence[object]],
    evaluator,
    folds: int = FOLDS,
    parallelism: int = 4,
    scale: bool = True,
) -> GridResult:
    """Cross-validated search over every combination in ``grid``.

    The vectors are assembled and scaled once and kept on disk and in memory for
    the many fits; a lost executor only costs its own blocks.
    """
    preparation = Pipeline(stages=assembled(features, scale)).fit(train)
    vectors = preparation.transform(train).select("features", estimator.getOrDefault("labelCol"))
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        builder = ParamGridBuilder()
        for name, values in grid.items():
            builder = builder.addGrid(estimator.getParam(name), list(values))
        search = CrossValidator(
            estimator=estimator,
            estimatorParamMaps=builder.build(),
            evaluator=evaluator,
            numFolds=folds,
            parallelism=parallelism,
            seed=SEED,
        )
        fitted = search.fit(vectors)
    finally:
        vectors.unpersist()
    tried = [_params(m) for m in search.getEstimatorParamMaps()]
    averages = fitted.avgMetrics
    pick = max if evaluator.isLargerBetter() else min
    winner = averages.index(pick(averages))
    rows = [
        (", ".join(f"{k}={v}" for k, v in sorted(p.items())), float(a), int(i == winner))
        for i, (p, a) in enumerate(zip(tried, averages))
    ]
    scores = train.sparkSession.createDataFrame(rows, "params string, mean_score double, best int")
    model = PipelineModel(stages=[*preparation.stages, fitted.bestModel])
    return GridResult(model, scores, tried[winner])


def _r2(label: str) -> RegressionEvaluator:
    return RegressionEvaluator(labelCol=label, metricName="r2")


def grid_linear(train: DataFrame, features: Sequence[str], label: str, **options) -> GridResult:
    """Least squares with and without intercept and normalisation (R2)."""
    grid = {"fitIntercept": [True, False], "standardization": [True, False]}
    return grid_search(train, features, LinearRegression(labelCol=label), grid, _r2(label), **options)


def grid_robust_linear(train: DataFrame, features: Sequence[str], label: str, **options) -> GridResult:
    """Huber-loss linear regression in place of a linear-kernel support vector regression."""
    model = LinearRegression(labelCol=label, loss="huber", solver="l-bfgs", maxIter=50)
    grid = {"epsilon": [1.1, 1.35], "regParam": [0.0, 0.01]}
    return grid_search(train, features, model, grid, _r2(label), **options)


def grid_random_forest(
    train: DataFrame, features: Sequence[str], label: str, trees: Sequence[int] = (1, 3, 5, 10), depth: int = 5, **options
) -> GridResult:
    """Forest regression over the number of trees."""
    model = RandomForestRegressor(labelCol=label, seed=SEED, maxDepth=depth)
    return grid_search(train, features, model, {"numTrees": trees}, _r2(label), **options)


def grid_gbt(
    train: DataFrame, features: Sequence[str], label: str, rounds: int = 20, depth: int = 3, **options
) -> GridResult:
    """Gradient boosting over the squared and absolute loss."""
    model = GBTRegressor(labelCol=label, seed=SEED, maxIter=rounds, maxDepth=depth)
    return grid_search(train, features, model, {"lossType": ["squared", "absolute"]}, _r2(label), **options)


def _auc(label: str) -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")


def grid_logistic(
    train: DataFrame, features: Sequence[str], label: str, costs: Sequence[float] = (0.01, 1.0, 100.0), **options
) -> GridResult:
    """Logistic regression over cost, intercept and penalty; cost C is ``regParam = 1 / (C n)``."""
    n = max(train.count(), 1)
    model = LogisticRegression(labelCol=label, maxIter=50)
    grid = {
        "regParam": [1.0 / (c * n) for c in costs],
        "fitIntercept": [True, False],
        "elasticNetParam": [0.0, 1.0],
    }
    return grid_search(train, features, model, grid, _auc(label), **options)


def grid_rf_classifier(
    train: DataFrame, features: Sequence[str], label: str, trees: Sequence[int] = (5, 10), **options
) -> GridResult:
    """Forest classifier over trees, impurity and features per split."""
    model = RandomForestClassifier(labelCol=label, seed=SEED)
    grid = {"numTrees": trees, "impurity": ["gini", "entropy"], "featureSubsetStrategy": ["sqrt", "all"]}
    return grid_search(train, features, model, grid, _auc(label), **options)


def fit(train: DataFrame, features: Sequence[str], estimator: Estimator, scale: bool = True) -> PipelineModel:
    return Pipeline(stages=[*assembled(features, scale), estimator]).fit(train)


def fit_linear(train: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Plain least squares."""
    return fit(train, features, LinearRegression(labelCol=label, regParam=0.0), scale=False)


def fit_linear_svc(train: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Linear support vector classifier."""
    return fit(train, features, LinearSVC(labelCol=label, maxIter=50, regParam=0.01))


def coefficients(model: PipelineModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """Intercept and one coefficient per feature as rows."""
    last = model.stages[-1]
    rows = [("(intercept)", float(last.intercept)), *[(f, float(c)) for f, c in zip(features, last.coefficients)]]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def feature_importance(model: PipelineModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """Importance of each feature of a tree model."""
    rows = [(f, float(v)) for f, v in zip(features, model.stages[-1].featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def classifier_scores(predicted: DataFrame, label: str) -> DataFrame:
    """All classification metrics and the exact AUC of one prediction frame.

    The score is the raw decision value, so classifiers without probabilities fit too.
    """
    scored = predicted.select(
        F.col(label).cast("int").alias("label"),
        F.col("prediction").cast("int").alias("guess"),
        F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("score"),
    )
    return classification_metrics(scored, "label", "guess").withColumn(
        "auc", roc_auc(scored, "label", "score").select("auc").scalar()
    )


def scoreboard(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, models: Mapping[str, Estimator]
) -> DataFrame:
    """Test metrics, one row per model.

    Both sides are read once: all models are fitted on the same standardised rows, and the test rows are kept with the
    predictions of all of them, so that the passes of the metrics neither join nor predict anew.
    """
    train = train.select(*features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        preparation = Pipeline(stages=assembled(features)).fit(train)
        vectors = preparation.transform(train).select("features", label)
        fitted = [estimator.fit(vectors) for estimator in models.values()]
    finally:
        train.unpersist()
    scored, guesses = preparation.transform(test.select(*features, label)).select("features", label), []
    for i, (name, model) in enumerate(zip(models, fitted)):
        scored = model.transform(scored).withColumnRenamed("prediction", f"_p{i}")
        guesses.append(F.struct(F.lit(name).alias("model"), F.col(f"_p{i}").alias("prediction")))
    scored = scored.drop("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        each = scored.select(label, F.inline(F.array(*guesses)))
        metrics = regression_metrics(each, label, "prediction", ["model"])
        metrics = metrics.select(*[c for c in metrics.columns if c != "model"], "model")
        found = {r["model"]: r for r in metrics.collect()}
    finally:
        scored.unpersist()
    # without test rows a model still has its row
    none = (0, *[None] * (len(metrics.columns) - 2))
    return test.sparkSession.createDataFrame([found.get(name, (*none, name)) for name in models], metrics.schema)


def submodels(
    train: DataFrame,
    test: DataFrame,
    group: str,
    names: Sequence[str],
    features: Sequence[str],
    label: str,
    make: Callable[[], Estimator],
) -> DataFrame:
    """One model per group and its test metrics, one row per group.

    ``names`` are the strata, a fixed short list. Groups without rows to fit or
    score are skipped.
    """
    train = train.select(group, *features, label).filter(F.col(group).isin(*names))
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    out = None
    try:
        have = {r[group] for r in train.select(group).distinct().collect()}
        for name in [n for n in names if n in have]:
            fitted = fit(train.filter(F.col(group) == name), features, make())
            part = fitted.transform(test.filter(F.col(group) == name))
            row = regression_metrics(part, label, "prediction").withColumn(group, F.lit(name))
            out = row if out is None else out.unionByName(row)
    finally:
        train.unpersist()
    return out


def split_model(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, threshold: float
) -> tuple[DataFrame, DataFrame]:
    """Short labels by regression, long ones by classification (R12): two metric frames of one row.

    Both sides are made once and kept for the many passes, which would each join, and broadcast, anew.
    """
    short = F.col(label) <= threshold
    train, test = (rows.select(*features, label).persist(StorageLevel.MEMORY_AND_DISK) for rows in (train, test))
    try:
        regressor = fit(train.filter(short), features, LinearRegression(labelCol=label))
        errors = regression_metrics(regressor.transform(test.filter(short)), label, "prediction")
        flag = (~short).cast("double").alias("is_long")
        classifier = fit(train.select("*", flag), features, LogisticRegression(labelCol="is_long", maxIter=50))
        rates = classifier_scores(classifier.transform(test.select("*", flag)), "is_long")
        errors, rates = (train.sparkSession.createDataFrame(f.collect(), f.schema) for f in (errors, rates))
    finally:
        train.unpersist()
        test.unpersist()
    return errors, rates


# --- feature selection -------------------------------------------------------


def select_rf_importance(
    train: DataFrame, features: Sequence[str], label: str, k: int, trees: int = 10
) -> list[str]:
    """The ``k`` features a forest finds most important (M8)."""
    model = fit(train, features, RandomForestRegressor(labelCol=label, numTrees=trees, seed=SEED))
    values = model.stages[-1].featureImportances.toArray()
    return [f for _, f in sorted(zip(-values, features))][:k]


def select_random(features: Sequence[str], k: int, seed: int = SEED) -> list[str]:
    """``k`` features chosen by a seeded draw, in their original order (M9)."""
    chosen = set(random.Random(seed).sample(range(len(features)), k))
    return [f for i, f in enumerate(features) if i in chosen]


def fit_pca(train: DataFrame, features: Sequence[str], k: int) -> PipelineModel:
    """Principal components of the standardised features."""
    return fit(train, features, PCA(k=k, inputCol="features", outputCol="components"))


def explained_variance(model: PipelineModel, df: DataFrame) -> DataFrame:
    rows = [(i + 1, float(v)) for i, v in enumerate(model.stages[-1].explainedVariance.toArray())]
    return df.sparkSession.createDataFrame(rows, "component int, explained double")


def silhouette(df: DataFrame, features: Sequence[str], k: int = 2, scale: bool = False) -> float:
    """Silhouette (squared Euclidean) of a k-means clustering."""
    prepared = Pipeline(stages=assembled(features, scale)).fit(df).transform(df).select("features")
    clustered = KMeans(k=k, seed=SEED).fit(prepared).transform(prepared)
    return ClusteringEvaluator().evaluate(clustered)


def select_kmeans_silhouette(
    train: DataFrame, features: Sequence[str], start: str, k: int, clusters: int = 2
) -> list[tuple[str, float]]:
    """Grow the feature set by whichever feature gives the best silhouette.

    Every candidate of every round is tried. Columns are standardised once and kept.
    """
    from staywise.operators.scaling import scale_standard

    plain = train.select(*features).na.drop()
    data = scale_standard(plain, plain, features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        chosen = [(start, float("nan"))]
        while len(chosen) < min(k, len(features)):
            names = [n for n, _ in chosen]
            rest = [f for f in features if f not in names]
            scored = [(silhouette(data, [*names, f], clusters), f) for f in rest]
            best, name = max(scored)
            chosen.append((name, best))
        return chosen
    finally:
        data.unpersist()

