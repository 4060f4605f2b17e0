"""Models, grids, selections and clustering over line items and embeddings."""

import numpy as np
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from staywise.functions.codes import hash_unit
from staywise.operators import clusters, knn, lsh, models, split, trees
from workload.base import Tables, query, with_sales
from workload.preparation import FEATURES, KEYS, unit_sql

LABEL = "price"
DIMS = 64


def sales_parts(t: Tables, *more: str):
    """Training and test rows, label in thousands; ``more`` are further columns."""
    rows = t.sales.withColumn(LABEL, F.col("l_extendedprice") / 1000)
    parted = split.split_by_hash(rows, *KEYS).select(*FEATURES, LABEL, "p_type", *more, "part")
    return parted.filter(F.col("part") == "train"), parted.filter(F.col("part") == "test")


def embedded(t: Tables):
    """Embedding dimensions as columns and a binary label; the split follows the id."""
    dims = [F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(DIMS)]
    parted = split.split_by_hash(t.embeddings, "vec_id")
    rows = parted.select("vec_id", *dims, (F.col("label") >= 4).cast("double").alias("positive"), "part")
    return rows.filter(F.col("part") == "train"), rows.filter(F.col("part") == "test")


DIM_NAMES = [f"d{i}" for i in range(DIMS)]


@query(
    with_sales(
        "SELECT '(intercept)' AS feature, round_even(regr_intercept(l_extendedprice / 1000, l_quantity), 5) AS coefficient FROM sales "
        "UNION ALL SELECT 'l_quantity', round_even(regr_slope(l_extendedprice / 1000, l_quantity), 5) FROM sales"
    )
)
def fit_linear(t):
    rows = t.sales.select("l_quantity", (F.col("l_extendedprice") / 1000).alias(LABEL))
    model = models.fit_linear(rows, ["l_quantity"], LABEL)
    return models.coefficients(model, ["l_quantity"], rows).withColumn("coefficient", F.bround("coefficient", 5))


def grid_metrics(t, search):
    train, test = sales_parts(t)
    result = search(train, FEATURES, LABEL)
    return models.regression_metrics(result.predict(test), LABEL, "prediction")


@query()
def grid_robust_linear(t):
    return grid_metrics(t, models.grid_robust_linear)


@query()
def grid_logistic(t):
    train, test = embedded(t)
    result = models.grid_logistic(train, DIM_NAMES, "positive")
    return models.classifier_scores(result.predict(test), "positive")


@query()
def fit_linear_svc(t):
    train, test = embedded(t)
    model = models.fit_linear_svc(train, DIM_NAMES, "positive")
    return models.classifier_scores(model.transform(test), "positive")


@query()
def grid_rf_classifier(t):
    train, test = embedded(t)
    result = models.grid_rf_classifier(train, DIM_NAMES, "positive")
    return models.classifier_scores(result.predict(test), "positive")


@query()
def split_model(t):
    train, test = sales_parts(t)
    errors, rates = models.split_model(train, test, FEATURES, LABEL, 40.0)
    short = errors.select(F.lit("short_regression").alias("model"), F.col("n_rows"), F.col("rmse").alias("rmse"), F.lit(None).cast("double").alias("auc"))
    counted = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return short.unionByName(
        rates.select(F.lit("long_classifier").alias("model"), counted.alias("n_rows"), F.lit(None).cast("double").alias("rmse"), "auc")
    )


@query()
def model_scoreboard(t):
    train, test = sales_parts(t)
    candidates = {
        "linear": LinearRegression(labelCol=LABEL),
        "robust_linear": LinearRegression(labelCol=LABEL, loss="huber", maxIter=50),
        "random_forest": RandomForestRegressor(labelCol=LABEL, numTrees=10, seed=models.SEED),
        "gradient_boosting": GBTRegressor(labelCol=LABEL, maxIter=10, maxDepth=3, seed=models.SEED),
    }
    return models.scoreboard(train, test, FEATURES, LABEL, candidates)


@query()
def select_rf_importance(t):
    """Training rows with the three features that a forest finds most important (M8)."""
    train, _ = sales_parts(t, *KEYS)
    cuts = trees.cut_points(train, FEATURES, LABEL)
    rows = trees.binned(train, FEATURES, LABEL, KEYS, cuts).cache()
    grown = trees.grow(rows, [trees.Model(frozenset({0}), "squared", seed) for seed in range(10)], cuts, 5)
    rows.unpersist()
    ranked = sorted(trees.importances(grown, FEATURES), key=lambda f: (-f[1], f[0]))
    return train.select(*[f for f, _ in ranked[:3]], LABEL)


@query()
def select_random(t):
    train, _ = sales_parts(t)
    return train.select(*models.select_random(FEATURES, 3), LABEL)


@query()
def pca_variance(t):
    train, _ = embedded(t)
    return models.explained_variance(models.fit_pca(train, DIM_NAMES, 10), train)


@query()
def select_kmeans_silhouette(t):
    """Columns grown by the best silhouette of a 2-means clustering, all candidates of a step in shared passes."""
    train, _ = sales_parts(t, *KEYS)
    chosen = clusters.select_by_silhouette(train, FEATURES, "l_quantity", 3, KEYS, rounds=8, anchors=200)
    rows = [(i + 1, name, score, error) for i, (name, score, error) in enumerate(chosen)]
    return t.spark.createDataFrame(rows, "step int, feature string, silhouette double, std_error double")


@query()
def silhouette(t):
    """Euclidean silhouette of a 2-means clustering of the vectors."""
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return _two_means(rows)


def _two_means(rows):
    packed = rows.select(hash_unit("anchor", "vec_id").alias("u"), F.col("v").alias("x")).cache()
    starts = np.array([r["x"] for r in packed.orderBy("u", "x").limit(2).collect()])
    width = starts.shape[1]
    (centres,) = clusters.lloyd(packed, [tuple(range(width))], starts)

    def own(batch):
        x = clusters._points(batch)
        return [(clusters.nearest_centre(x, centres), x)]

    (found,) = clusters.silhouettes(packed, own, 1, 2)
    packed.unpersist()
    return rows.sparkSession.createDataFrame([(2, found.n_rows, found.score, found.error)], "clusters int, n_rows long, silhouette double, std_error double")


@query(
    "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), "
    "d AS (SELECT a.vec_id, a.label AS own, b.label AS other, avg(list_distance(a.e, b.e)) AS far FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3), "
    "s AS (SELECT vec_id, max(CASE WHEN own = other THEN far END) AS near, min(CASE WHEN own <> other THEN far END) AS away FROM d GROUP BY vec_id) "
    "SELECT count(*) AS n_rows, round_even(avg(coalesce((away - near) / greatest(away, near), 0)), 6) AS silhouette FROM s"
)
def silhouette_by_label(t):
    """Euclidean silhouette of the vectors grouped by their label."""
    found = clusters.silhouette_of(t.embeddings, F.col("embedding"), F.col("label"), ["vec_id"], None, anchors=None)
    out = t.spark.createDataFrame([(found.n_rows, found.score)], "n_rows long, silhouette double")
    return out.withColumn("silhouette", F.bround("silhouette", 6))


@query(
    f"WITH e AS (SELECT vec_id, label, embedding, {unit_sql('2', 'vec_id')} < 0.7 AS is_train FROM embeddings) "
    "SELECT vec_id, avg(label) AS prediction FROM ("
    "SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY "
    "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))), b.vec_id) AS rn "
    "FROM e a, e b WHERE NOT a.is_train AND b.is_train) q WHERE rn <= 5 GROUP BY vec_id"
)
def knn_regress(t):
    parted = split.split_by_hash(t.embeddings, "vec_id")
    train, test = parted.filter(F.col("part") == "train"), parted.filter(F.col("part") == "test")
    return knn.knn_regress(train, test, "vec_id", "embedding", "label", 5)


@query()
def knn_lsh(t):
    """The same by hashed buckets: recall of the sample's exact neighbours, tables and probes beside each prediction."""
    parted = split.split_by_hash(t.embeddings, "vec_id")
    train, test = parted.filter(F.col("part") == "train"), parted.filter(F.col("part") == "test")
    found = lsh.lsh_regress(train, test, "vec_id", "embedding", "label", 5)
    extra = {"recall": F.lit(found.recall), "tables": F.lit(found.tables), "probes": F.lit(found.probes)}
    return found.frame.withColumns(extra)
