"""Forests and boosted trees over folds, criteria, losses and strata, grown level by level in shared passes."""

from pyspark.sql import functions as F

from staywise.operators import boosting, trees
from staywise.operators import least_squares as ls
from staywise.operators.metrics import regression_metrics
from workload.base import query, with_sales
from workload.modelling import LABEL, sales_parts
from workload.preparation import FEATURES, KEYS
from workload.regression import FOLDS, ROWS_SQL, strata_parts

SIZES = (1, 2, 3, 5, 10)


def _grid(train):
    return trees.grid_forest(train, FEATURES, LABEL, KEYS, ls.fold_of("fold", FOLDS, *KEYS), FOLDS, SIZES)


@query()
def grid_random_forest(t):
    """Test metrics of the best forest over criterion and number of trees."""
    train, test = sales_parts(t, *KEYS)
    predicted = trees.with_predictions(test.select(*FEATURES, LABEL), FEATURES, {"": _grid(train).forest})
    return regression_metrics(predicted, LABEL, "prediction")


@query()
def forest_scores(t):
    """Every criterion's and size's score on every fold."""
    train, _ = sales_parts(t, *KEYS)
    return _grid(train).frame(train)


@query()
def forest_absolute(t):
    """Test metrics of forests grown by the squared and by the absolute error."""
    train, test = sales_parts(t, *KEYS)
    cuts = trees.cut_points(train, FEATURES, LABEL)
    rows = trees.binned(train, FEATURES, LABEL, KEYS, cuts).cache()
    kinds = ("squared", "absolute")
    grown = trees.grow(rows, [trees.Model(frozenset({0}), c, seed) for c in kinds for seed in range(5)], cuts, 4)
    rows.unpersist()
    forests = {c: trees.Forest(tuple(grown[5 * i : 5 * i + 5]), cuts) for i, c in enumerate(kinds)}
    each = test.select(*FEATURES, LABEL, F.explode(F.array(*[F.lit(c) for c in kinds])).alias("criterion"))
    return regression_metrics(trees.with_predictions(each, FEATURES, forests, "criterion"), LABEL, "prediction", ["criterion"])


STUMP = ("l_discount", "l_tax", "p_size")


@query(
    with_sales(
        "SELECT feature, cut, round_even(whole - error, 4) AS gain, m AS value, left_value, right_value FROM ("
        "SELECT f, feature, cut, sum(abs(y - side_m)) AS error, max(CASE WHEN is_left THEN side_m END) AS left_value, "
        "max(CASE WHEN NOT is_left THEN side_m END) AS right_value FROM ("
        "SELECT f, feature, cut, y, x <= cut AS is_left, median(y) OVER (PARTITION BY f, cut, x <= cut) AS side_m FROM cuts JOIN c USING (f, feature)) s "
        "GROUP BY f, feature, cut) e, (SELECT m, sum(abs(l_quantity - m)) AS whole FROM train, (SELECT median(l_quantity) AS m FROM train) q GROUP BY m) w "
        "WHERE left_value IS NOT NULL AND right_value IS NOT NULL ORDER BY error, f, cut LIMIT 1",
        ROWS_SQL,
        "train AS (SELECT * FROM rows WHERE part = 'train')",
        "c AS (" + " UNION ALL ".join(f"SELECT {i} AS f, '{c}' AS feature, {c} AS x, l_quantity AS y FROM train" for i, c in enumerate(STUMP)) + ")",
        "cuts AS (SELECT DISTINCT f, feature, x AS cut FROM c)",
    )
)
def stump_absolute(t):
    """The one split that lowers the sum of absolute distances from the median most (R5's other criterion)."""
    train, _ = sales_parts(t, *KEYS)
    cuts = trees.value_cuts(train, STUMP, "l_quantity")
    (tree,) = trees.grow(trees.binned(train, STUMP, "l_quantity", KEYS, cuts), [trees.Model(frozenset({0}), "absolute")], cuts, 1)
    f = int(tree.feature[0])
    row = (STUMP[f], float(cuts.features[f][tree.bin[0]]), float(tree.gain[0]), *map(float, tree.value[:3]))
    out = t.spark.createDataFrame([row], "feature string, cut double, gain double, value double, left_value double, right_value double")
    return out.withColumn("gain", F.bround("gain", 4))


@query()
def feature_importance(t):
    """Importance of each feature in a forest."""
    train, _ = sales_parts(t, *KEYS)
    cuts = trees.cut_points(train, FEATURES, LABEL)
    rows = trees.binned(train, FEATURES, LABEL, KEYS, cuts).cache()
    grown = trees.grow(rows, [trees.Model(frozenset({0}), "squared", seed) for seed in range(10)], cuts, 5)
    rows.unpersist()
    return t.spark.createDataFrame(trees.importances(grown, FEATURES), "feature string, importance double")


@query()
def submodel_metrics(t):
    """A forest per stratum, all other rows included, grown in shared passes; test metrics per stratum."""
    train, test = strata_parts(t)
    names = sorted({r["stratum"] for r in train.select("stratum").distinct().collect()})
    forests = trees.strata_forests(train, FEATURES, LABEL, KEYS, "stratum", names, trees=5)
    predicted = trees.with_predictions(test.select(*FEATURES, LABEL, "stratum"), FEATURES, forests, "stratum")
    return regression_metrics(predicted.filter("prediction is not null"), LABEL, "prediction", ["stratum"])


def _boosted(train):
    fold = ls.fold_of("fold", FOLDS, *KEYS)
    return boosting.grid_boost(train, FEATURES, LABEL, KEYS, fold, FOLDS, rounds=5, depth=3, rate=0.3)


@query()
def grid_gbt(t):
    """Test metrics of the boosted model whose loss scores best over the folds."""
    train, test = sales_parts(t, *KEYS)
    grid = _boosted(train)
    predicted = trees.with_predictions(test.select(*FEATURES, LABEL), FEATURES, {"": grid.models[grid.best]})
    return regression_metrics(predicted, LABEL, "prediction")


@query()
def boost_scores(t):
    """Every loss's score on every fold."""
    train, _ = sales_parts(t, *KEYS)
    return _boosted(train).frame(train)


@query()
def boost_trace(t):
    """Mean training loss after each round, for squared, absolute, huber and quantile loss."""
    train, _ = sales_parts(t, *KEYS)
    out = t.spark.createDataFrame(_boosted(train).trace, "loss string, round int, train_loss double")
    return out.withColumn("train_loss", F.bround("train_loss", 6))
