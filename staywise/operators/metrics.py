"""Regression and classification metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.operators.quantiles import exact_quantiles
from staywise.operators.ranks import running_totals
from staywise.session import reliable_checkpoint


def _match(by: Sequence[str]) -> Column:
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return match


def regression_metrics(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = (), places: int = 4, median: bool = True
) -> DataFrame:
    """RMSE, mean and median absolute error, R2 and the row count.

    R2 uses the variance identity, so one pass gives everything but the median.
    """
    error = F.col(label) - F.col(prediction)
    wide = df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.bround(F.sqrt(F.avg(error * error)), places).alias("rmse"),
        F.bround(F.avg(F.abs(error)), places).alias("mean_abs_error"),
        F.bround(
            1 - F.avg(error * error) / F.nullif(F.var_pop(label), F.lit(0.0)), places
        ).alias("r2"),
    )
    if not median:
        return wide
    mid = exact_quantiles(df, F.abs(error), [0.5], ["_median"], by)
    rounded = F.bround("_median", places).alias("median_abs_error")
    if not by:
        return wide.withColumn("median_abs_error", F.bround(mid.select("_median").scalar(), places))
    keyed = mid.select(*[F.col(c).alias(f"_b_{c}") for c in by], rounded)
    return wide.join(keyed, _match(by), "left").drop(*[f"_b_{c}" for c in by])


def prediction_range(df: DataFrame, label: str, prediction: str, places: int = 4) -> DataFrame:
    """[min, max] of label and prediction (E5)."""
    return df.agg(
        *[
            F.bround(f(c), places).alias(f"{n}_{s}")
            for c, n in ((label, "label"), (prediction, "pred"))
            for f, s in ((F.min, "min"), (F.max, "max"))
        ]
    )


def classification_metrics(
    df: DataFrame, label: str, predicted: str, by: Sequence[str] = (), places: int = 6
) -> DataFrame:
    """Confusion counts and the rates derived from them; an empty class gives NULL."""
    truth, guess = F.col(label) == 1, F.col(predicted) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(~truth & ~guess).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.bround(top / F.nullif(bottom, F.lit(0.0)), places)

    return counts.select(
        "*",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fn).alias("sensitivity"),
        ratio(tn, tn + fp).alias("specificity"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """Cumulative counts and rates at every distinct score, highest first."""
    per_score = (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(score).alias("threshold"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    )
    # one row per distinct score; read by the cut, the walk and the totals
    per_score = reliable_checkpoint(per_score)
    walked = running_totals(per_score, "threshold", ["pos", "neg"], descending=True)
    total = per_score.select(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    zero = F.lit(0.0)
    return walked.withColumn("_t", total).select(
        "threshold",
        "pos",
        "neg",
        F.col("pos_upto").alias("tp"),
        F.col("neg_upto").alias("fp"),
        (F.col("pos_upto") / F.nullif(F.col("_t.p").cast("double"), zero)).alias("tpr"),
        (F.col("neg_upto") / F.nullif(F.col("_t.n").cast("double"), zero)).alias("fpr"),
    )


def roc_auc(df: DataFrame, label: str, score: str, places: int = 6) -> DataFrame:
    """Exact area under the ROC curve by trapezoids; one class only gives NULL."""
    points = roc_points(df, label, score)
    # each step adds neg * (tp before + tp after) / 2 to the unscaled area
    return points.agg(
        F.bround(
            F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0)
            / F.nullif(F.sum("pos") * F.sum("neg").cast("double"), F.lit(0.0)),
            places,
        ).alias("auc"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )
