"""Univariate feature scores and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.functions.aggregates import correlation
from staywise.functions.tails import chi2_tail, chi2_tail_even, f_tail
from staywise.operators.stats import long_form


def _non_negative(c: str) -> Column:
    error = F.raise_error(F.lit(f"{c}: negative value")).cast("double")
    return F.when(F.col(c) < 0, error).otherwise(F.col(c).cast("double"))


def score_chi2(df: DataFrame, features: Sequence[str], label: str, places: int = 6) -> DataFrame:
    """Chi-squared of feature sums per class against their expectation (M6).

    Features must be non-negative. Rows are reduced to one per class first.
    """
    per_class = df.groupBy(label).agg(
        F.count("*").alias("n"),
        *[F.sum(_non_negative(c)).alias(f"s_{c}") for c in features],
    )
    totals = per_class.agg(F.sum("n").alias("n"), *[F.sum(f"s_{c}").alias(f"s_{c}") for c in features])
    joined = per_class.withColumn("_t", totals.select(F.struct("*").alias("t")).scalar())

    def term(c: str) -> Column:
        expected = F.col("n") / F.col("_t.n") * F.col("_t")[f"s_{c}"]
        return (F.col(f"s_{c}") - expected) * (F.col(f"s_{c}") - expected) / F.nullif(expected, F.lit(0.0))

    wide = joined.agg(*[F.bround(F.sum(term(c)), places).alias(f"x_{c}") for c in features])
    return long_form(wide, features, "feature", [("score", "x_")])


def score_f_regression(df: DataFrame, features: Sequence[str], label: str, places: int | None = 6) -> DataFrame:
    """F value of each feature against the label, one pass (M7).

    A constant feature scores NULL; a perfectly correlated one scores infinity.
    """
    wide = df.agg(
        F.count("*").alias("n"),
        *[correlation(c, label).alias(f"r_{c}") for c in features],
    )

    def score(c: str) -> Column:
        r2 = F.col(f"r_{c}") * F.col(f"r_{c}")
        flat = F.col(f"r_{c}").isNull() | F.isnan(f"r_{c}")
        value = F.when(flat, F.lit(None).cast("double")).when(
            r2 >= 1 - 1e-12, F.lit(float("inf"))
        ).otherwise(r2 / F.nullif(1 - r2, F.lit(0.0)) * (F.col("n") - 2))
        if places is not None:
            value = F.when(value == float("inf"), value).otherwise(F.bround(value, places))
        return value.alias(f"f_{c}")

    return long_form(wide.select(*[score(c) for c in features]), features, "feature", [("score", "f_")])


def with_f_p_values(scores: DataFrame, rows: DataFrame) -> DataFrame:
    """Add the p-value of each F score over ``rows``."""
    n = rows.agg(F.count("*").cast("double").alias("n")).scalar()
    return scores.withColumn("_d", n - 2).withColumn("p_value", f_tail("score", "_d")).drop("_d")


def with_chi2_p_values(scores: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """Add the p-value of each chi-squared score; one degree of freedom less than there are classes."""
    freedom = rows.agg(F.count_distinct(label)).first()[0] - 1
    if freedom >= 2 and freedom % 2 == 0:
        return scores.withColumn("p_value", chi2_tail_even(F.col("score"), freedom))
    return scores.withColumn("_d", F.lit(float(freedom))).withColumn("p_value", chi2_tail("score", "_d")).drop("_d")


def top_features(scores: DataFrame, k: int) -> list[str]:
    """Names of the ``k`` best scored features; NULL scores are dropped, ties go by name."""
    best = scores.filter(F.col("score").isNotNull()).orderBy(F.col("score").desc(), "feature").limit(k)
    return [row["feature"] for row in best.collect()]


def selection(scores: DataFrame, k: int) -> DataFrame:
    """Scores with their rank and whether the feature is among the ``k`` best; NULL scores rank last and are never kept.

    There is one row per feature, so all of them fit an array.
    """
    place = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("down"), F.col("feature").alias("feature"), F.struct("*").alias("row"))
    ranked = scores.agg(F.array_sort(F.collect_list(place)).alias("all")).select(F.posexplode("all").alias("at", "p"))
    rank = F.col("at") + 1
    return ranked.select("p.row.*", rank.alias("rank"), ((rank <= k) & ~F.col("p.none")).cast("int").alias("kept"))


def reduced(df: DataFrame, features: Sequence[str], chosen: Sequence[str]) -> DataFrame:
    """``df`` without the features that were not chosen; all other columns stay, the chosen ones in the given order."""
    return df.select(*[c for c in df.columns if c not in features or c in chosen])


def score_variance(df: DataFrame, features: Sequence[str], threshold: float, places: int = 6) -> DataFrame:
    """Population variance per feature and whether it exceeds the threshold."""
    wide = df.agg(*[F.var_pop(c).alias(f"v_{c}") for c in features])
    table = long_form(wide, features, "feature", [("variance", "v_")])
    return table.select(
        "feature", F.bround("variance", places).alias("variance"), (F.col("variance") > threshold).cast("int").alias("kept")
    )

