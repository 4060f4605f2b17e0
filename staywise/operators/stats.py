"""Counts, shares, distributions and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.functions.aggregates import correlation
from staywise.operators.quantiles import exact_quantiles
from staywise.operators.ranks import running_totals
from staywise.session import reliable_checkpoint


def long_form(wide: DataFrame, names: Sequence[str], key: str, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """One-row aggregate to one row per name: ``columns`` maps output name to prefix."""
    rows = [
        F.struct(F.lit(n).alias(key), *[F.col(f"{prefix}{n}").alias(out) for out, prefix in columns])
        for n in names
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def value_counts(df: DataFrame, column: str, name: str = "n_rows") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name)).orderBy(F.col(name).desc(), column)


def share_of_total(df: DataFrame, column: str, places: int = 2) -> DataFrame:
    """Count and percentage per value (A15); the total is a scalar over the counts."""
    counts = df.groupBy(column).agg(F.count("*").alias("n_rows"))
    total = counts.select(F.sum("n_rows")).scalar()
    return counts.withColumn("pct", F.bround(F.col("n_rows") * 100.0 / total, places))


def rate_by_bin(
    df: DataFrame, bin_: Column, measure: str, condition: Column, name: str = "bin", places: int = 2
) -> DataFrame:
    """Share of ``measure`` that meets the condition, per bin."""
    return df.groupBy(bin_.alias(name)).agg(
        F.coalesce(F.sum(F.when(condition, F.col(measure))), F.lit(0)).alias("n_hit"),
        F.sum(measure).alias("n_all"),
    ).withColumn("rate_pct", F.bround(F.col("n_hit") * 100.0 / F.nullif(F.col("n_all"), F.lit(0)), places))


def side_by_side_counts(df: DataFrame, left: str, right: str, name: str = "unit") -> DataFrame:
    """Counts and percentages of two columns next to each other, from one pass."""
    both = df.select(
        F.explode(
            F.array(
                F.struct(F.col(left).alias(name), F.lit(1).alias("l"), F.lit(0).alias("r")),
                F.struct(F.col(right).alias(name), F.lit(0).alias("l"), F.lit(1).alias("r")),
            )
        ).alias("x")
    ).select("x.*")
    counts = both.filter(F.col(name).isNotNull()).groupBy(name).agg(
        F.sum("l").alias("n_first"), F.sum("r").alias("n_last")
    )
    total = counts.select(F.struct(F.sum("n_first").alias("l"), F.sum("n_last").alias("r"))).scalar()
    return counts.withColumn("_t", total).select(
        name,
        "n_first",
        "n_last",
        F.bround(F.col("n_first") * 100.0 / F.col("_t.l"), 2).alias("first_pct"),
        F.bround(F.col("n_last") * 100.0 / F.col("_t.r"), 2).alias("last_pct"),
    )


def describe(df: DataFrame, columns: Sequence[str], places: int = 6) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles, max: one row per column."""
    moments = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"std_{c}") for c in columns],
        *[F.min(c).cast("double").alias(f"min_{c}") for c in columns],
        *[F.max(c).cast("double").alias(f"max_{c}") for c in columns],
    )
    prefixes = ["n", "mean", "std", "min", "max"]
    long = long_form(moments, columns, "column", [(p, f"{p}_") for p in prefixes])
    stacked = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
        ).alias("x")
    ).select("x.*")
    quartiles = exact_quantiles(stacked, "v", [0.25, 0.5, 0.75], ["q1", "q2", "q3"], by=["column"])
    rounded = ["mean", "std", "min", "q1", "q2", "q3", "max"]
    # one row per described column
    return long.join(F.broadcast(quartiles), "column", "left").select(
        "column", "n", *[F.bround(c, places).alias(c) for c in rounded]
    )


def basic_stats(df: DataFrame, column: str, places: int = 6) -> DataFrame:
    """mean, median, sample deviation, max of one column."""
    median = exact_quantiles(df, column, [0.5], ["median"]).select("median").scalar()
    return df.agg(
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.max(column).cast("double").alias("max")
    ).select(
        F.bround("mean", places).alias("mean"),
        F.bround(median, places).alias("median"),
        F.bround("std", places).alias("std"),
        F.bround("max", places).alias("max"),
    )


def box_summary(df: DataFrame, value: str, by: Sequence[str], places: int = 4) -> DataFrame:
    """Quartiles and whiskers (last points within 1.5 IQR of the box) per group."""
    quartiles = exact_quantiles(df, value, [0.25, 0.5, 0.75], ["q1", "q2", "q3"], by)
    spread = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread
    fenced = quartiles.select(
        *[F.col(c).alias(f"_b_{c}") for c in by], "q1", "q2", "q3", low.alias("_lo"), high.alias("_hi")
    )
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    inside = F.col(value).between(F.col("_lo"), F.col("_hi"))
    return (
        df.select(*by, value)
        .join(fenced, match)
        .groupBy(*by)
        .agg(
            F.count(value).alias("n_rows"),
            *[F.bround(F.max(q), places).alias(q) for q in ("q1", "q2", "q3")],
            F.bround(F.min(F.when(inside, F.col(value))), places).alias("whisker_low"),
            F.bround(F.max(F.when(inside, F.col(value))), places).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def histogram(df: DataFrame, value: Column, bins: int, name: str = "bin") -> DataFrame:
    """Equal-width counts between min and max; the last bin is closed on the right."""
    data = df.select(value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    ends = data.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).select(F.struct("lo", "hi")).scalar()
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    # all values equal: one bin holds them
    number = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_e.lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    )
    return (
        data.withColumn("_e", ends)
        .groupBy(number.cast("int").alias(name))
        .agg(F.count("*").alias("n_rows"), F.min("_v").alias("bin_min"), F.max("_v").alias("bin_max"))
    )


def pearson(df: DataFrame, a: str, b: str, by: Sequence[str] = (), places: int = 6, name: str = "pearson") -> DataFrame:
    return df.groupBy(*by).agg(F.bround(correlation(a, b), places).alias(name))


def spearman(df: DataFrame, a: str, b: str, places: int = 6, name: str = "spearman") -> DataFrame:
    """Rank correlation with averaged ties.

    Rows are reduced to distinct (a, b) pairs with a weight before ranking, and
    the correlation is taken from weighted sums.
    """
    pairs = (
        df.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
        .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        .groupBy("_a", "_b")
        .agg(F.count("*").cast("double").alias("_w"))
    )
    # read five times below, and far smaller than the rows it was counted from
    pairs = reliable_checkpoint(pairs)
    left = _weighted_ranks(pairs, "_a", "_ra")
    right = _weighted_ranks(pairs, "_b", "_rb")
    ranked = pairs.join(left, "_a").join(right, "_b")
    w, x, y = F.col("_w"), F.col("_ra"), F.col("_rb")
    sums = ranked.agg(
        F.sum(w).alias("n"),
        F.sum(w * x).alias("x"),
        F.sum(w * y).alias("y"),
        F.sum(w * x * x).alias("xx"),
        F.sum(w * y * y).alias("yy"),
        F.sum(w * x * y).alias("xy"),
    )
    spread = F.sqrt(F.expr("(xx - x * x / n) * (yy - y * y / n)"))
    return sums.select(F.bround(F.expr("xy - x * y / n") / F.nullif(spread, F.lit(0.0)), places).alias(name))


def correlation_summary(df: DataFrame, a: str, b: str, places: int = 6) -> DataFrame:
    """Rows, mean of ``a``, and both correlations of ``a`` with ``b``."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.bround(F.avg(a), places).alias("mean_trav"),
        F.bround(correlation(a, b), places).alias("pearson"),
    ).withColumn("spearman", spearman(df, a, b, places).scalar())


def _weighted_ranks(pairs: DataFrame, column: str, name: str) -> DataFrame:
    counts = pairs.groupBy(column).agg(F.sum("_w").alias("_n"))
    return running_totals(counts, column, ["_n"]).select(
        column, (F.col("_n_upto") - (F.col("_n") - 1) / F.lit(2.0)).alias(name)
    )


def corr_with_label(df: DataFrame, features: Sequence[str], label: str, places: int = 6) -> DataFrame:
    """Pearson correlation of every feature with the label, one pass."""
    wide = df.agg(*[F.bround(correlation(c, label), places).alias(f"r_{c}") for c in features])
    return long_form(wide, features, "feature", [("corr", "r_")])


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL and non-NULL counts per column, one pass."""
    wide = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns],
        *[F.count(c).alias(f"v_{c}") for c in columns],
    )
    return long_form(wide, columns, "column", [("n_null", "n_"), ("n_valid", "v_")])


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and duplicates beyond the first."""
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"))
    return per_key.agg(
        F.sum("_n").alias("n_rows"),
        F.count("*").alias("n_distinct"),
        (F.sum("_n") - F.count("*")).alias("n_duplicate"),
    )


def error_by_truth(df: DataFrame, truth: str, prediction: str, places: int = 4) -> DataFrame:
    """Spread of the rounded prediction per rounded truth."""
    rounded = df.select(
        F.bround(truth, 0).cast("bigint").alias("truth"), F.bround(prediction, 0).alias("pred")
    ).filter(F.col("truth").isNotNull())
    table = rounded.groupBy("truth").agg(
        F.avg("pred").alias("mean"),
        F.stddev_samp("pred").alias("std"),
        F.max("pred").alias("max"),
        F.min("pred").alias("min"),
        F.count("pred").alias("n_rows"),
    )
    medians = exact_quantiles(rounded, "pred", [0.5], ["median"], by=["truth"])
    return table.join(medians, "truth", "left").select(
        "truth",
        F.bround("mean", places).alias("mean"),
        F.bround("median", places).alias("median"),
        F.bround("std", places).alias("std"),
        "max",
        "min",
        "n_rows",
        F.bround(F.col("std") / F.sqrt("n_rows"), places).alias("std_error"),
        (F.col("max") - F.col("min")).alias("range"),
    )

