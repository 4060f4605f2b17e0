"""Splits, scaling, scores and resampling."""

import math

from pyspark.sql import functions as F

from staywise.operators import resample, scaling, scores, split
from workload.base import ORACLES, Tables, query, with_sales

FEATURES = ("l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice")
KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
KEYS_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def unit_sql(seed: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0"


PART_SQL = f"CASE WHEN {unit_sql('2', *KEYS)} < 0.7 THEN 'train' ELSE 'test' END"
PARTED_SQL = f"parted AS (SELECT *, {PART_SQL} AS part FROM sales), train AS (SELECT * FROM parted WHERE part = 'train')"


def parted(t: Tables):
    return split.split_by_hash(t.sales, *KEYS)


def train_rows(t: Tables):
    return parted(t).filter(F.col("part") == "train")


@query(f"SELECT {KEYS_SQL}, {PART_SQL} AS part FROM lineitem")
def split_hash(t):
    return split.split_by_hash(t.lineitem.select(*KEYS), *KEYS)


@query(
    with_sales(
        f"SELECT {KEYS_SQL}, "
        + ", ".join(
            f"round_even(({c} - (SELECT min({c}) FROM train)) / CAST((SELECT max({c}) - min({c}) FROM train) AS DOUBLE), 6) AS {c}"
            for c in FEATURES
        )
        + " FROM parted WHERE part = 'test'",
        PARTED_SQL,
    )
)
def scale_minmax(t):
    test = parted(t).filter(F.col("part") == "test")
    scaled = scaling.scale_minmax(test, train_rows(t), FEATURES)
    return scaled.select(*KEYS, *[F.bround(c, 6).alias(c) for c in FEATURES])


@query(
    with_sales(
        f"SELECT {KEYS_SQL}, "
        + ", ".join(
            f"round_even(({c} - (SELECT avg({c}) FROM train)) / (SELECT stddev_pop({c}) FROM train), 6) AS {c}" for c in FEATURES
        )
        + " FROM parted WHERE part = 'test'",
        PARTED_SQL,
    )
)
def scale_standard(t):
    test = parted(t).filter(F.col("part") == "test")
    scaled = scaling.scale_standard(test, train_rows(t), FEATURES)
    return scaled.select(*KEYS, *[F.bround(c, 6).alias(c) for c in FEATURES])


GRID = [round(-2 + 0.25 * i, 2) for i in range(17)]


def profile_sql(column: str) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({g} AS DOUBLE) AS lam, ({g} - 1.0) * sum(ln({column})) - count(*) / 2.0 * ln(var_pop("
        + (f"ln({column})" if g == 0 else f"(pow({column}, {g}) - 1) / {g}")
        + ")) AS llf FROM train"
        for g in GRID
    )


@query(
    with_sales(
        f"SELECT {KEYS_SQL}, CAST(lam AS DOUBLE) AS lam, round_even(CASE WHEN lam = 0 THEN ln(l_quantity) ELSE (pow(l_quantity, lam) - 1) / nullif(lam, 0) END, 6) "
        "AS quantity_bc FROM parted, best WHERE part = 'test'",
        PARTED_SQL,
        f"profile AS ({profile_sql('l_quantity')})",
        "best AS (SELECT lam FROM profile ORDER BY llf DESC, lam LIMIT 1)",
    )
)
def boxcox(t):
    best = scaling.best_lambda(scaling.boxcox_profile(train_rows(t), "l_quantity", GRID)).scalar()
    test = parted(t).filter(F.col("part") == "test").withColumn("lam", best)
    return test.select(*KEYS, "lam", F.bround(scaling.boxcox("l_quantity", F.col("lam")), 6).alias("quantity_bc"))


REFINED = ("l_quantity", "p_size", "l_extendedprice", "p_retailprice")


@query()
def boxcox_refined(t):
    """The most likely Box-Cox exponent of several columns at once, to three decimals (M5)."""
    found = scaling.fit_boxcox(train_rows(t), REFINED)
    return t.spark.createDataFrame([(c, round(v, 3)) for c, v in found.items()], "feature string, lam double")


CHI2_FEATURES = ("l_quantity", "l_discount", "l_tax")


@query(
    "WITH c AS (SELECT l_returnflag, count(*) AS n, "
    + ", ".join(f"sum({f}) AS {f}" for f in CHI2_FEATURES)
    + " FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS n, "
    + ", ".join(f"sum({f}) AS {f}" for f in CHI2_FEATURES)
    + " FROM c) "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round_even(sum(power(c.{f} - c.n * t.{f} / t.n, 2) / (c.n * t.{f} / t.n)), 5) AS score FROM c, t"
        for f in CHI2_FEATURES
    )
)
def score_chi2(t):
    return scores.score_chi2(t.lineitem, CHI2_FEATURES, "l_returnflag", places=5)


@query(
    f"SELECT feature, score, round_even(exp(-score / 2), 9) AS p_value, CAST(rank AS INTEGER) AS rank, CASE WHEN rank <= 2 THEN 1 ELSE 0 END AS kept FROM "
    f"(SELECT feature, score, row_number() OVER (ORDER BY score DESC, feature) AS rank FROM ({ORACLES['score_chi2']}) s) r"
)
def score_chi2_table(t):
    """Scores with p-values (two degrees of freedom: three classes), rank and the two best (M6)."""
    scored = scores.score_chi2(t.lineitem, CHI2_FEATURES, "l_returnflag", places=5)
    table = scores.with_chi2_p_values(scores.selection(scored, 2), t.lineitem, "l_returnflag")
    return table.select("feature", "score", F.bround("p_value", 9).alias("p_value"), "rank", "kept")


@query(
    with_sales(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round_even(power(corr({c}, l_extendedprice), 2) / (1 - power(corr({c}, l_extendedprice), 2)) * (count(*) - 2), 5) AS score FROM sales"
            for c in FEATURES
        )
    )
)
def score_f_regression(t):
    return scores.score_f_regression(t.sales, FEATURES, "l_extendedprice", places=5)


F_TOP = 3
F_SQL = " UNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS feature, power(corr({c}, l_extendedprice), 2) / (1 - power(corr({c}, l_extendedprice), 2)) * (count(*) - 2) AS score FROM train"
    for i, c in enumerate(FEATURES)
)


@query(
    with_sales(
        f"SELECT {KEYS_SQL}, chosen, list_transform(list_filter([{', '.join(f'{{place: {i}, v: CAST({c} AS DOUBLE)}}' for i, c in enumerate(FEATURES))}], "
        "lambda s: list_contains(places, s.place)), lambda s: s.v) AS chosen_values FROM parted, "
        "(SELECT string_agg(feature, ',' ORDER BY place) AS chosen, list(place) AS places FROM best) b WHERE part = 'test'",
        PARTED_SQL,
        f"best AS (SELECT place, feature FROM ({F_SQL}) q ORDER BY round_even(score, 6) DESC, feature LIMIT {F_TOP})",
    )
)
def select_f_top_k(t):
    """Test rows reduced to the features that score best on the training rows (M7)."""
    train = train_rows(t)
    best = scores.top_features(scores.score_f_regression(train, FEATURES, "l_extendedprice"), F_TOP)
    kept = [c for c in FEATURES if c in best]
    test = scores.reduced(parted(t).filter(F.col("part") == "test").select(*KEYS, *FEATURES), FEATURES, kept)
    return test.select(*KEYS, F.lit(",".join(kept)).alias("chosen"), F.array(*[F.col(c).cast("double") for c in kept]).alias("chosen_values"))


@query()
def score_f_table(t):
    """F scores with p-values, rank and the three best (M7)."""
    train = train_rows(t)
    table = scores.with_f_p_values(scores.selection(scores.score_f_regression(train, FEATURES, "l_extendedprice"), F_TOP), train)
    return table.withColumn("p_value", F.bround("p_value", 6))


@query(
    with_sales(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round_even(var_pop({c}), 5) AS variance, CASE WHEN var_pop({c}) > 0.9 THEN 1 ELSE 0 END AS kept FROM sales"
            for c in FEATURES
        )
    )
)
def select_variance(t):
    return scores.score_variance(t.sales, FEATURES, 0.9, places=5)


def poisson_sql(unit: str, rate: float) -> str:
    """Poisson inversion written out independently: count the cumulative steps below the unit number."""
    steps, total = [], 0.0
    for i in range(resample.poisson_terms(rate)):
        total += math.exp(-rate + i * math.log(rate) - math.lgamma(i + 1))
        steps.append(f"(CASE WHEN {unit} >= {total!r} THEN 1 ELSE 0 END)")
    return " + ".join(steps)


RARE = "l_extendedprice > 90000"
OVER_SQL = f"""
SELECT {KEYS_SQL}, l_extendedprice, 0 AS copy FROM lineitem UNION ALL
SELECT {KEYS_SQL}, l_extendedprice, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM
  (SELECT *, {poisson_sql(unit_sql('9', *KEYS), 1.0)} AS copies FROM lineitem WHERE {RARE}) q"""


def rows(t: Tables):
    return t.lineitem.select(*KEYS, "l_extendedprice")


@query(OVER_SQL)
def oversample_rare(t):
    return resample.oversample(rows(t), [(F.expr(RARE), "9", None)], KEYS)


NESTED = ((RARE, "9", 400), ("l_extendedprice > 97000", "20", 800))


def nested_sql() -> str:
    """Copies by cumulative Poisson probabilities at rate draws / rows, summed in SQL."""
    parts = [f"SELECT {KEYS_SQL}, l_extendedprice, 0 AS copy FROM lineitem"]
    for rare, seed, draws in NESTED:
        parts.append(
            f"SELECT {KEYS_SQL}, l_extendedprice, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM ("
            f"SELECT r.*, (SELECT count(*) FROM (SELECT i, sum(p) OVER (ORDER BY i) AS reached FROM "
            f"(SELECT i, exp(-rate + i * ln(rate) - lgamma(i + 1)) AS p FROM range(0, 60) g(i)) x) y WHERE r.u >= y.reached) AS copies FROM "
            f"(SELECT *, {unit_sql(seed, *KEYS)} AS u FROM lineitem WHERE {rare}) r, "
            f"(SELECT {draws} / CAST(count(*) AS DOUBLE) AS rate FROM lineitem WHERE {rare}) z) q"
        )
    return " UNION ALL ".join(parts)


@query(nested_sql())
def oversample_nested(t):
    return resample.oversample(rows(t), [(F.expr(rare), seed, draws) for rare, seed, draws in NESTED], KEYS)


@query(
    "WITH chosen AS (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice < 400000) q "
    f"ORDER BY {unit_sql('2', 'o_custkey')}, o_custkey LIMIT 250) "
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM chosen) "
    "UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice >= 400000"
)
def undersample_entities(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    price = F.col("o_totalprice")
    return resample.undersample_entities(orders, "o_custkey", price < 400000, price >= 400000, 250, "2")


@query(
    "SELECT source, count(*) AS n_rows, round_even(avg(l_extendedprice), 3) AS mean, "
    "round_even(quantile_cont(l_extendedprice, 0.5), 4) AS median FROM ("
    f"SELECT 'original' AS source, l_extendedprice FROM lineitem UNION ALL SELECT 'resampled', l_extendedprice FROM ({OVER_SQL}) o) q GROUP BY source"
)
def label_compare(t):
    from staywise.operators.quantiles import exact_quantiles

    base = rows(t).select(F.lit("original").alias("source"), "l_extendedprice")
    more = resample.oversample(rows(t), [(F.expr(RARE), "9", None)], KEYS)
    both = base.unionByName(more.select(F.lit("resampled").alias("source"), "l_extendedprice"))
    means = both.groupBy("source").agg(
        F.count("*").alias("n_rows"), F.bround(F.avg("l_extendedprice"), 3).alias("mean")
    )
    medians = exact_quantiles(both, "l_extendedprice", [0.5], ["median"], by=["source"])
    return means.join(medians, "source").withColumn("median", F.bround("median", 4))
