"""Aggregations, sorts, set operations."""

from pyspark.sql import functions as F

from staywise.functions import codes
from staywise.operators import stats, stays, transitions
from workload.base import Tables, dealt, query, with_fx, with_sales
from workload.filters import CODE_FLAGS_SQL, CODE_RULES

ORDER_BINS = (("urgent", ("urgent",)), ("high", ("high", "medium")), ("low", ("low",)))


@query(
    with_fx(
        "SELECT (SELECT count(DISTINCT admission_id) FROM fx_transfers) AS n_admissions, "
        "(SELECT count(DISTINCT entity_id) FROM fx_transfers) AS n_entities, "
        "(SELECT count(*) FROM fx_stays) AS n_stays, "
        "(SELECT count(DISTINCT admission_id) FROM fx_stays) AS n_stay_admissions, "
        "(SELECT count(DISTINCT entity_id) FROM fx_stays) AS n_stay_entities, "
        "(SELECT count(*) FROM (SELECT entity_id FROM fx_stays GROUP BY 1 HAVING count(*) > 1) q) AS n_readmitted"
    )
)
def cohort_overview(t):
    # one row per admission first: every count then follows from partial sums
    admissions = t.fx_transfers.groupBy("entity_id", "admission_id").agg(
        F.count_distinct("stay_id").alias("stays")
    )
    entities = admissions.groupBy("entity_id").agg(
        F.count("*").alias("admissions"),
        F.count_if(F.col("stays") > 0).alias("stay_admissions"),
        F.sum("stays").alias("stays"),
    )
    return entities.agg(
        F.sum("admissions").alias("n_admissions"),
        F.count("*").alias("n_entities"),
        F.sum("stays").alias("n_stays"),
        F.sum("stay_admissions").alias("n_stay_admissions"),
        F.count_if(F.col("stays") > 0).alias("n_stay_entities"),
        F.count_if(F.col("stays") > 1).alias("n_readmitted"),
    )


@query(with_fx("SELECT prev_unit AS unit, count(*) AS n_rows FROM fx_transfers GROUP BY prev_unit"))
def count_by_unit(t):
    return t.fx_transfers.groupBy(F.col("prev_unit").alias("unit")).agg(F.count("*").alias("n_rows"))


@query(with_fx("SELECT entity_id, admission_id, count(DISTINCT stay_id) AS n_stays FROM fx_transfers GROUP BY 1, 2"))
def stays_per_admission(t):
    return t.fx_transfers.groupBy("entity_id", "admission_id").agg(F.count_distinct("stay_id").alias("n_stays"))


@query(with_fx("SELECT entity_id, admission_id, stay_id, stay_in, stay_out FROM fx_stays"))
def collapse_stays(t):
    return stays.collapse_stays(t.fx_transfers)


@query(with_fx("SELECT entity_id, count(*) AS n_stays FROM fx_stays GROUP BY entity_id HAVING count(*) > 5"))
def having_multi(t):
    return t.fx_stays.groupBy("entity_id").agg(F.count("*").alias("n_stays")).filter(F.col("n_stays") > 5)


LOS_SQL = "los AS (SELECT *, date_diff('microsecond', stay_in, stay_out) / 86400000000.0 AS los FROM fx_stays)"


@query(with_fx("SELECT entity_id, round_even(avg(los), 6) AS avg_los, count(stay_id) AS n_stays FROM los GROUP BY entity_id", LOS_SQL))
def avg_los_per_entity(t):
    return t.fx_stays.groupBy("entity_id").agg(
        F.bround(F.avg(stays.los_days()), 6).alias("avg_los"), F.count("stay_id").alias("n_stays")
    )


@query(with_fx("SELECT entity_id, admission_id, round_even(avg(los), 6) AS avg_los FROM los GROUP BY 1, 2", LOS_SQL))
def avg_los_per_admission(t):
    return t.fx_stays.groupBy("entity_id", "admission_id").agg(F.bround(F.avg(stays.los_days()), 6).alias("avg_los"))


PROCEDURES_SQL = f"""
flags AS (SELECT l_orderkey, l_linenumber, {CODE_FLAGS_SQL} FROM sales),
procedures AS (
SELECT l_orderkey, max(op_first) AS op_first, max(op_second) AS op_second, max(op_third) AS op_third,
       max(op_fourth) AS op_fourth,
       CASE WHEN max(l_linenumber) <= 2 THEN 1 WHEN max(l_linenumber) <= 5 THEN 2 ELSE 3 END AS num_operations
FROM flags GROUP BY l_orderkey)"""


def procedures(t: Tables):
    """Any-match code flags and the bucketed highest sequence number, in one grouping."""
    flags = [F.max(codes.in_code_ranges("code", r)).alias(n) for n, r in CODE_RULES.items()]
    last = F.max("l_linenumber")
    bucket = F.when(last <= 2, 1).when(last <= 5, 2).otherwise(3).alias("num_operations")
    return t.sales.groupBy("l_orderkey").agg(*flags, bucket)


@query(with_sales("SELECT l_orderkey, op_first, op_second, op_third, op_fourth FROM procedures", PROCEDURES_SQL))
def any_flags(t):
    return procedures(t).drop("num_operations")


@query(with_sales("SELECT l_orderkey, num_operations FROM procedures", PROCEDURES_SQL))
def bucket_max_seq(t):
    return procedures(t).select("l_orderkey", "num_operations")


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def distinct_rows(t):
    return t.orders.select("o_custkey", "o_orderpriority").distinct()


@query(
    "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER "
    "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) q WHERE rn = 1"
)
def first_per_key(t):
    # an aggregate instead of a window: combined map-side, no sort, no hot key
    first = F.min_by(F.struct("o_orderkey", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(first.alias("f")).select("o_custkey", "f.*")


@query("SELECT p_brand, p_type FROM part WHERE p_name LIKE '%widget%' GROUP BY p_brand, p_type")
def distinct_group(t):
    return t.part.filter(F.col("p_name").like("%widget%")).select("p_brand", "p_type").distinct()


@query("SELECT c_mktsegment, count(*) AS n_rows FROM customer GROUP BY 1 ORDER BY n_rows DESC, c_mktsegment")
def value_counts(t):
    return stats.value_counts(t.customer, "c_mktsegment")


@query(
    "SELECT o_orderpriority, count(*) AS n_rows, round_even(count(*) * 100.0 / (SELECT count(*) FROM orders), 2) AS pct "
    "FROM orders GROUP BY 1"
)
def share_of_total(t):
    return stats.share_of_total(t.orders, "o_orderpriority")


@query(
    "SELECT CASE WHEN lower(o_orderpriority) LIKE '%urgent%' THEN 'urgent' "
    "WHEN lower(o_orderpriority) LIKE '%high%' OR lower(o_orderpriority) LIKE '%medium%' THEN 'high' "
    "WHEN lower(o_orderpriority) LIKE '%low%' THEN 'low' ELSE 'other' END AS bin, "
    "CAST(coalesce(sum(CASE WHEN n > 4 THEN n END), 0) AS BIGINT) AS n_hit, CAST(sum(n) AS BIGINT) AS n_all, "
    "round_even(coalesce(sum(CASE WHEN n > 4 THEN n END), 0) * 100.0 / sum(n), 2) AS rate_pct "
    "FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) q ON o_orderkey = l_orderkey GROUP BY 1"
)
def rate_by_bin(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    both = t.orders.select("o_orderkey", "o_orderpriority").join(lines, "o_orderkey")
    return stats.rate_by_bin(both, codes.bin_by_keyword("o_orderpriority", ORDER_BINS), "n", F.col("n") > 4)


@query(with_fx("SELECT entity_id, admission_id, count(*) AS n_trav FROM fx_transfers GROUP BY 1, 2"))
def transfers_per_admission(t):
    return t.fx_transfers.groupBy("entity_id", "admission_id").agg(F.count("*").alias("n_trav"))


PAIRS_SQL = """
pairs AS (
SELECT f.*, p || '-' || c AS pair FROM (
  SELECT event_id, entity_id, admission_id, stay_id, eventtype, coalesce(nullif(prev_unit, ''), 'nonunit') AS p,
         coalesce(nullif(curr_unit, ''), 'nonunit') AS c
  FROM fx_transfers WHERE stay_id IS NOT NULL AND prev_unit <> 'error' AND curr_unit <> 'error'
  AND entity_id IN (SELECT entity_id FROM fx_stays GROUP BY entity_id HAVING count(*) > 1)) f),
probs AS (
SELECT p, c, n_trans, n_trans / CAST(sum(n_trans) OVER (PARTITION BY c) AS DOUBLE) AS prob
FROM (SELECT p, c, count(*) AS n_trans FROM pairs GROUP BY 1, 2) q),
top AS (
SELECT pair, n_trans, row_number() OVER (ORDER BY n_trans DESC, pair) AS pair_rank
FROM (SELECT pair, count(*) AS n_trans FROM pairs GROUP BY 1) q
QUALIFY pair_rank <= 10)"""


def pairs(t: Tables):
    """Labelled moves inside stays of the readmitted entities, excluded units left out."""
    from staywise.operators.cohort import keep_entities, multi_stay_entities
    from workload.base import EXCLUDED

    inside = t.fx_transfers.filter(F.col("stay_id").isNotNull())
    labelled = transitions.label_pairs(inside, excluded=EXCLUDED, blank="nonunit")
    return keep_entities(labelled, multi_stay_entities(t.fx_stays))


@query(
    with_fx(
        "SELECT p AS prev_unit, count(CASE WHEN c = 'view' THEN 1 END) AS \"view\", count(CASE WHEN c = 'click' THEN 1 END) AS click, "
        "count(CASE WHEN c = 'purchase' THEN 1 END) AS purchase FROM pairs GROUP BY p",
        PAIRS_SQL,
    )
)
def crosstab_counts(t):
    return transitions.crosstab(pairs(t), "prev_unit", "curr_unit", ["view", "click", "purchase"])


@query(with_fx("SELECT p AS prev_unit, c AS curr_unit, round_even(prob, 6) AS prob FROM probs", PAIRS_SQL))
def transition_prob(t):
    return transitions.transition_probabilities(pairs(t)).select(
        "prev_unit", "curr_unit", F.bround("prob", 6).alias("prob")
    )


@query(with_fx("SELECT p || '-' || c AS pair, n_trans, round_even(prob, 6) AS prob FROM probs", PAIRS_SQL))
def transition_prob_long(t):
    table = transitions.transition_probabilities(pairs(t))
    return table.select(codes.pair_label("prev_unit", "curr_unit").alias("pair"), "n_trans", F.bround("prob", 6).alias("prob"))


@query(
    with_fx(
        "SELECT prev_unit, curr_unit, count(CASE WHEN eventtype = 'admit' THEN 1 END) AS admit, "
        "count(CASE WHEN eventtype = 'transfer' THEN 1 END) AS transfer, "
        "count(CASE WHEN eventtype = 'discharge' THEN 1 END) AS discharge FROM fx_transfers GROUP BY 1, 2"
    )
)
def pivot_event_type(t):
    kinds = ["admit", "transfer", "discharge"]
    return t.fx_transfers.groupBy("prev_unit", "curr_unit").pivot("eventtype", kinds).count().na.fill(0, kinds)


WIDE_SQL = ", ".join(f"count(CASE WHEN pair_rank = {i} THEN 1 END) AS pair_{i}" for i in range(1, 11))
WEIGHT_SQL = ", ".join(
    f"round_even(count(CASE WHEN pair_rank = {i} THEN 1 END) * coalesce((SELECT prob FROM probs JOIN top ON pair = p || '-' || c WHERE pair_rank = {i}), 0), 3) AS pair_{i}"
    for i in range(1, 11)
)


@query(with_fx(f"SELECT stay_id, {WIDE_SQL} FROM pairs LEFT JOIN top USING (pair) GROUP BY entity_id, stay_id", PAIRS_SQL))
def pair_counts_wide(t):
    return transitions.ranked_pair_counts(pairs(t)).drop("entity_id")


@query(with_fx(f"SELECT stay_id, {WEIGHT_SQL} FROM pairs LEFT JOIN top USING (pair) GROUP BY entity_id, stay_id", PAIRS_SQL))
def pair_weights(t):
    return transitions.ranked_pair_weights(pairs(t)).drop("entity_id")


@query(with_fx("SELECT pair, n_trans, pair_rank FROM top", PAIRS_SQL))
def top_k_pairs(t):
    return transitions.top_pairs(pairs(t))


DESCRIBED = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round_even(avg({c}), 4) AS mean, round_even(stddev_samp({c}), 4) AS std, "
        f"min({c}) AS min, round_even(quantile_cont({c}, 0.25), 4) AS q1, round_even(quantile_cont({c}, 0.5), 4) AS q2, "
        f"round_even(quantile_cont({c}, 0.75), 4) AS q3, max({c}) AS max FROM lineitem"
        for c in DESCRIBED
    )
)
def describe_exact(t):
    return stats.describe(t.lineitem, DESCRIBED, places=4)


@query(
    "SELECT round_even(avg(o_totalprice), 3) AS mean, round_even(median(o_totalprice), 3) AS median, "
    "round_even(stddev_samp(o_totalprice), 3) AS std, round_even(max(o_totalprice), 3) AS max FROM orders"
)
def basic_stats(t):
    return stats.basic_stats(t.orders, "o_totalprice", places=3)


@query("SELECT l_returnflag, round_even(quantile_cont(l_extendedprice, 0.9), 4) AS q90 FROM lineitem GROUP BY l_returnflag")
def quantile(t):
    from staywise.operators.quantiles import exact_quantiles

    found = exact_quantiles(t.lineitem, "l_extendedprice", [0.9], ["q90"], by=["l_returnflag"])
    return found.select("l_returnflag", F.bround("q90", 4).alias("q90"))


PER_ADMISSION_SQL = """
per_admission AS (
SELECT f.entity_id, f.admission_id, count(*) AS n_trav, max(m.n) - 1 AS n_readm
FROM fx_transfers f JOIN (SELECT entity_id, count(*) AS n FROM fx_stays GROUP BY 1 HAVING count(*) > 1) m
ON f.entity_id = m.entity_id GROUP BY 1, 2)"""


def per_admission(t: Tables):
    from staywise.operators.cohort import multi_stay_entities

    counts = t.fx_transfers.groupBy("entity_id", "admission_id").agg(F.count("*").alias("n_trav"))
    return counts.join(multi_stay_entities(t.fx_stays), "entity_id").select(
        "entity_id", "admission_id", "n_trav", (F.col("n_stays") - 1).alias("n_readm")
    )


@query(with_fx("SELECT round_even(corr(n_trav, n_readm), 6) AS pearson FROM per_admission", PER_ADMISSION_SQL))
def corr_pearson(t):
    return stats.pearson(per_admission(t), "n_trav", "n_readm")


SPEARMAN_SQL = """
ranked AS (
SELECT rank() OVER (ORDER BY n_trav) + (count(*) OVER (PARTITION BY n_trav) - 1) / 2.0 AS ra,
       rank() OVER (ORDER BY n_readm) + (count(*) OVER (PARTITION BY n_readm) - 1) / 2.0 AS rb
FROM per_admission)"""


@query(with_fx("SELECT round_even(corr(ra, rb), 6) AS spearman FROM ranked", PER_ADMISSION_SQL, SPEARMAN_SQL))
def corr_spearman(t):
    return stats.spearman(per_admission(t), "n_trav", "n_readm")


FEATURES = ("l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice")


@query(
    with_sales(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round_even(corr({c}, l_extendedprice), 6) AS corr FROM sales" for c in FEATURES
        )
    )
)
def corr_with_label(t):
    return stats.corr_with_label(t.sales, FEATURES, "l_extendedprice")


@query(
    "SELECT CAST(least(floor((v - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n_rows, min(v) AS bin_min, "
    "max(v) AS bin_max FROM (SELECT round_even(l_extendedprice / 1000, 0) AS v, min(round_even(l_extendedprice / 1000, 0)) OVER () AS lo, "
    "max(round_even(l_extendedprice / 1000, 0)) OVER () AS hi FROM lineitem) q GROUP BY 1"
)
def histogram(t):
    return stats.histogram(t.lineitem, F.bround(F.col("l_extendedprice") / 1000, 0), 20)


@query(
    "WITH q AS (SELECT l_returnflag AS g, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, "
    "quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1), "
    "f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) "
    "SELECT l_returnflag, count(*) AS n_rows, round_even(max(q1), 4) AS q1, round_even(max(q2), 4) AS q2, round_even(max(q3), 4) AS q3, "
    "min(CASE WHEN l_extendedprice BETWEEN lo AND hi THEN l_extendedprice END) AS whisker_low, "
    "max(CASE WHEN l_extendedprice BETWEEN lo AND hi THEN l_extendedprice END) AS whisker_high, "
    "count(CASE WHEN NOT l_extendedprice BETWEEN lo AND hi THEN 1 END) AS n_outliers "
    "FROM lineitem JOIN f ON l_returnflag = g GROUP BY l_returnflag"
)
def box_summary(t):
    return stats.box_summary(t.lineitem, "l_extendedprice", ["l_returnflag"])


@query(
    "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_distinct, count(*) - count(DISTINCT o_custkey) AS n_duplicate FROM orders"
)
def duplicate_count(t):
    return stats.duplicate_count(t.orders, "o_custkey")


PREDICTED_SQL = """
predicted AS (
SELECT round_even(l_extendedprice / 1000, 6) AS label, round_even(avg(l_extendedprice / 1000) OVER (PARTITION BY p_type, l_quantity), 6) AS pred
FROM sales)"""


def predicted(t: Tables):
    """Group-mean predictor: the mean label of rows alike in type and quantity."""
    keys = ["p_type", "l_quantity"]
    price = F.col("l_extendedprice") / 1000
    means = t.sales.groupBy(*keys).agg(F.bround(F.avg(price), 6).alias("pred"))
    return t.sales.join(means, keys).select(F.bround(price, 6).alias("label"), "pred")


@query(
    with_sales(
        "SELECT truth, round_even(avg(pred), 4) AS mean, round_even(median(pred), 4) AS median, "
        "round_even(stddev_samp(pred), 4) AS std, max(pred) AS max, min(pred) AS min, count(pred) AS n_rows, "
        "round_even(stddev_samp(pred) / sqrt(count(pred)), 4) AS std_error, max(pred) - min(pred) AS \"range\" "
        "FROM (SELECT CAST(round_even(label, 0) AS BIGINT) AS truth, round_even(pred, 0) AS pred FROM predicted) q GROUP BY truth",
        PREDICTED_SQL,
    )
)
def error_by_truth(t):
    return stats.error_by_truth(predicted(t), "label", "pred")


@query(with_fx("SELECT eventtype, curr_unit, count(*) AS n_rows FROM fx_transfers GROUP BY 1, 2"))
def group_sizes(t):
    return t.fx_transfers.groupBy("eventtype", "curr_unit").agg(F.count("*").alias("n_rows"))


@query(
    with_fx(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, count({c}) AS n_valid FROM fx_transfers"
            for c in ("event_id", "stay_id", "curr_unit", "outtime")
        )
    )
)
def null_counts(t):
    return stats.null_counts(t.fx_transfers, ["event_id", "stay_id", "curr_unit", "outtime"])


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def sort_rows(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc(), "c_custkey")


@query(
    "SELECT o_orderkey, o_totalprice, round_even(avg_price, 4) AS prediction FROM orders JOIN "
    "(SELECT o_orderpriority AS p, avg(o_totalprice) AS avg_price FROM orders GROUP BY 1) q ON o_orderpriority = p "
    "ORDER BY o_orderkey DESC LIMIT 10"
)
def tail_compare(t):
    means = t.orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("prediction"))
    last = t.orders.orderBy(F.col("o_orderkey").desc()).limit(10)
    return last.join(means, "o_orderpriority").select("o_orderkey", "o_totalprice", F.bround("prediction", 4).alias("prediction"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN age > 5 THEN age - 2 ELSE age END AS age FROM "
    "(SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(date_diff('day', o_orderdate, l_shipdate) / 365.0) AS INTEGER) AS age "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey) q"
)
def union_branches(t):
    from staywise.functions.times import age_in_years

    lines, orders = dealt(t.lineitem, "l_orderkey", t.orders, "o_orderkey")
    ages = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", age_in_years("o_orderdate", "l_shipdate").alias("age")
    )
    young = ages.filter(F.col("age") <= 5)
    shifted = ages.filter(F.col("age") > 5).withColumn("age", F.col("age") - 2)
    return young.unionByName(shifted)


@query(
    "SELECT p_brand AS code FROM part WHERE p_name LIKE '%red%' UNION SELECT p_brand FROM part WHERE p_size > 45"
)
def union_distinct_codes(t):
    red = t.part.filter(F.col("p_name").like("%red%")).select(F.col("p_brand").alias("code"))
    big = t.part.filter(F.col("p_size") > 45).select(F.col("p_brand").alias("code"))
    return red.union(big).distinct()
