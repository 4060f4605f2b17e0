"""Scalar functions (F1-F16) and the metrics of a group-mean predictor."""

from pyspark.sql import functions as F

from staywise.functions import times
from staywise.operators import groups, metrics
from workload.aggregates import PREDICTED_SQL, predicted
from workload.base import query, with_fx, with_sales

AGED_SQL = """
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def aged(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").join(
        t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    )


@query(
    with_fx(
        "SELECT stay_id, CAST(extract('day' FROM stay_out - stay_in) AS INTEGER) AS days, "
        "CAST(extract('minute' FROM stay_out - stay_in) AS INTEGER) AS minutes, "
        "CAST(extract('minute' FROM stay_in - stay_out) AS INTEGER) AS minutes_back, "
        "date_diff('microsecond', stay_in, stay_out) AS micros FROM fx_stays"
    )
)
def interval_parts(t):
    return t.fx_stays.select(
        "stay_id",
        times.whole_days("stay_in", "stay_out").alias("days"),
        times.minute_part("stay_in", "stay_out").alias("minutes"),
        times.minute_part("stay_out", "stay_in").alias("minutes_back"),
        times.micros_between("stay_in", "stay_out").alias("micros"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    "CAST(floor(date_diff('day', o_orderdate, l_shipdate) / 365.0) AS INTEGER) AS age" + AGED_SQL
)
def age_years(t):
    return aged(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", times.age_in_years("o_orderdate", "l_shipdate").alias("age")
    )


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    "CAST(trunc(date_diff('day', o_orderdate, l_shipdate) / 365.0) AS INTEGER) AS age" + AGED_SQL
)
def age_at_stay(t):
    return aged(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", times.age_truncated("o_orderdate", "l_shipdate").alias("age")
    )


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN age > 5 THEN age - 2 ELSE age END AS age FROM "
    "(SELECT l_orderkey, l_linenumber, l_partkey, "
    "CAST(floor(date_diff('day', o_orderdate, l_shipdate) / 365.0) AS INTEGER) AS age" + AGED_SQL + ") q"
)
def age_adjusted(t):
    age = times.unshift_age(times.age_in_years("o_orderdate", "l_shipdate"), above=5, shift=2)
    return aged(t).select("l_orderkey", "l_linenumber", "l_partkey", age.alias("age"))


@query(
    with_fx(
        "SELECT event_id, CASE WHEN hour(intime) BETWEEN 6 AND 18 THEN 1 ELSE 0 END AS in_day, "
        "CASE WHEN hour(outtime) BETWEEN 6 AND 18 THEN 1 ELSE 0 END AS out_day FROM fx_transfers"
    )
)
def day_night(t):
    return t.fx_transfers.select(
        "event_id", times.day_flag("intime").alias("in_day"), times.day_flag("outtime").alias("out_day")
    )


@query(
    with_fx(
        "SELECT event_id, CASE WHEN eventtype = 'discharge' THEN NULL WHEN hour(outtime) BETWEEN 6 AND 18 THEN 'day' "
        "ELSE 'night' END AS out_label FROM fx_transfers"
    )
)
def day_night_label(t):
    out = F.when(F.col("eventtype") != "discharge", F.col("outtime"))
    return t.fx_transfers.select("event_id", times.day_label(out).alias("out_label"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2, 0) AS half, "
    "round_even(l_extendedprice / 8, 1) AS eighth FROM lineitem"
)
def round_half_even(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.rint(F.col("l_quantity") / 2).alias("half"), F.bround(F.col("l_extendedprice") / 8, 1).alias("eighth"),
    )


@query(
    "SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM "
    "(SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents) q"
)
def tokenise(t):
    words = t.documents.select("doc_id", groups.tokens("text").alias("w"))
    return words.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"),
    )


FUZZY = ("widgit", "plates", "goldd")


@query(
    "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM (SELECT unnest(string_split_regex(lower(p_name), '\\s+')) AS token) w, "
    "(VALUES ('widgit'), ('plates'), ('goldd')) k(word) WHERE levenshtein(token, word) <= round_even(0.2 * greatest(length(token), length(word)), 6))"
)
def fuzzy_group(t):
    return groups.fuzzy_rows(t.part, "p_partkey", "p_name", FUZZY, method="edits").select("p_partkey", "p_name")


@query()
def fuzzy_group_ratio(t):
    words = [w for group in groups.FUZZY_KEYWORDS.values() for w in group]
    return groups.fuzzy_rows(t.documents, "doc_id", "text", words, method="ratio").select("doc_id", "lang", "source")


@query(
    with_sales(
        "SELECT count(*) AS n_rows, round_even(sqrt(avg((label - pred) ** 2)), 4) AS rmse, "
        "round_even(avg(abs(label - pred)), 4) AS mean_abs_error, "
        "round_even(1 - sum((label - pred) ** 2) / (var_pop(label) * count(*)), 4) AS r2, "
        "round_even(median(abs(label - pred)), 4) AS median_abs_error FROM predicted",
        PREDICTED_SQL,
    )
)
def regression_metrics(t):
    return metrics.regression_metrics(predicted(t), "label", "pred")


@query(
    with_sales(
        "SELECT round_even(min(label), 4) AS label_min, round_even(max(label), 4) AS label_max, "
        "round_even(min(pred), 4) AS pred_min, round_even(max(pred), 4) AS pred_max FROM predicted",
        PREDICTED_SQL,
    )
)
def prediction_range(t):
    return metrics.prediction_range(predicted(t), "label", "pred")


JUDGED_SQL = """
judged AS (
SELECT lang, l.toxic AS label, CAST(n_chars AS DOUBLE) AS score,
       CASE WHEN quality = 0 THEN 1 ELSE 0 END AS guess
FROM labels l JOIN documents d USING (doc_id))"""


def judged(t):
    docs = t.documents.select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    guess = F.when(F.col("quality") == 0, 1).otherwise(0)
    return t.labels.join(docs, "doc_id").select("lang", F.col("toxic").alias("label"), "score", guess.alias("guess"))


@query(
    f"WITH {JUDGED_SQL}, c AS (SELECT lang, count(CASE WHEN label = 1 AND guess = 1 THEN 1 END) AS tp, "
    "count(CASE WHEN label <> 1 AND guess = 1 THEN 1 END) AS fp, count(CASE WHEN label = 1 AND guess <> 1 THEN 1 END) AS fn, "
    "count(CASE WHEN label <> 1 AND guess <> 1 THEN 1 END) AS tn FROM judged GROUP BY lang) "
    "SELECT *, round_even((tp + tn) / nullif(CAST(tp + fp + fn + tn AS DOUBLE), 0), 6) AS accuracy, "
    "round_even(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS sensitivity, round_even(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 6) AS specificity, "
    "round_even(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS precision, round_even(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall, "
    "round_even(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 6) AS f1 FROM c"
)
def classification_metrics(t):
    return metrics.classification_metrics(judged(t), "label", "guess", by=["lang"])


ROC_SQL = """
steps AS (
SELECT score, count(CASE WHEN label = 1 THEN 1 END) AS pos, count(CASE WHEN label <> 1 THEN 1 END) AS neg FROM judged GROUP BY score),
walk AS (
SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
FROM steps WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    f"WITH {JUDGED_SQL}, {ROC_SQL} SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, "
    "round_even(tp / CAST(p AS DOUBLE), 6) AS tpr, round_even(fp / CAST(n AS DOUBLE), 6) AS fpr FROM walk"
)
def roc_points(t):
    points = metrics.roc_points(judged(t), "label", "score")
    return points.select("threshold", "tp", "fp", F.bround("tpr", 6).alias("tpr"), F.bround("fpr", 6).alias("fpr"))


@query(
    f"WITH {JUDGED_SQL} SELECT round_even(((SELECT count(*) FROM judged a, judged b WHERE a.label = 1 AND b.label <> 1 AND a.score > b.score) "
    "+ 0.5 * (SELECT count(*) FROM judged a, judged b WHERE a.label = 1 AND b.label <> 1 AND a.score = b.score)) "
    "/ CAST((SELECT count(*) FROM judged WHERE label = 1) * (SELECT count(*) FROM judged WHERE label <> 1) AS DOUBLE), 6) AS auc, "
    "(SELECT count(*) FROM judged WHERE label = 1) AS n_pos, (SELECT count(*) FROM judged WHERE label <> 1) AS n_neg"
)
def roc_auc(t):
    return metrics.roc_auc(judged(t), "label", "score")


@query(
    with_fx(
        "SELECT count(*) AS n_units, count(*) * (count(*) - 1) // 2 AS n_pairs FROM "
        "(SELECT DISTINCT curr_unit FROM fx_transfers WHERE curr_unit <> '') q"
    )
)
def unit_pairs(t):
    units = t.fx_transfers.filter(F.col("curr_unit") != "").select("curr_unit").distinct()
    n = F.count("*")
    return units.agg(n.alias("n_units"), F.expr("count(*) * (count(*) - 1) div 2").alias("n_pairs"))
