"""Scans, projections, filters and predicates."""

from pyspark.sql import functions as F

from staywise.functions import codes, times
from staywise.operators import cohort, groups, stays
from staywise.sources.tables import head, sql_frame
from workload.base import EXCLUDED, UNIT_CODES, WINDOW_DAYS, Tables, query, with_fx, with_sales

KEYWORD_GROUPS = (
    groups.KeywordGroup("coloured", ("%red%", "%blue%")),
    groups.KeywordGroup("thermal", ("%hot%", "%cold%")),
    groups.KeywordGroup("aged_widget", ("%new%", "%old%"), require="%widget%"),
    groups.KeywordGroup("aged_plain", ("%new%", "%old%"), exclude="%widget%"),
)
CODE_RULES = {
    "op_first": (("1", "2"),),
    "op_second": (("3", "4"), ("21", "21")),
    "op_third": (("5", "7"), ("0013", "0017")),
    "op_fourth": (("9", "9"),),
}
RANGES = {1: (1, 5), 2: (6, 10), 3: (11, 15), 4: (16, 20), 5: (21, 25), 6: (4, 12)}
SEGMENT_CODES = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3}
TYPE_RULES = (("small_like", ("small", "economy")), ("large_like", ("large",)), ("std", ("standard", "medium")))

GAPS = """
gaps AS (
SELECT * FROM (
  SELECT *, lag(stay_id) OVER w AS prev_stay_id, lag(stay_out) OVER w AS prev_out
  FROM fx_stays WINDOW w AS (PARTITION BY entity_id ORDER BY stay_in, stay_id)) q
WHERE prev_out IS NOT NULL),
readm AS (
SELECT *, round_even(date_diff('microsecond', prev_out, stay_in) / 86400000000.0, 3) AS readm_days FROM gaps)"""


def readmissions(t: Tables, include_first: bool = False):
    return stays.readmissions(t.fx_stays, include_first=include_first, hot=t.hot)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def scan_project(t):
    return t.orders.select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey AS customer, count(*) AS n_orders, CAST(max(o_totalprice) AS DOUBLE) AS largest FROM orders GROUP BY o_custkey")
def sql_rename(t):
    text = "SELECT o_custkey, count(*), max(o_totalprice) FROM {orders} GROUP BY o_custkey"
    return sql_frame(t.spark, text, ["customer", "n_orders", "largest"], orders=t.orders)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500")
def head_n(t):
    return head(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), 500, "o_orderkey")


@query(with_fx("SELECT event_id, entity_id, stay_id, intime FROM fx_transfers WHERE stay_id IS NOT NULL"))
def filter_not_null(t):
    return t.fx_transfers.filter(F.col("stay_id").isNotNull()).select("event_id", "entity_id", "stay_id", "intime")


@query(with_fx("SELECT entity_id, stay_id, readm_days FROM readm WHERE readm_days <= 1", GAPS))
def readm_within(t):
    return stays.within_days(readmissions(t), WINDOW_DAYS).select("entity_id", "stay_id", "readm_days")


@query(
    with_fx(
        "SELECT CAST(k AS DOUBLE) AS cutoff, count(CASE WHEN readm_days <= k THEN 1 END) AS n_rows "
        "FROM readm, (VALUES (0.5), (0.75), (1.0), (1.5), (2.0), (4.0)) v(k) GROUP BY k",
        GAPS,
    )
)
def cutoff_counts(t):
    return stays.cutoff_counts(readmissions(t), "readm_days", [0.5, 0.75, 1.0, 1.5, 2.0, 4.0])


@query(
    with_fx(
        "SELECT event_id, entity_id, curr_unit FROM fx_transfers WHERE entity_id IN "
        "(SELECT entity_id FROM fx_stays GROUP BY entity_id HAVING count(*) > 1)"
    )
)
def semi_readmitted(t):
    kept = cohort.keep_entities(t.fx_transfers, cohort.multi_stay_entities(t.fx_stays))
    return kept.select("event_id", "entity_id", "curr_unit")


@query(
    with_fx(
        "SELECT entity_id, stay_id, stay_in FROM fx_stays WHERE stay_id NOT IN "
        "(SELECT stay_id FROM fx_transfers WHERE curr_unit = 'error' AND stay_id IS NOT NULL)"
    )
)
def anti_excluded_unit(t):
    return cohort.drop_stays_touching(t.fx_stays, t.fx_transfers, EXCLUDED).select("entity_id", "stay_id", "stay_in")


@query(
    with_fx(
        "SELECT event_id, u AS unit FROM (SELECT event_id, nullif(curr_unit, '') AS u FROM fx_transfers) q "
        "WHERE u IS DISTINCT FROM 'error' AND u IS DISTINCT FROM 'click'"
    )
)
def filter_ne_keep_null(t):
    blanked = t.fx_transfers.select("event_id", F.nullif("curr_unit", F.lit("")).alias("unit"))
    return blanked.filter(codes.is_not("unit", "error", "click"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%g' AND p_type LIKE '%M%'")
def like_suffix(t):
    return t.part.filter(F.col("p_name").like("%g") & F.col("p_type").contains("M")).select("p_partkey", "p_name")


@query("SELECT DISTINCT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%blue%'")
def keyword_group_any(t):
    return t.part.filter(groups.matches("p_name", KEYWORD_GROUPS[0])).select("p_partkey", "p_name").distinct()


@query(
    "SELECT p_partkey, p_name, CASE WHEN p_name LIKE '%widget%' THEN 'aged_widget' ELSE 'aged_plain' END AS grp "
    "FROM part WHERE lower(p_name) LIKE '%new%' OR lower(p_name) LIKE '%old%'"
)
def keyword_group_split(t):
    split = groups.stratify(t.part.select("p_partkey", "p_name"), "p_name", KEYWORD_GROUPS[2:])
    return split.filter(F.col("grp") != "other")


@query(
    "SELECT p_partkey, p_name FROM part WHERE NOT (lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%blue%' "
    "OR lower(p_name) LIKE '%hot%' OR lower(p_name) LIKE '%cold%' OR lower(p_name) LIKE '%new%' OR lower(p_name) LIKE '%old%')"
)
def keyword_group_other(t):
    rest = groups.stratify(t.part.select("p_partkey", "p_name"), "p_name", KEYWORD_GROUPS)
    return rest.filter(F.col("grp") == "other").select("p_partkey", "p_name")


CODE_FLAGS_SQL = """
  CASE WHEN code BETWEEN '1' AND '2' THEN 1 ELSE 0 END AS op_first,
  CASE WHEN code BETWEEN '3' AND '4' OR code = '21' THEN 1 ELSE 0 END AS op_second,
  CASE WHEN code BETWEEN '5' AND '7' OR code BETWEEN '0013' AND '0017' THEN 1 ELSE 0 END AS op_third,
  CASE WHEN code = '9' THEN 1 ELSE 0 END AS op_fourth"""


@query(f"SELECT p_partkey, code, {CODE_FLAGS_SQL} FROM (SELECT p_partkey, replace(p_brand, 'Brand#', '') AS code FROM part) q")
def code_between_flags(t):
    coded = t.part.select("p_partkey", F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("code"))
    return coded.select("*", *[codes.in_code_ranges("code", r).alias(n) for n, r in CODE_RULES.items()])


@query(
    "SELECT DISTINCT p_brand, p_type FROM part WHERE upper(p_type) = 'ECONOMY' AND "
    "TRY_CAST(nullif(replace(p_brand, 'Brand#', ''), '') AS INTEGER) BETWEEN 5 AND 12"
)
def code_numeric_range(t):
    number = groups.numeric_code(F.replace("p_brand", F.lit("Brand#"), F.lit("")))
    kept = t.part.filter((F.upper("p_type") == "ECONOMY") & number.between(5, 12))
    return kept.select("p_brand", "p_type").distinct()


@query(
    with_sales(
        "SELECT category, count(n) AS n_rows, CAST(coalesce(sum(l_quantity), 0) AS DOUBLE) AS quantity "
        "FROM (VALUES (1,1,5),(2,6,10),(3,11,15),(4,16,20),(5,21,25),(6,4,12)) r(category, lo, hi) "
        "LEFT JOIN (SELECT TRY_CAST(nullif(code,'') AS INTEGER) AS n, l_quantity FROM sales) s ON n BETWEEN lo AND hi "
        "GROUP BY category"
    )
)
def range_category_counts(t):
    return groups.category_counts(t.sales, groups.numeric_code("code"), RANGES, {"quantity": F.col("l_quantity")})


@query(
    "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 "
    "WHEN 'HOUSEHOLD' THEN 3 ELSE -1 END AS segment_code FROM customer"
)
def encode_categories(t):
    code = F.coalesce(codes.encode("c_mktsegment", SEGMENT_CODES), F.lit(-1))
    return t.customer.select("c_custkey", code.alias("segment_code"))


@query(
    "SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%small%' OR lower(p_type) LIKE '%economy%' THEN 'small_like' "
    "WHEN lower(p_type) LIKE '%large%' THEN 'large_like' "
    "WHEN lower(p_type) LIKE '%standard%' OR lower(p_type) LIKE '%medium%' THEN 'std' ELSE 'other' END AS type_bin FROM part"
)
def bin_keywords(t):
    return t.part.select("p_partkey", codes.bin_by_keyword("p_type", TYPE_RULES).alias("type_bin"))


@query(
    with_fx(
        "SELECT event_id, CASE curr_unit WHEN '' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 "
        "WHEN 'error' THEN 4 END AS unit_code, CASE WHEN curr_unit IN ('view','click','purchase') THEN 1 ELSE 0 END AS is_unit "
        "FROM fx_transfers"
    )
)
def flag_unit_type(t):
    coded = t.fx_transfers.select("event_id", codes.encode("curr_unit", UNIT_CODES).alias("unit_code"))
    return coded.withColumn("is_unit", codes.flag_between("unit_code", 0, 4))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS not_final FROM orders")
def flag_equals(t):
    return t.orders.select("o_orderkey", codes.flag_differs("o_orderstatus", "F").alias("not_final"))


@query(with_fx("SELECT event_id, coalesce(nullif(prev_unit, ''), 'nonunit') AS prev_unit FROM fx_transfers"))
def fill_unit(t):
    return t.fx_transfers.select("event_id", codes.fill_blank("prev_unit", "nonunit").alias("prev_unit"))


NULLABLE_SQL = """
nullable AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
  CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE 1 END AS flag FROM orders)"""


def nullable(t):
    return t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
        F.when(~F.col("o_orderpriority").like("1%"), 1).alias("flag"),
    )


@query(f"WITH {NULLABLE_SQL} SELECT o_orderkey, coalesce(price, 0) AS price, coalesce(flag, 0) AS flag FROM nullable")
def fill_zero(t):
    return nullable(t).na.fill(0, ["price", "flag"])


@query(f"WITH {NULLABLE_SQL} SELECT * FROM nullable WHERE price IS NOT NULL AND flag IS NOT NULL")
def drop_null_rows(t):
    return nullable(t).na.drop(subset=["price", "flag"])


@query(
    with_fx(
        "SELECT event_id, coalesce(nullif(prev_unit,''),'nonunit') || '-' || coalesce(nullif(curr_unit,''),'nonunit') AS pair "
        "FROM fx_transfers"
    )
)
def pair_label(t):
    pair = codes.pair_label(codes.fill_blank("prev_unit", "nonunit"), codes.fill_blank("curr_unit", "nonunit"))
    return t.fx_transfers.select("event_id", pair.alias("pair"))


@query(with_fx("SELECT entity_id AS entity_part, stay_id AS stay_part FROM fx_stays"))
def split_key(t):
    key = F.concat_ws("-", F.col("entity_id"), F.col("stay_id"))
    parts = F.split(F.col("key"), "-")
    return t.fx_stays.select(key.alias("key")).select(
        parts[0].cast("bigint").alias("entity_part"), parts[1].cast("bigint").alias("stay_part")
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 12 THEN 1 ELSE 0 END AS over_12, "
       "CASE WHEN l_quantity > 18 THEN 1 ELSE 0 END AS over_18 FROM lineitem")
def binarize_label(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        codes.exceeds("l_quantity", 12).alias("over_12"), codes.exceeds("l_quantity", 18).alias("over_18"),
    )


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 12")
def short_range_subset(t):
    return t.lineitem.filter(F.col("l_quantity") <= 12).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "SELECT o_orderstatus, count(*) AS n_rows, count(CASE WHEN l_shipdate < o_orderdate THEN 1 END) AS n_negative, "
    "count(CASE WHEN floor(date_diff('day', o_orderdate, l_shipdate) / 365.0) < 1 THEN 1 END) AS n_under_age, "
    "count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS n_missing_prev "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus"
)
def dq_negative_duration(t):
    both = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("o_orderstatus").agg(
        F.count("*").alias("n_rows"),
        F.count_if(times.is_negative_span("o_orderdate", "l_shipdate")).alias("n_negative"),
        F.count_if(times.age_in_years("o_orderdate", "l_shipdate") < 1).alias("n_under_age"),
        F.count_if(F.col("l_returnflag") == "N").alias("n_missing_prev"),
    )
