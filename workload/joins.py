"""Joins (J1-J13)."""

from pyspark.sql import functions as F

from staywise.operators import asof, cohort, stats, stays
from workload.base import HANDOFF_UNITS, query, with_fx
from workload.filters import GAPS, SEGMENT_CODES, readmissions


@query(
    "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0"
)
def join_inner(t):
    owing = t.customer.filter(F.col("c_acctbal") < 0).select("c_custkey", "c_name")
    return t.orders.join(owing, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query(
    "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN "
    "(SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) q ON c_custkey = o_custkey"
)
def join_left(t):
    counts = t.orders.filter(F.col("o_orderstatus") == "F").groupBy(F.col("o_custkey").alias("c_custkey")).count()
    joined = t.customer.select("c_custkey").join(counts, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("count", F.lit(0)).alias("n_orders"))


@query(
    "SELECT l.o, l.n, l.qty, coalesce(r.price, 0.0) AS price FROM "
    "(SELECT l_orderkey AS o, l_linenumber AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY 1, 2) l "
    "LEFT JOIN (SELECT l_orderkey AS o, l_linenumber AS n, max(l_extendedprice) AS price FROM lineitem "
    "WHERE l_returnflag = 'R' GROUP BY 1, 2) r ON l.o = r.o AND l.n = r.n"
)
def join_left_multi(t):
    keys = [F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")]
    every = t.lineitem.groupBy(*keys).agg(F.sum("l_quantity").alias("qty"))
    returned = t.lineitem.filter(F.col("l_returnflag") == "R").groupBy(*keys).agg(F.max("l_extendedprice").alias("price"))
    return every.join(returned, ["o", "n"], "left").na.fill(0.0, ["price"])


@query(with_fx("SELECT entity_id, stay_id, prev_stay_id, prev_out FROM gaps", GAPS))
def prev_stay_id(t):
    return readmissions(t).select("entity_id", "stay_id", "prev_stay_id", "prev_out")


@query(
    with_fx(
        "SELECT s.entity_id, s.stay_id, f.event_id, f.curr_unit FROM fx_stays s "
        "JOIN fx_transfers f ON s.entity_id = f.entity_id AND s.stay_in = f.intime"
    )
)
def join_inner_ts(t):
    starts = t.fx_transfers.select("entity_id", F.col("intime").alias("stay_in"), "event_id", "curr_unit")
    joined = t.fx_stays.select("entity_id", "stay_id", "stay_in").join(starts, ["entity_id", "stay_in"])
    return joined.select("entity_id", "stay_id", "event_id", "curr_unit")


HANDOFF_SQL = """
handoff AS (
SELECT t1.entity_id, t1.stay_id, t1.event_id, t1.outtime AS handoff_at, t2.event_id AS next_event_id, t2.curr_unit AS next_unit
FROM fx_transfers t1 JOIN fx_transfers t2 ON t1.entity_id = t2.entity_id AND t1.outtime = t2.intime
WHERE t1.curr_unit IN ('view', 'click', 'purchase', 'error') AND t2.prev_unit <> '')"""


@query(with_fx("SELECT * FROM handoff", HANDOFF_SQL))
def next_unit_after_stay(t):
    return stays.handoffs(t.fx_transfers, HANDOFF_UNITS)


ERRORS_SQL = """
errors AS (SELECT admission_id, intime, event_id, value FROM fx_transfers WHERE curr_unit = 'error'),
latest AS (
SELECT * FROM (
  SELECT s.entity_id, s.admission_id, s.stay_id, e.event_id AS fact_id, e.intime AS fact_at,
         CASE WHEN e.value > 50 THEN 1 ELSE 0 END AS abnormal,
         row_number() OVER (PARTITION BY s.stay_id ORDER BY e.intime DESC, e.event_id DESC) AS rk
  FROM fx_stays s JOIN errors e ON s.admission_id = e.admission_id AND e.intime <= s.stay_out) q
WHERE rk = 1)"""


def latest_error(t, how: str = "inner"):
    """Latest error row of the admission at or before the end of each stay."""
    facts = t.fx_transfers.filter(F.col("curr_unit") == "error").select(
        "entity_id", "admission_id", "intime", "event_id", "value"
    )
    return asof.asof_latest(
        t.fx_stays.select("entity_id", "admission_id", "stay_id", "stay_in", "stay_out"),
        facts,
        ["entity_id", "admission_id"],
        "stay_out",
        "intime",
        {
            "fact_id": F.col("event_id"),
            "fact_at": F.col("intime"),
            "abnormal": F.when(F.col("value") > 50, 1).otherwise(0),
        },
        tie="event_id",
        how=how,
        hot=t.hot,
    )


@query(with_fx("SELECT entity_id, stay_id, fact_id, fact_at, abnormal FROM latest", ERRORS_SQL))
def asof_latest_before(t):
    return latest_error(t).select("entity_id", "stay_id", "fact_id", "fact_at", "abnormal")


IN_STAY_SQL = """
in_stay AS (
SELECT s.entity_id, s.stay_id, CASE WHEN EXISTS (
    SELECT 1 FROM events e WHERE e.user_id = s.entity_id AND e.event_type = 'purchase'
    AND e.ts BETWEEN s.stay_in AND s.stay_out) THEN 1 ELSE 0 END AS surg
FROM fx_stays s)"""


def purchase_in_stay(t):
    events = t.events.filter(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("entity_id"), "ts", "event_id"
    )
    return asof.event_in_span(
        t.fx_stays.select("entity_id", "stay_id", "stay_in", "stay_out"),
        events, ["entity_id"], "stay_in", "stay_out", "ts", "event_id", name="surg", hot=t.hot,
    )


@query(with_fx("SELECT * FROM in_stay", IN_STAY_SQL))
def event_in_stay_flag(t):
    return purchase_in_stay(t).select("entity_id", "stay_id", "surg")


@query(
    "SELECT o_orderkey, n_lines, o_totalprice FROM orders JOIN "
    "(SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) q ON o_orderkey = l_orderkey"
)
def join_grouped(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    return t.orders.join(lines, "o_orderkey").select("o_orderkey", "n_lines", "o_totalprice")


@query(
    "SELECT o_orderkey, coalesce(m.code, -1) AS segment_code FROM orders JOIN customer ON o_custkey = c_custkey "
    "LEFT JOIN (VALUES ('AUTOMOBILE', 0), ('BUILDING', 1), ('FURNITURE', 2), ('HOUSEHOLD', 3)) m(seg, code) ON c_mktsegment = seg"
)
def map_lookup(t):
    # the code table is a literal list, so its broadcast size is fixed
    table = t.spark.createDataFrame(list(SEGMENT_CODES.items()), "c_mktsegment string, segment_code int")
    who = t.customer.join(F.broadcast(table), "c_mktsegment", "left").select(
        F.col("c_custkey").alias("o_custkey"), F.coalesce("segment_code", F.lit(-1)).alias("segment_code")
    )
    return t.orders.join(who, "o_custkey").select("o_orderkey", "segment_code")


ENDPOINTS_SQL = """
endpoints AS (
SELECT entity_id, stay_id, arg_min(curr_unit, intime) AS first_unit, arg_max(curr_unit, intime) AS last_unit
FROM fx_transfers WHERE stay_id IS NOT NULL GROUP BY entity_id, stay_id),
multi AS (SELECT entity_id, count(*) AS n_stays FROM fx_stays GROUP BY entity_id HAVING count(*) > 1)"""


def endpoints(t):
    """First and last unit of each stay of the entities with more than one stay."""
    at = F.struct("intime", "event_id")
    ends = t.fx_transfers.filter(F.col("stay_id").isNotNull()).groupBy("entity_id", "stay_id").agg(
        F.min_by("curr_unit", at).alias("first_unit"), F.max_by("curr_unit", at).alias("last_unit")
    )
    return cohort.keep_entities(ends, cohort.multi_stay_entities(t.fx_stays))


@query(
    with_fx(
        "SELECT coalesce(a.u, b.u) AS unit, CAST(coalesce(a.n, 0) AS BIGINT) AS n_first, CAST(coalesce(b.n, 0) AS BIGINT) AS n_last, "
        "round_even(coalesce(a.n, 0) * 100.0 / (SELECT count(*) FROM kept), 2) AS first_pct, "
        "round_even(coalesce(b.n, 0) * 100.0 / (SELECT count(*) FROM kept), 2) AS last_pct "
        "FROM (SELECT first_unit AS u, count(*) AS n FROM kept GROUP BY 1) a "
        "FULL JOIN (SELECT last_unit AS u, count(*) AS n FROM kept GROUP BY 1) b ON a.u = b.u",
        ENDPOINTS_SQL,
        "kept AS (SELECT * FROM endpoints WHERE entity_id IN (SELECT entity_id FROM multi))",
    )
)
def side_by_side_counts(t):
    return stats.side_by_side_counts(endpoints(t), "first_unit", "last_unit")
