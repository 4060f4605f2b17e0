"""Composite data-flow operators and window logic over stays."""

from pyspark.sql import functions as F

from staywise.functions import codes, times
from staywise.functions.aggregates import correlation
from staywise.operators import cohort, groups, split, stats, stays, transitions
from staywise.plans import admission, clinical
from staywise.plans.composite import CompositeSpec
from staywise.plans.composite import composite_features as build_composite
from staywise.plans.demographics import demographics as build_demographics
from workload.aggregates import LOS_SQL, PAIRS_SQL, PER_ADMISSION_SQL, PROCEDURES_SQL, per_admission, procedures
from workload.base import EXCLUDED, HANDOFF_UNITS, UNIT_CODES, WINDOW_DAYS, query, with_fx
from workload.filters import GAPS, KEYWORD_GROUPS
from workload.filters import readmissions as gaps_of
from workload.joins import ENDPOINTS_SQL, ERRORS_SQL, HANDOFF_SQL, IN_STAY_SQL, endpoints

PAIRS = (
    "nonunit-view", "nonunit-click", "nonunit-purchase", "view-view", "view-click",
    "view-purchase", "click-view", "click-click", "click-purchase", "purchase-view",
)
SPEC = CompositeSpec(
    window_days=WINDOW_DAYS,
    unit_codes=UNIT_CODES,
    handoff_units=HANDOFF_UNITS,
    flag_bounds=(0, 4),
    excluded_stay_units=EXCLUDED,
    excluded_pair_units=EXCLUDED,
    blank_unit="nonunit",
    pairs=PAIRS,
)


@query(with_fx("SELECT event_id, entity_id, admission_id, coalesce(stay_id, -1) AS stay_id, eventtype, prev_unit, curr_unit, intime, outtime, value FROM fx_transfers"))
def fx_transfers(t):
    return t.fx_transfers.na.fill(-1, ["stay_id"])


@query(with_fx("SELECT entity_id, stay_id, readm_days FROM readm", GAPS))
def readm_gap(t):
    return gaps_of(t).select("entity_id", "stay_id", "readm_days")


@query(
    with_fx(
        "SELECT entity_id, stay_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY stay_in, stay_id) - 1 AS INTEGER) AS readm_risk "
        "FROM readm WHERE readm_days <= 1",
        GAPS,
    )
)
def readm_risk(t):
    near = stays.within_days(gaps_of(t), WINDOW_DAYS)
    return stays.risk_counts(near, hot=t.hot).select("entity_id", "stay_id", "readm_risk")


@query(
    with_fx(
        "SELECT entity_id, stay_id, CASE WHEN rn <= (CASE WHEN n > 2 THEN round_even(n * 0.8, 0) ELSE 1 END) THEN 'train' ELSE 'test' END AS part "
        "FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY stay_in, stay_id) AS rn, count(*) OVER (PARTITION BY entity_id) AS n FROM fx_stays) q"
    )
)
def split_by_entity(t):
    parted = split.split_by_entity(t.fx_stays, "entity_id", "stay_in", "stay_id", 0.8, hot=t.hot)
    return parted.select("entity_id", "stay_id", "part")


@query(
    with_fx(
        "SELECT admission_id, CAST(row_number() OVER (PARTITION BY admission_id ORDER BY intime, event_id) AS INTEGER) AS step, "
        "curr_unit AS unit FROM fx_transfers"
    )
)
def transfer_path(t):
    moves = t.fx_transfers.select("entity_id", "admission_id", "intime", "event_id", "curr_unit")
    return stays.transfer_path(moves, entity="entity_id", hot=t.hot)


@query(with_fx("SELECT entity_id, stay_id, stay_in, stay_out, readm_days, prev_stay_id FROM readm", GAPS))
def readmissions(t):
    return gaps_of(t).select("entity_id", "stay_id", "stay_in", "stay_out", "readm_days", "prev_stay_id")


@query(
    with_fx(
        "SELECT entity_id, stay_id, readm_days FROM readm WHERE stay_id NOT IN (SELECT stay_id FROM fx_transfers WHERE curr_unit = 'error' "
        "AND stay_id IS NOT NULL) AND entity_id IN (SELECT entity_id FROM fx_stays GROUP BY 1 HAVING count(*) > 1)",
        GAPS,
    )
)
def apply_exclusions(t):
    keep = cohort.multi_stay_entities(t.fx_stays)
    kept = cohort.apply_exclusions(gaps_of(t), t.fx_transfers, EXCLUDED, keep)
    return kept.select("entity_id", "stay_id", "readm_days")


@query(with_fx("SELECT r.entity_id, r.stay_id, round_even(p.los, 6) AS prev_los FROM readm r LEFT JOIN los p ON r.prev_stay_id = p.stay_id", GAPS, LOS_SQL))
def prev_los(t):
    return gaps_of(t).select("entity_id", "stay_id", F.bround("prev_los", 6).alias("prev_los"))


@query(
    with_fx(
        "SELECT r.entity_id, r.stay_id, n.n AS n_transfers FROM readm r LEFT JOIN "
        "(SELECT stay_id, count(*) AS n FROM fx_transfers WHERE stay_id IS NOT NULL GROUP BY 1) n ON r.stay_id = n.stay_id",
        GAPS,
    )
)
def transfers_per_stay(t):
    table = stays.collapse_stays(t.fx_transfers, extra=[F.count("*").alias("n_transfers")])
    return stays.readmissions(table, hot=t.hot).select("entity_id", "stay_id", "n_transfers")


CODE_SQL = "CASE {} WHEN '' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END"


@query(
    with_fx(
        "SELECT s.entity_id, s.stay_id, " + CODE_SQL.format("f.curr_unit") + " AS curr_cu, " + CODE_SQL.format("f.prev_unit") + " AS prev_cu, "
        "CASE WHEN f.prev_unit IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END AS prev_flag FROM fx_stays s JOIN "
        "(SELECT *, row_number() OVER (PARTITION BY stay_id, intime ORDER BY event_id) AS rn FROM fx_transfers WHERE stay_id IS NOT NULL) f "
        "ON s.stay_id = f.stay_id AND s.stay_in = f.intime AND rn = 1"
    )
)
def unit_at_start(t):
    table = stays.collapse_stays(t.fx_transfers, extra=stays.unit_at_start_aggregates())
    coded = table.withColumns(
        {"curr_cu": codes.encode("first_unit", UNIT_CODES), "prev_cu": codes.encode("unit_before", UNIT_CODES)}
    )
    return coded.select("entity_id", "stay_id", "curr_cu", "prev_cu", codes.flag_between("prev_cu", 0, 4).alias("prev_flag"))


AFTER_SQL = """
after AS (
SELECT s.entity_id, s.stay_id, h.next_unit FROM fx_stays s JOIN
  (SELECT *, row_number() OVER (PARTITION BY entity_id, handoff_at, stay_id ORDER BY next_event_id) AS rn FROM handoff) h
  ON s.entity_id = h.entity_id AND s.stay_id = h.stay_id AND s.stay_out = h.handoff_at AND rn = 1)"""


@query(
    with_fx(
        "SELECT entity_id, stay_id, " + CODE_SQL.format("next_unit") + " AS disch_cu, "
        "CASE WHEN next_unit IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END AS disch_flag FROM after",
        HANDOFF_SQL,
        AFTER_SQL,
    )
)
def unit_after_stay(t):
    table = stays.collapse_stays(t.fx_transfers, extra=[stays.unit_end_aggregate(HANDOFF_UNITS)])
    moved = stays.unit_after_stay(table, t.fx_transfers, HANDOFF_UNITS)
    coded = moved.withColumn("disch_cu", codes.encode("next_unit", UNIT_CODES))
    return coded.select("entity_id", "stay_id", "disch_cu", codes.flag_between("disch_cu", 0, 4).alias("disch_flag"))


@query(
    with_fx(
        "SELECT stay_id, CASE WHEN hour(stay_in) BETWEEN 6 AND 18 THEN 1 ELSE 0 END AS in_day, "
        "CASE WHEN hour(stay_out) BETWEEN 6 AND 18 THEN 1 ELSE 0 END AS out_day FROM fx_stays"
    )
)
def stay_day_night(t):
    return stays.with_day_flags(t.fx_stays).select("stay_id", "in_day", "out_day")


COMPOSITE_SQL = with_fx(
    "SELECT r.entity_id, r.admission_id, r.stay_id, r.readm_days, p.los AS prev_los, r.n_transfers, "
    + CODE_SQL.format("f.curr_unit") + " AS curr_cu, " + CODE_SQL.format("f.prev_unit") + " AS prev_cu, "
    "CASE WHEN f.prev_unit IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END AS prev_flag, "
    + CODE_SQL.format("a.next_unit") + " AS disch_cu, "
    "CASE WHEN a.next_unit IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END AS disch_flag, "
    "CASE WHEN hour(r.stay_in) BETWEEN 6 AND 18 THEN 1 ELSE 0 END AS in_day, "
    "CASE WHEN hour(r.stay_out) BETWEEN 6 AND 18 THEN 1 ELSE 0 END AS out_day, "
    "CAST(row_number() OVER (PARTITION BY r.entity_id ORDER BY r.stay_in, r.stay_id) - 1 AS INTEGER) AS readm_risk, "
    + ", ".join(
        f"round_even(coalesce(w.n_{i}, 0) * coalesce((SELECT prob FROM probs WHERE p || '-' || c = '{pair}'), 0), 3) AS "
        + "pair_" + pair.replace("-", "_")
        for i, pair in enumerate(PAIRS)
    )
    + ", l.los FROM readm r JOIN after a ON r.stay_id = a.stay_id LEFT JOIN los l ON r.stay_id = l.stay_id "
    "LEFT JOIN los p ON r.prev_stay_id = p.stay_id JOIN fx_transfers f ON f.stay_id = r.stay_id AND f.intime = r.stay_in "
    "LEFT JOIN counts w ON w.stay_id = r.stay_id "
    "WHERE r.readm_days <= 1 AND r.stay_id NOT IN (SELECT stay_id FROM fx_transfers WHERE curr_unit = 'error' AND stay_id IS NOT NULL)",
    GAPS,
    LOS_SQL,
    HANDOFF_SQL,
    AFTER_SQL,
    PAIRS_SQL,
    "counts AS (SELECT stay_id, "
    + ", ".join(f"count(CASE WHEN pair = '{pair}' THEN 1 END) AS n_{i}" for i, pair in enumerate(PAIRS))
    + " FROM pairs GROUP BY stay_id)",
)


@query(COMPOSITE_SQL)
def composite_features(t):
    return build_composite(t.fx_transfers, SPEC, hot=t.hot)


FIRST_ORDERS_SQL = """
persons AS (SELECT o_custkey AS custkey, min(o_orderdate) AS born FROM orders GROUP BY 1),
cases AS (SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_orderdate AS opened FROM orders),
admitted AS (
SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_orderdate AS opened, c_mktsegment || ' ' || o_orderpriority AS descr,
       o_orderpriority AS priority, c_mktsegment AS segment, o_orderstatus AS status
FROM orders JOIN customer ON o_custkey = c_custkey)"""
DESCR_RULES = (("urgent", ("urgent",)), ("machine", ("machinery", "automobile")), ("low", ("low",)), ("na", ("not specified",)))
DESCR_CODES = {"urgent": 0, "machine": 1, "low": 2, "other": 3, "na": 4}
PRIORITY_CODES = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}


@query(
    f"WITH {FIRST_ORDERS_SQL}, aged AS (SELECT c.*, CAST(trunc(date_diff('day', p.born, c.opened) / 365.0) AS INTEGER) AS age0 "
    "FROM cases c LEFT JOIN persons p USING (custkey)), "
    "firsts AS (SELECT custkey, descr FROM (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY opened, orderkey) AS rn FROM admitted) q WHERE rn = 1) "
    "SELECT a.custkey, a.orderkey, CASE WHEN age0 > 5 THEN age0 - 2 ELSE age0 END AS age, "
    "CASE WHEN lower(f.descr) LIKE '%urgent%' THEN 0 WHEN lower(f.descr) LIKE '%machinery%' OR lower(f.descr) LIKE '%automobile%' THEN 1 "
    "WHEN lower(f.descr) LIKE '%low%' THEN 2 WHEN lower(f.descr) LIKE '%not specified%' THEN 4 ELSE 3 END AS ethnicity, "
    "CASE d.priority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END AS marital_status, "
    "CASE d.status WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS insurance, "
    "CASE WHEN d.segment = 'BUILDING' THEN 0 ELSE 1 END AS non_home_language "
    "FROM aged a JOIN firsts f USING (custkey) JOIN admitted d ON a.orderkey = d.orderkey WHERE CASE WHEN age0 > 5 THEN age0 - 2 ELSE age0 END > 1"
)
def demographics(t):
    cases = t.orders.select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderdate").alias("opened")
    )
    persons = cases.groupBy("custkey").agg(F.min("opened").alias("born"))
    admissions = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderkey").alias("orderkey"),
        F.col("o_orderdate").alias("opened"),
        F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("descr"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderstatus").alias("status"),
    )
    full = build_demographics(
        cases, persons, admissions,
        entity="custkey", admission="orderkey", at="opened", born="born", order=["opened", "orderkey"],
        group_text="descr", group_rules=DESCR_RULES, group_codes=DESCR_CODES,
        coded={"marital_status": ("priority", PRIORITY_CODES), "insurance": ("status", {"F": 0, "O": 1, "P": 2})},
        language="segment", home_language="BUILDING", above=1,
        age=times.unshift_age(times.age_truncated("born", "opened"), above=5, shift=2),
    )
    return full.drop("opened")


@query(
    with_fx(
        "SELECT s.entity_id, s.admission_id, s.stay_id, i.surg, coalesce(l.abnormal, 0) AS abnormal_lab, coalesce(p.op_first, 0) AS op_first, "
        "coalesce(p.op_second, 0) AS op_second, coalesce(p.op_third, 0) AS op_third, coalesce(p.op_fourth, 0) AS op_fourth, "
        "coalesce(p.num_operations, 0) AS num_operations "
        "FROM fx_stays s JOIN in_stay i ON s.stay_id = i.stay_id LEFT JOIN latest l ON s.stay_id = l.stay_id "
        "LEFT JOIN procedures p ON s.entity_id = p.l_orderkey",
        IN_STAY_SQL,
        ERRORS_SQL,
        "sales AS (SELECT l_orderkey, l_linenumber, replace(p_brand, 'Brand#', '') AS code FROM lineitem JOIN part ON l_partkey = p_partkey)",
        PROCEDURES_SQL,
    )
)
def clinical_flags(t):
    purchases = t.fx_transfers.filter(F.col("curr_unit") == "purchase").select("entity_id", "intime", "event_id")
    labs = t.fx_transfers.filter(F.col("curr_unit") == "error").select(
        "admission_id", "entity_id", "intime", "event_id", F.when(F.col("value") > 50, 1).otherwise(0).alias("abnormal")
    )
    flags = procedures(t).withColumnRenamed("l_orderkey", "entity_id")
    base = t.fx_stays.select("entity_id", "admission_id", "stay_id", "stay_in", "stay_out")
    return clinical.clinical_flags(
        base, purchases, labs, flags,
        service_by=["entity_id"], lab_by=["entity_id", "admission_id"], service_time="intime", service_tie="event_id",
        lab_time="intime", lab_tie="event_id", abnormal="abnormal", procedure_keys=["entity_id"], hot=t.hot,
    ).drop("stay_in", "stay_out")


GROUPED_SQL = """
grouped AS (
SELECT p_partkey, p_name, 'coloured' AS grp FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%blue%'
UNION ALL SELECT p_partkey, p_name, 'thermal' FROM part WHERE lower(p_name) LIKE '%hot%' OR lower(p_name) LIKE '%cold%'
UNION ALL SELECT p_partkey, p_name, 'aged_widget' FROM part WHERE (lower(p_name) LIKE '%new%' OR lower(p_name) LIKE '%old%') AND lower(p_name) LIKE '%widget%'
UNION ALL SELECT p_partkey, p_name, 'aged_plain' FROM part WHERE (lower(p_name) LIKE '%new%' OR lower(p_name) LIKE '%old%') AND lower(p_name) NOT LIKE '%widget%'),
strata AS (SELECT * FROM grouped UNION ALL SELECT p_partkey, p_name, 'other' FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM grouped))"""


@query(f"WITH {GROUPED_SQL} SELECT l_orderkey, l_linenumber, l_partkey, grp FROM lineitem JOIN strata ON l_partkey = p_partkey")
def stratify_groups(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    names = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return groups.stratify_by_code(rows, names, "l_partkey", "p_name", KEYWORD_GROUPS).select(
        "l_orderkey", "l_linenumber", "l_partkey", "grp"
    )


SHARE_SQL = """
SELECT '{0}' AS kind, pair, count(*) AS n_trans, round_even(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share, {1} AS prob
FROM {2} GROUP BY pair, a, b"""
PROB = "round_even(count(*) / CAST(sum(count(*)) OVER (PARTITION BY b) AS DOUBLE), 6)"


@query(
    with_fx(
        SHARE_SQL.format("endpoint", PROB, "ends") + " UNION ALL " + SHARE_SQL.format("all_moves", PROB, "every_move")
        + " UNION ALL " + SHARE_SQL.format("in_stay", PROB, "inside"),
        ENDPOINTS_SQL,
        "ends AS (SELECT first_unit AS a, last_unit AS b, first_unit || '-' || last_unit AS pair FROM endpoints "
        "WHERE first_unit <> 'error' AND last_unit <> 'error' AND entity_id IN (SELECT entity_id FROM multi))",
        "every_move AS (SELECT *, a || '-' || b AS pair FROM (SELECT stay_id, coalesce(nullif(prev_unit, ''), 'nonunit') AS a, "
        "coalesce(nullif(curr_unit, ''), 'nonunit') AS b FROM fx_transfers WHERE prev_unit <> 'error' AND curr_unit <> 'error' "
        "AND entity_id IN (SELECT entity_id FROM multi)) q)",
        "inside AS (SELECT * FROM every_move WHERE stay_id IS NOT NULL)",
    )
)
def endpoint_pairs(t):
    ends = endpoints(t).select(F.col("first_unit").alias("prev_unit"), F.col("last_unit").alias("curr_unit"))
    moves = cohort.keep_entities(t.fx_transfers, cohort.multi_stay_entities(t.fx_stays))
    kinds = {
        "endpoint": ends,
        "all_moves": moves,
        "in_stay": moves.filter(F.col("stay_id").isNotNull()),
    }
    out = None
    for kind, frame in kinds.items():
        labelled = transitions.label_pairs(frame, excluded=EXCLUDED, blank="nonunit")
        table = transitions.pair_table(labelled).withColumn("kind", F.lit(kind))
        out = table if out is None else out.unionByName(table)
    return out.select("kind", "pair", "n_trans", "share", "prob")


def correlation_sql(rows: str) -> str:
    return (
        "SELECT count(*) AS n_rows, round_even(avg(n_trav), 6) AS mean_trav, round_even(corr(n_trav, n_readm), 6) AS pearson, "
        "round_even(corr(ra, rb), 6) AS spearman FROM (SELECT n_trav, n_readm, "
        "rank() OVER (ORDER BY n_trav) + (count(*) OVER (PARTITION BY n_trav) - 1) / 2.0 AS ra, "
        "rank() OVER (ORDER BY n_readm) + (count(*) OVER (PARTITION BY n_readm) - 1) / 2.0 AS rb "
        f"FROM {rows}) z"
    )


@query(with_fx(correlation_sql("per_admission"), PER_ADMISSION_SQL))
def transfers_vs_readm(t):
    return stats.correlation_summary(per_admission(t), "n_trav", "n_readm")


def per_part_of_day_sql(label: str) -> str:
    return (
        "(SELECT f.admission_id, count(*) AS n_trav, max(m.n) - 1 AS n_readm FROM fx_transfers f JOIN "
        "(SELECT entity_id, count(*) AS n FROM fx_stays GROUP BY 1 HAVING count(*) > 1) m ON f.entity_id = m.entity_id "
        f"WHERE CASE WHEN hour(f.intime) BETWEEN 6 AND 18 THEN 'day' ELSE 'night' END = '{label}' GROUP BY 1) y"
    )


@query(
    with_fx(
        " UNION ALL ".join(
            f"SELECT '{label}' AS part_of_day, * FROM (" + correlation_sql(per_part_of_day_sql(label)) + ") x"
            for label in ("day", "night")
        )
    )
)
def transfers_vs_readm_daynight(t):
    label = times.day_label("intime").alias("part_of_day")
    counts = t.fx_transfers.groupBy("entity_id", "admission_id", label).agg(F.count("*").alias("n_trav"))
    joined = counts.join(cohort.multi_stay_entities(t.fx_stays), "entity_id").select(
        "part_of_day", "n_trav", (F.col("n_stays") - 1).alias("n_readm")
    )
    out = None
    for part in ("day", "night"):
        table = stats.correlation_summary(joined.filter(F.col("part_of_day") == part), "n_trav", "n_readm")
        table = table.withColumn("part_of_day", F.lit(part))
        out = table if out is None else out.unionByName(table)
    return out


@query(
    with_fx(
        "SELECT f.entity_id, f.admission_id, max(m.n_stays) - 1 AS n_readm, count(*) AS n_trav, count(f.stay_id) AS n_icutrav, "
        "count(DISTINCT f.stay_id) AS n_stays, round_even(avg(CASE WHEN f.stay_id IS NOT NULL THEN date_diff('microsecond', f.intime, f.outtime) / 86400000000.0 END), 6) AS avg_los, "
        + ", ".join(
            f"round_even(max(coalesce(w.n_{i}, 0)) * coalesce((SELECT prob FROM probs WHERE p || '-' || c = '{pair}'), 0), 3) AS "
            + "pair_" + pair.replace("-", "_")
            for i, pair in enumerate(PAIRS)
        )
        + " FROM fx_transfers f JOIN multi m ON f.entity_id = m.entity_id LEFT JOIN counts w ON w.entity_id = f.entity_id "
        "WHERE f.prev_unit <> 'error' AND f.curr_unit <> 'error' "
        "GROUP BY f.entity_id, f.admission_id HAVING count(f.stay_id) > 0",
        ENDPOINTS_SQL,
        PAIRS_SQL,
        "counts AS (SELECT entity_id, "
        + ", ".join(f"count(CASE WHEN pair = '{pair}' THEN 1 END) AS n_{i}" for i, pair in enumerate(PAIRS))
        + " FROM pairs GROUP BY entity_id)",
    )
)
def admission_features(t):
    return admission.admission_features(t.fx_transfers, t.fx_stays, SPEC)


@query(
    with_fx(
        "SELECT count(*) AS n_admissions, round_even(avg(days), 6) AS mean_days, round_even(corr(days, n), 6) AS pearson FROM "
        "(SELECT a.admission_id, date_diff('day', TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-01' + (a.hi - a.lo)) AS days, n FROM "
        "(SELECT admission_id, min(intime) AS lo, max(outtime) AS hi FROM fx_transfers GROUP BY 1) a JOIN "
        "(SELECT admission_id, count(*) AS n FROM fx_stays GROUP BY 1) s ON a.admission_id = s.admission_id) q"
    )
)
def los_vs_stays(t):
    spans = t.fx_transfers.groupBy("entity_id", "admission_id").agg(F.min("intime").alias("lo"), F.max("outtime").alias("hi"))
    counts = t.fx_stays.groupBy("entity_id", "admission_id").agg(F.count("*").alias("n"))
    joined = spans.join(counts, ["entity_id", "admission_id"]).select(times.whole_days("lo", "hi").alias("days"), "n")
    return joined.agg(
        F.count("*").alias("n_admissions"),
        F.bround(F.avg("days"), 6).alias("mean_days"),
        F.bround(correlation("days", "n"), 6).alias("pearson"),
    )

