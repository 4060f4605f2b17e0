"""Registry of queries over the given tables, each next to its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.operators.ordered import HotKeys, find_hot_keys
from staywise.operators.stays import collapse_stays, sessionise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UNITS = ("view", "click", "purchase")  # the unit types that count as stays of interest
HANDOFF_UNITS = (*UNITS, "error")  # a stay may end in any unit
EXCLUDED = ("error",)
WINDOW_DAYS = 1
UNIT_CODES = {"": 0, "view": 1, "click": 2, "purchase": 3, "error": 4}

FX_TRANSFERS = """
o AS (
  SELECT event_id, user_id, ts, value,
         CASE WHEN event_type = 'signup' THEN '' ELSE event_type END AS curr_unit,
         lag(ts) OVER w AS prev_ts, lead(ts) OVER w AS next_ts,
         coalesce(lag(CASE WHEN event_type = 'signup' THEN '' ELSE event_type END) OVER w, '') AS prev_unit
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (
  SELECT *,
         CASE WHEN prev_ts IS NULL OR ts > prev_ts + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new_stay,
         CASE WHEN prev_ts IS NULL OR ts > prev_ts + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS new_adm
  FROM o),
g AS (
  SELECT *,
         last_value(CASE WHEN new_stay = 1 THEN event_id END IGNORE NULLS)
           OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s,
         last_value(CASE WHEN new_adm = 1 THEN event_id END IGNORE NULLS)
           OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS a
  FROM b),
fx_transfers AS (
SELECT event_id, user_id AS entity_id,
       CAST(a AS BIGINT) AS admission_id,
       CASE WHEN curr_unit = '' THEN NULL ELSE CAST(s AS BIGINT) END AS stay_id,
       CASE WHEN prev_ts IS NULL THEN 'admit' WHEN next_ts IS NULL THEN 'discharge' ELSE 'transfer' END AS eventtype,
       prev_unit, curr_unit, ts AS intime,
       CASE WHEN next_ts <= ts + INTERVAL 12 HOUR THEN next_ts ELSE ts + INTERVAL 1 HOUR END AS outtime,
       value
FROM g)"""

FX_STAYS = """
fx_stays AS (
SELECT entity_id, admission_id, stay_id, min(intime) AS stay_in, max(outtime) AS stay_out,
       count(*) AS n_transfers, avg(value) AS avg_value
FROM fx_transfers WHERE stay_id IS NOT NULL
GROUP BY entity_id, admission_id, stay_id)"""

SALES = """
sales AS (
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, l_shipdate, p_name, p_brand, p_type, p_size, p_retailprice,
       replace(p_brand, 'Brand#', '') AS code
FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def with_fx(select: str, *more: str) -> str:
    """SQL over the transfer and stay views; ``more`` are further CTEs."""
    return "WITH " + ",".join([FX_TRANSFERS, FX_STAYS, *more]) + "\n" + select


def with_sales(select: str, *more: str) -> str:
    return "WITH " + ",".join([SALES, *more]) + "\n" + select


class Tables:
    """The given tables of one directory, plus the frames derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def hot(self) -> HotKeys:
        """Users with a large share of all events, under the name ``entity_id``."""
        return find_hot_keys(self.events, "user_id", "ts").renamed("entity_id")

    @cached_property
    def fx_transfers(self) -> DataFrame:
        unit = F.when(F.col("event_type") == "signup", "").otherwise(F.col("event_type"))
        events = self.events.select("event_id", F.col("user_id").alias("entity_id"), "ts", "value", unit.alias("curr_unit"))
        runs = sessionise(
            events,
            "entity_id",
            "ts",
            ["event_id"],
            gaps={"_stay": 12, "_admission": 24},
            carry={"_prev_unit": F.col("curr_unit")},
            hot=self.hot,
            mark=F.col("event_id"),
        )
        near = F.col("next_ts") <= F.col("ts") + F.expr("INTERVAL 12 HOURS")
        return runs.select(
            "event_id",
            "entity_id",
            F.col("_admission").cast("bigint").alias("admission_id"),
            F.when(F.col("curr_unit") != "", F.col("_stay").cast("bigint")).alias("stay_id"),
            F.when(F.col("prev_ts").isNull(), "admit")
            .when(F.col("next_ts").isNull(), "discharge")
            .otherwise("transfer")
            .alias("eventtype"),
            F.coalesce("_prev_unit", F.lit("")).alias("prev_unit"),
            "curr_unit",
            F.col("ts").alias("intime"),
            F.when(near, F.col("next_ts")).otherwise(F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("outtime"),
            "value",
        )

    @cached_property
    def fx_stays(self) -> DataFrame:
        return collapse_stays(
            self.fx_transfers, extra=[F.count("*").alias("n_transfers"), F.avg("value").alias("avg_value")]
        )

    @cached_property
    def sales(self) -> DataFrame:
        """Line items with their part; ``code`` is the brand number as text."""
        return self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).withColumn(
            "code", F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit(""))
        )


TASK_ROWS = 1_000_000  # of both sides of a join that one task sorts


def dealt(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by key, over more partitions than the session's where a task would sort more than ``TASK_ROWS`` rows."""
    wanted = -(-(left.count() + right.count()) // TASK_ROWS)
    if wanted <= int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return left, right
    return left.repartition(wanted, left_key), right.repartition(wanted, right_key)


def query(sql: str | None = None, name: str | None = None):
    """Register a function of :class:`Tables` under its own name."""

    def register(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register


__all__ = [
    "EXCLUDED", "HANDOFF_UNITS", "ORACLES", "QUERIES", "Tables", "UNITS", "UNIT_CODES", "WINDOW_DAYS", "dealt", "query",
    "with_fx", "with_sales",
]
