"""Stays from a stream of the events, unordered and late, next to the batch form's SQL (A4)."""

from pyspark.sql import functions as F

from staywise.functions.codes import hash_unit
from staywise.session import work_folder
from staywise.streaming.stays import event_files, run_to_end, stays_from_stream
from workload.base import query, with_fx

LATE_HOURS = 24
LOTS = 3


@query(
    with_fx(
        "SELECT entity_id, admission_id, stay_id, stay_in, stay_out, n_transfers, round_even(avg_value, 6) AS avg_value FROM fx_stays"
    )
)
def stream_stays(t):
    """The events arrive up to a day late, in lots; an end mark far behind lets the watermark pass them all.

    The stream takes up each lot whole, however many files it has: a part of one would move the watermark past the rest.
    """
    folder = work_folder(t.spark)
    unit = F.when(F.col("event_type") == "signup", "").otherwise(F.col("event_type"))
    events = t.events.select("event_id", F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"), unit.alias("unit"), "value")
    arrival = F.unix_seconds("ts") + F.floor(hash_unit("late", "event_id") * LATE_HOURS * 3600)
    cuts = events.agg(F.percentile_approx(arrival, [i / LOTS for i in range(1, LOTS)]).alias("c")).first()["c"]
    arriving = events.withColumn("lot", sum(((arrival > c).cast("int") for c in cuts), F.lit(0)))

    def take_up():
        return run_to_end(stays_from_stream(event_files(t.spark, f"{folder}/in", events.schema), f"{LATE_HOURS} hours"), folder)

    for lot in range(LOTS):
        arriving.filter(F.col("lot") == lot).drop("lot").write.mode("append").parquet(f"{folder}/in")
        take_up()
    end = events.agg(
        F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("entity_id"),
        F.max("ts").alias("ts"), F.lit("").alias("unit"), F.lit(None).cast("double").alias("value"),
    )
    end.withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 DAYS")).write.mode("append").parquet(f"{folder}/in")
    closed = take_up()
    kind = dict(t.events.dtypes)["ts"]
    return closed.select(
        "entity_id", "admission_id", "stay_id", F.col("stay_in").cast(kind).alias("stay_in"), F.col("stay_out").cast(kind).alias("stay_out"),
        "n_transfers", F.bround(F.col("sum_value") / F.nullif("n_values", F.lit(0)), 6).alias("avg_value"),
    )
