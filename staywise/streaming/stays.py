"""Stays from a stream of unit events: a stateful sessionisation behind a watermark.

Events may arrive in any order within ``delay``. Entities are dealt into ``BUCKETS`` groups, whose state holds that of
their entities: a batch starts a worker function per group, not per entity. Per entity the state holds the events that the watermark has not
passed, so at most those of one delay, and of the open stay its sums: nothing grows with the length of a stay or the
number of stays. Once the watermark passes an event it is taken in the order of (time, event) and either goes on with
the open stay or closes it. A stay whose gap the watermark has passed is closed by a timeout, without a further event.

Closed stays are appended, one row each, with the meaning of the batch form: an event more than ``stay_hours`` after
the one before starts a stay, more than ``admission_hours`` an admission; both are named by their first event. Events
without a unit keep a stay open but are not part of it; a stay of such events only gives no row. An event lasts until
the next one in its stay, the last one an hour. Events later than ``delay`` are dropped by the watermark; events with
a NULL time or entity belong to no stay and are left out.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "entity_id long, admission_id long, stay_id long, stay_in long, stay_out long, n_transfers long, sum_value double, n_values long"
HOUR = 3_600_000_000  # microseconds
BUCKETS = 2048


class OpenStay:
    """The stay that goes on, and the event that came last; times in microseconds."""

    def __init__(self, stay_hours: float, admission_hours: float, kept: dict | None):
        self.stay_gap, self.admission_gap = int(stay_hours * HOUR), int(admission_hours * HOUR)
        self.now = kept or {"last": None, "unit": False, "admission": None, "stay": None, "in": None, "out": None, "n": 0, "s": 0.0, "v": 0}

    def close(self) -> tuple | None:
        """The row of the open stay, None if it had no event with a unit."""
        now = self.now
        if now["stay"] is None or not now["n"]:
            return None
        out = now["last"] + HOUR if now["unit"] else now["out"]
        return now["admission"], now["stay"], now["in"], out, now["n"], now["s"], now["v"]

    def add(self, at: int, event: int, unit: bool, value: float | None) -> tuple | None:
        """Take the next event; the row of the stay that it closed, if any."""
        now, closed = self.now, None
        gap = None if now["last"] is None else at - now["last"]
        if gap is None or gap > self.stay_gap:
            closed = self.close()
        if gap is None or gap > self.admission_gap:
            now["admission"] = event
        if gap is None or gap > self.stay_gap:
            now |= {"stay": event, "in": None, "out": None, "n": 0, "s": 0.0, "v": 0}
        elif now["unit"]:
            now["out"] = at  # the event before lasted until this one
        if unit:
            now["in"] = at if now["in"] is None else now["in"]
            now["n"] += 1
            if value is not None:
                now["s"], now["v"] = now["s"] + value, now["v"] + 1
        now["last"], now["unit"] = at, unit
        return closed

    def ends(self) -> int | None:
        """When the open stay and admission can no longer go on."""
        return None if self.now["last"] is None else self.now["last"] + max(self.stay_gap, self.admission_gap)


def stays_from_stream(events: DataFrame, delay: str = "1 hour", stay_hours: float = 12, admission_hours: float = 24) -> DataFrame:
    """Closed stays of a stream of (event_id, entity_id, ts, unit, value); a unit of '' or NULL is none."""
    bucket = F.pmod(F.xxhash64("entity_id"), F.lit(BUCKETS)).alias("bucket")
    clean = events.filter("entity_id is not null and ts is not null").select(
        bucket, "entity_id", "event_id", "ts", F.unix_micros("ts").alias("at"), (F.coalesce("unit", F.lit("")) != "").alias("unit"), F.col("value").cast("double").alias("value")
    )

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entities = {e: (wait, now) for e, wait, now in json.loads(state.get[0])} if state.exists else {}
        new: dict[int, list] = {}
        for part in parts:
            for entity, at, event, unit, value in zip(*(part[c].tolist() for c in ("entity_id", "at", "event_id", "unit", "value"))):
                new.setdefault(int(entity), []).append((int(at), int(event), bool(unit), None if pd.isna(value) else float(value)))
        mark = state.getCurrentWatermarkMs()
        passed, kept, rows, wake = mark * 1000, [], [], None
        for entity in entities.keys() | new.keys():
            wait, now = entities.get(entity, ([], None))
            if entity in new:
                wait = sorted([*map(tuple, wait), *new[entity]], key=lambda e: e[:2])
            stay = OpenStay(stay_hours, admission_hours, now)
            ready = sum(e[0] < passed for e in wait)
            for event in wait[:ready]:
                rows.append((entity, stay.add(*event)))
            wait, ends = wait[ready:], stay.ends()
            if not wait and ends is not None and ends < passed:
                rows.append((entity, stay.close()))
                continue
            kept.append((entity, wait, stay.now))
            # wake when the watermark passes the first waiting event, or the end of what is open
            wake = min([t for t in (wake, ends) if t is not None] + [e[0] for e in wait[:1]], default=None)
        if kept:
            state.update((json.dumps(kept),))
            state.setTimeoutTimestamp(max((passed if wake is None else wake) // 1000, mark) + 1)
        elif state.exists:
            state.remove()
        rows = [(entity, *r) for entity, r in rows if r is not None]
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    closed = (
        clean.withWatermark("ts", delay)
        .groupBy("bucket")
        .applyInPandasWithState(run, OUT, "state string", "append", GroupStateTimeout.EventTimeTimeout)
    )
    return closed.withColumns({c: F.timestamp_micros(c) for c in ("stay_in", "stay_out")})


def run_to_end(stays: DataFrame, folder: str) -> DataFrame:
    """Run the stream over all files there are, append its stays below ``folder`` and read them back."""
    out = f"{folder}/stays"
    query = (
        stays.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stays.sparkSession.read.schema(stays.schema).parquet(out)


def event_files(spark: SparkSession, folder: str, schema, files: int | None = None) -> DataFrame:
    """The stream of a folder's Parquet files, ``files`` at a time in the order of their arrival, or all there are."""
    stream = spark.readStream.schema(schema)
    return (stream if files is None else stream.option("maxFilesPerTrigger", files)).parquet(folder)


# worker functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
