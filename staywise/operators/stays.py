"""Stay logic: collapse transfers, gaps, risk counts, units around a stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.functions.times import day_flag, days_between, micros_between
from staywise.operators.ordered import NO_HOT_KEYS, HotKeys, ordered

STAY_KEYS = ("entity_id", "admission_id", "stay_id")


def sessionise(
    events: DataFrame,
    entity: str,
    time: str,
    ties: Sequence[str],
    gaps: dict[str, int],
    carry: dict[str, Column],
    next_time: str = "next_ts",
    hot: HotKeys = NO_HOT_KEYS,
    mark: Column | None = None,
) -> DataFrame:
    """Number runs of events per entity: a new run starts after a pause longer than its gap.

    ``gaps`` maps each new counter to its pause in hours; ``carry`` maps new
    columns to expressions taken from the event before. With ``mark``, a column
    unique over all events, a run is named by the mark of its first event instead
    of a number: unique over all entities, without a ceiling.
    """
    stepped = ordered(
        events,
        [entity],
        time,
        ties,
        previous={"prev_ts": F.col(time), **carry},
        following={next_time: F.col(time)},
        hot=hot,
    )
    pause = micros_between("prev_ts", time)
    starts = {
        name: F.when(F.col("prev_ts").isNull() | (pause > hours * 3_600_000_000), 1).otherwise(0)
        for name, hours in gaps.items()
    }
    if mark is not None:
        names = {name: F.when(start == 1, mark) for name, start in starts.items()}
        return ordered(stepped, [entity], time, ties, latest=names, hot=hot)
    return ordered(stepped, [entity], time, ties, running=starts, hot=hot)


def collapse_stays(
    transfers: DataFrame,
    keys: Sequence[str] = STAY_KEYS,
    start: str = "intime",
    end: str = "outtime",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per stay with its first start and last end (A4); ``extra`` aggregates ride along."""
    return (
        transfers.filter(F.col(keys[-1]).isNotNull())
        .groupBy(*keys)
        .agg(F.min(start).alias("stay_in"), F.max(end).alias("stay_out"), *extra)
    )


def los_days(start: str = "stay_in", end: str = "stay_out", places: int | None = None) -> Column:
    return days_between(start, end, places)


def readmissions(
    stays: DataFrame,
    entity: str = "entity_id",
    stay: str = "stay_id",
    start: str = "stay_in",
    end: str = "stay_out",
    include_first: bool = False,
    hot: HotKeys = NO_HOT_KEYS,
    los: str | None = None,
) -> DataFrame:
    """Gap to the stay before, its id, end and length, from one pass per entity.

    The length is the ``los`` column when given, else end minus start. First
    stays have no gap; they are dropped unless ``include_first`` (Q1).
    """
    linked = ordered(
        stays,
        [entity],
        start,
        [stay],
        previous={
            "prev_stay_id": F.col(stay),
            "prev_out": F.col(end),
            "prev_los": F.col(los) if los else los_days(start, end),
        },
        hot=hot,
    ).withColumn("readm_days", days_between("prev_out", start))
    return linked if include_first else linked.filter(F.col("prev_out").isNotNull())


def within_days(df: DataFrame, days: float, gap: str = "readm_days") -> DataFrame:
    """Keep readmissions within the window."""
    return df.filter(F.col(gap) <= days)


def cutoff_counts(df: DataFrame, gap: str, cutoffs: Sequence[float]) -> DataFrame:
    """Rows within each cut-off, from one pass."""
    wide = df.agg(*[F.count_if(F.col(gap) <= c).alias(f"c{i}") for i, c in enumerate(cutoffs)])
    pairs = [F.struct(F.lit(c).alias("cutoff"), F.col(f"c{i}").alias("n_rows")) for i, c in enumerate(cutoffs)]
    return wide.select(F.explode(F.array(*pairs)).alias("p")).select("p.cutoff", "p.n_rows")


def risk_counts(
    df: DataFrame,
    entity: str = "entity_id",
    start: str = "stay_in",
    stay: str = "stay_id",
    hot: HotKeys = NO_HOT_KEYS,
) -> DataFrame:
    """0 for an entity's first row in the cohort, then 1, 2, ...."""
    counted = ordered(df, [entity], start, [stay], running={"_nth": F.lit(1)}, hot=hot)
    return counted.withColumn("readm_risk", (F.col("_nth") - 1).cast("int")).drop("_nth")


def unit_at_start_aggregates(
    start: str = "intime", tie: str = "event_id", unit: str = "curr_unit", prev_unit: str = "prev_unit"
) -> list[Column]:
    """Aggregates for :func:`collapse_stays`: unit at the start of a stay and the one before."""
    first = F.struct(start, tie)
    return [F.min_by(unit, first).alias("first_unit"), F.min_by(prev_unit, first).alias("unit_before")]


def handoffs(
    transfers: DataFrame,
    units: Sequence[str],
    entity: str = "entity_id",
    start: str = "intime",
    end: str = "outtime",
    unit: str = "curr_unit",
    prev_unit: str = "prev_unit",
) -> DataFrame:
    """Rows in one of ``units`` with the move that begins when they end, for the same entity."""
    left = transfers.filter(F.col(unit).isin(*units)).select(
        entity, "stay_id", F.col("event_id"), F.col(end).alias("handoff_at")
    )
    right = transfers.filter(F.col(prev_unit) != "").select(
        entity, F.col(start).alias("handoff_at"), F.col("event_id").alias("next_event_id"), F.col(unit).alias("next_unit")
    )
    return left.join(right, [entity, "handoff_at"])


def unit_after_stay(
    stays: DataFrame,
    transfers: DataFrame,
    units: Sequence[str],
    entity: str = "entity_id",
) -> DataFrame:
    """Keep stays handed over at their end and add the receiving unit.

    ``stays`` needs ``unit_end``: the last end among its rows in ``units``
    (see :func:`unit_end_aggregate`). Moves are reduced to one per (entity,
    time) before the join, so no row is repeated.
    """
    moves = (
        transfers.filter(F.col("prev_unit") != "")
        .groupBy(entity, F.col("intime").alias("stay_out"))
        .agg(F.min_by("curr_unit", "event_id").alias("next_unit"))
    )
    return stays.filter(F.col("unit_end") == F.col("stay_out")).join(moves, [entity, "stay_out"])


def unit_end_aggregate(units: Sequence[str], unit: str = "curr_unit", end: str = "outtime") -> Column:
    return F.max(F.when(F.col(unit).isin(*units), F.col(end))).alias("unit_end")


def with_day_flags(df: DataFrame, start: str = "stay_in", end: str = "stay_out") -> DataFrame:
    """Day (1) or night (0) at both ends of the stay."""
    return df.withColumns({"in_day": day_flag(start), "out_day": day_flag(end)})


def transfer_path(
    transfers: DataFrame,
    key: str = "admission_id",
    entity: str = "entity_id",
    time: str = "intime",
    tie: str = "event_id",
    unit: str = "curr_unit",
    hot: HotKeys = NO_HOT_KEYS,
) -> DataFrame:
    """Units in the order visited, one row per step.

    Steps stay rows: an array per admission would gather a whole admission in one value.
    """
    steps = ordered(transfers, [entity, key], time, [tie], running={"step": F.lit(1)}, hot=hot)
    return steps.select(key, F.col("step").cast("int").alias("step"), F.col(unit).alias("unit"))


