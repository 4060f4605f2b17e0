"""As-of and containment joins that stay linear for any key.

Both sides are stacked on one timeline per key; each left row then takes the
last known right row at or before its time. Nothing is paired, so a key with
many rows on both sides costs a sort, not a product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.operators.ordered import NO_HOT_KEYS, HotKeys, ordered


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    take: dict[str, Column],
    tie: str,
    how: str = "left",
    hot: HotKeys = NO_HOT_KEYS,
) -> DataFrame:
    """Add ``take`` from the latest right row with ``right_time <= left_time`` per ``by``.

    Right rows with the same time are ordered by ``tie``; the greatest wins.
    Rows with a NULL time or key match nothing; ``how='inner'`` keeps matches only.
    """
    payload = F.struct(*[c.alias(n) for n, c in take.items()])
    kind = right.select(payload.alias("p")).schema["p"].dataType
    facts = right.filter(F.col(right_time).isNotNull()).select(
        *by,
        F.col(right_time).alias("_at"),
        F.lit(0).alias("_side"),
        F.col(tie).alias("_tie"),
        payload.alias("_fact"),
        F.lit(None).cast(left.schema).alias("_row"),
    )
    probes = left.select(
        *by,
        F.col(left_time).alias("_at"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(right.schema[tie].dataType).alias("_tie"),
        F.lit(None).cast(kind).alias("_fact"),
        F.struct(*left.columns).alias("_row"),
    )
    line = facts.unionByName(probes)
    found = (
        ordered(line, by, "_at", ["_side", "_tie"], latest={"_last": F.col("_fact")}, hot=hot)
        .filter(F.col("_side") == 1)
    )
    if how == "inner":
        found = found.filter(F.col("_last").isNotNull())
    known = F.col("_at").isNotNull()
    return found.select(
        "_row.*", *[F.when(known, F.col("_last")[n]).alias(n) for n in take]
    )


def event_in_span(
    spans: DataFrame,
    events: DataFrame,
    by: Sequence[str],
    start: str,
    end: str,
    event_time: str,
    tie: str,
    name: str = "event_in_span",
    hot: HotKeys = NO_HOT_KEYS,
) -> DataFrame:
    """1 when an event of the same key lies in ``[start, end]``, else 0.

    The latest event at or before ``end`` decides: if even that one is before
    ``start``, none lies inside.
    """
    last = asof_latest(
        spans, events, by, end, event_time, {"_event_at": F.col(event_time)}, tie, hot=hot
    )
    inside = F.coalesce(F.col("_event_at") >= F.col(start), F.lit(False))
    return last.withColumn(name, inside.cast("int")).drop("_event_at")
