"""Ordered logic per key that survives a hot key.

``Window.partitionBy(key)`` sends all rows of a key to one task. Here the keys
that hold more than ``HOT_ROWS`` rows are cut into segments of time, and of
ties where one instant holds that many; each segment is windowed on its own,
and one summary row per segment carries the state (last row, running sums, last
known value) into the next one. The result equals the plain window. Keys below
the threshold stay one segment, so without hot keys the plan *is* the plain
window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from staywise.functions.times import epoch_micros
from staywise.session import reliable_checkpoint

HOT_ROWS = 2_000_000
HOT_SHARE = 10_000  # keys whose cuts are broadcast; the cuts of more keys are joined
TIE_SAMPLE = 50  # sampled rows per segment of a hot instant
PARTS = 1 << 20  # segments of one instant at most


@dataclass(frozen=True)
class HotKeys:
    """Keys to be cut, with the ascending cut points (microseconds) between their segments.

    Up to ``HOT_SHARE`` keys are ``entries``; more are a checkpointed ``table`` (_hot_key, _hot_cuts). ``instants`` are
    the (key, microseconds, rows, pieces) of instants that hold more rows than a segment should.
    """

    key: str = ""
    entries: tuple[tuple[object, tuple[int, ...]], ...] = field(default=())
    instants: tuple[tuple[object, int, int, int], ...] = field(default=())
    table: DataFrame | None = None

    def __bool__(self) -> bool:
        return bool(self.entries) or self.table is not None

    def renamed(self, key: str) -> HotKeys:
        return replace(self, key=key)


NO_HOT_KEYS = HotKeys()


def find_hot_keys(
    df: DataFrame, key: str, time: str, rows: int = HOT_ROWS, share: int | None = None, few: int = HOT_SHARE
) -> HotKeys:
    """The keys with more than ``rows`` rows (and more than 1/``share`` of all, if given), so at most one per ``rows`` rows.

    A table of at most ``rows`` rows has none; its row count, which a file's footer holds, is all that is read then.
    Hot keys are cut at quantiles of their own times, so that segments hold about equal numbers of rows however the
    times are spread; keys that need about the same number of segments share one more aggregate. Quantiles that fall
    on the same instant name a hot instant; its rows are counted, and ``ordered`` cuts them by the order's ties.
    """
    total = df.count()
    if total <= rows:
        return NO_HOT_KEYS
    known = df.filter(F.col(key).isNotNull())
    hot = known.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > rows)
    if share:
        hot = hot.filter(F.col("n") * share > total)
    first = hot.limit(few + 1).collect()
    if not first:
        return NO_HOT_KEYS
    pieces = lambda n: 1 << (-(-n // rows) - 1).bit_length()
    at = epoch_micros(time)

    def cuts(members: DataFrame, parts: int) -> DataFrame:
        probs = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        sketch = F.percentile_approx(at, probs, max(10 * parts, 1000)).alias("cuts")
        return known.join(members, F.col(key) == F.col("_hot_key"), "left_semi").groupBy(key).agg(sketch)

    if len(first) > few:
        # too many to bring back: the same per class of sizes, as a table
        classed = reliable_checkpoint(hot.select(F.col(key).alias("_hot_key"), F.ceil(F.log2(F.col("n") / rows)).cast("int").alias("c")))
        classes = sorted(r["c"] for r in classed.select("c").distinct().collect())
        found = [cuts(classed.filter(F.col("c") == c), 1 << max(c, 1)) for c in classes]
        whole = found[0]
        for part in found[1:]:
            whole = whole.unionByName(part)
        table = reliable_checkpoint(whole.select(F.col(key).alias("_hot_key"), F.array_sort("cuts").alias("_raw")))
        repeated = _repeated(table.select("_hot_key", F.explode("_raw").alias("at")))
        table = table.select("_hot_key", F.array_sort(F.array_distinct("_raw")).alias("_hot_cuts"))
    else:
        by_pieces: dict[int, list[object]] = {}
        for row in first:
            by_pieces.setdefault(pieces(row["n"]), []).append(row[key])
        kind = df.schema[key].dataType.simpleString()
        entries, repeated, table = [], [], None
        for parts, members in sorted(by_pieces.items()):
            wanted = df.sparkSession.createDataFrame([(m,) for m in members], f"_hot_key {kind}")
            for row in cuts(F.broadcast(wanted), parts).collect():
                found = sorted(row["cuts"] or ())
                entries.append((row[key], tuple(sorted(set(found)))))
                repeated += [(row[key], c) for c in sorted({c for c, d in zip(found, found[1:]) if c == d})]
    instants = _instants(df, key, at, repeated, rows)
    if table is not None:
        return HotKeys(key, instants=instants, table=table)
    return HotKeys(key, tuple(sorted(entries)), instants)


def _repeated(cuts: DataFrame) -> list[tuple[object, int]]:
    """Instants that two cuts of a key fall on, in a table of cuts."""
    twice = cuts.groupBy("_hot_key", "at").count().filter("count > 1")
    return [(r["_hot_key"], r["at"]) for r in twice.collect()]


def _instants(df: DataFrame, key: str, at: Column, repeated: list[tuple[object, int]], rows: int) -> tuple:
    """Rows of the instants that hold more than a segment should; there is at most one per half segment of rows."""
    if not repeated:
        return ()
    kind = df.schema[key].dataType.simpleString()
    wanted = F.broadcast(df.sparkSession.createDataFrame(repeated, f"_k {kind}, _at bigint"))
    counted = df.join(wanted, (F.col(key) == F.col("_k")) & (at == F.col("_at")), "left_semi").groupBy(key, at.alias("_at")).count()
    return tuple(sorted((r[key], r["_at"], r["count"], -(-r["count"] // rows)) for r in counted.collect() if r["count"] > rows))


def _tie_cuts(df: DataFrame, time: str, ties: Sequence[str], hot: HotKeys) -> DataFrame | None:
    """(_hot_key, _instants): per hot instant the cut points among its rows' ties, from a bounded sample of them."""
    if not hot.instants or not ties:
        return None
    kind = df.schema[hot.key].dataType.simpleString()
    at = epoch_micros(time)
    shares = [(k, a, min(1.0, TIE_SAMPLE * pieces / n)) for k, a, n, pieces in hot.instants]
    wanted = F.broadcast(df.sparkSession.createDataFrame(shares, f"_k {kind}, _at bigint, _share double"))
    rows = df.join(wanted, (F.col(hot.key) == F.col("_k")) & (at == F.col("_at"))).filter(F.rand(1) < F.col("_share"))
    tie = F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)])
    drawn: dict[tuple, list[Row]] = {}
    for row in rows.select("_k", "_at", tie.alias("tie")).collect():
        drawn.setdefault((row["_k"], row["_at"]), []).append(row["tie"])
    per_key: dict[object, list] = {}
    for k, a, _, pieces in hot.instants:
        own = sorted(drawn.get((k, a), []), key=lambda t: tuple((v is not None, v) for v in t))
        cuts = [own[len(own) * i // pieces] for i in range(1, pieces)] if own else []
        per_key.setdefault(k, []).append((a, [c for i, c in enumerate(cuts) if not i or c != cuts[i - 1]]))
    shape = rows.select(tie.alias("tie")).schema["tie"].dataType.simpleString()
    return df.sparkSession.createDataFrame(list(per_key.items()), f"_tie_key {kind}, _instants array<struct<at:bigint,cuts:array<{shape}>>>")


def _segmented(df: DataFrame, time: str, hot: HotKeys, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``_segment``: the number of cut points up to the row for hot keys, NULL for all others."""
    kind = df.schema[hot.key].dataType.simpleString()
    at = epoch_micros(time)
    small = hot.table
    if small is None:
        small = F.broadcast(df.sparkSession.createDataFrame([(k, list(c)) for k, c in hot.entries], f"_hot_key {kind}, _hot_cuts array<bigint>"))
    joined = df.join(small, F.col(hot.key) == F.col("_hot_key"), "left")
    passed = F.size(F.filter("_hot_cuts", lambda cut: cut <= at)).cast("long") * (2 * PARTS)
    tied = _tie_cuts(df, time, ties, hot)
    if tied is not None:
        # rows before, at and after a hot instant get numbers of their own, and those at it one per part
        joined = joined.join(F.broadcast(tied), F.col(hot.key) == F.col("_tie_key"), "left")
        own = F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)])
        here = F.get(F.filter("_instants", lambda i: i["at"] == at), F.lit(0))
        before = F.size(F.filter("_instants", lambda i: i["at"] < at)) + F.size(F.filter("_instants", lambda i: i["at"] <= at))
        part = F.when(here.isNull(), F.lit(0)).otherwise(F.size(F.filter(here["cuts"], lambda c: c <= own)))
        passed = F.when(F.col("_instants").isNull(), passed).otherwise((passed / (2 * PARTS) + before).cast("long") * (2 * PARTS) + part)
    return joined.withColumn("_segment", F.when(F.col("_hot_cuts").isNotNull(), passed)).drop("_hot_key", "_hot_cuts", "_tie_key", "_instants")


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    ties: Sequence[str] = (),
    *,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    latest: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    hot: HotKeys = NO_HOT_KEYS,
) -> DataFrame:
    """Add ordered columns per ``keys``, ordered by ``time`` then ``ties`` (must be total).

    previous / following -- the expression on the row before / after
    running  -- sum up to and including the row
    latest   -- last non-NULL value up to and including the row
    totals   -- sum over the whole key
    """
    previous, following = dict(previous or {}), dict(following or {})
    running, latest, totals = dict(running or {}), dict(latest or {}), dict(totals or {})
    order = [time, *ties]
    if not hot:
        by = Window.partitionBy(*keys).orderBy(*order)
        upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*keys)
        return df.select(
            "*",
            *[F.lag(c).over(by).alias(n) for n, c in previous.items()],
            *[F.lead(c).over(by).alias(n) for n, c in following.items()],
            *[F.sum(c).over(upto).alias(n) for n, c in running.items()],
            *[F.last(c, ignorenulls=True).over(upto).alias(n) for n, c in latest.items()],
            *[F.sum(c).over(whole).alias(n) for n, c in totals.items()],
        )

    cut = _segmented(df, time, hot, ties)
    groups = [*keys, "_segment"]
    by = Window.partitionBy(*groups).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.select(
        "*",
        *[F.lag(F.struct(c.alias("v"))).over(by).alias(f"_p_{n}") for n, c in previous.items()],
        *[F.lead(F.struct(c.alias("v"))).over(by).alias(f"_f_{n}") for n, c in following.items()],
        *[F.sum(c).over(upto).alias(f"_r_{n}") for n, c in running.items()],
        *[F.last(c, ignorenulls=True).over(upto).alias(f"_l_{n}") for n, c in latest.items()],
        *[F.sum(c).over(Window.partitionBy(*groups)).alias(f"_t_{n}") for n, c in totals.items()],
    )

    # One row per segment of a hot key; map-side combined, so a segment costs one row per task.
    at = F.struct(*[F.col(c) for c in order])
    summary = cut.filter(F.col("_segment").isNotNull()).groupBy(*groups).agg(
        F.count("*").alias("_n"),
        *[F.max_by(F.struct(c.alias("v")), at).alias(f"_p_{n}") for n, c in previous.items()],
        *[F.min_by(F.struct(c.alias("v")), at).alias(f"_f_{n}") for n, c in following.items()],
        *[F.sum(c).alias(f"_r_{n}") for n, c in running.items()],
        *[F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_l_{n}") for n, c in latest.items()],
        *[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()],
    )
    across = Window.partitionBy(*keys).orderBy("_segment")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    carry = summary.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_segment").alias("_k_segment"),
        *[F.lag(f"_p_{n}").over(across).alias(f"_cp_{n}") for n in previous],
        *[F.lead(f"_f_{n}").over(across).alias(f"_cf_{n}") for n in following],
        *[F.sum(f"_r_{n}").over(before).alias(f"_cr_{n}") for n in running],
        *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_cl_{n}") for n in latest],
        *[F.sum(f"_t_{n}").over(every).alias(f"_ct_{n}") for n in totals],
    )
    match = F.col("_segment") == F.col("_k_segment")
    for k in keys:
        match = match & (F.col(k) == F.col(f"_k_{k}"))
    joined = local.join(carry, match, "left")

    def plus(own: str, carried: str) -> Column:
        return F.when(F.col(carried).isNull(), F.col(own)).otherwise(
            F.col(carried) + F.coalesce(F.col(own), F.lit(0))
        )

    return joined.select(
        *df.columns,
        *[F.coalesce(f"_p_{n}", f"_cp_{n}")["v"].alias(n) for n in previous],
        *[F.coalesce(f"_f_{n}", f"_cf_{n}")["v"].alias(n) for n in following],
        *[plus(f"_r_{n}", f"_cr_{n}").alias(n) for n in running],
        *[F.coalesce(f"_l_{n}", f"_cl_{n}").alias(n) for n in latest],
        *[F.coalesce(f"_ct_{n}", f"_t_{n}").alias(n) for n in totals],
    )
