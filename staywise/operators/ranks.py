"""Running totals over one global order, without a one-task window over all rows.

The input has one row per distinct value. When there are many, sketch-chosen cut
points split them into slices of bounded size; each slice is windowed on its own
and shifted by the total of the slices before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLICE_ROWS = 250_000
MOST_SLICES = 4096  # slices of one level; more rows than these hold get a second level inside each
BROADCAST_CUTS = 1 << 23  # cut points (64 MB) that are sent to all tasks


def _fractions(pieces: int) -> Column:
    return F.split(F.lit(",".join(repr(i / pieces) for i in range(1, pieces))), ",").cast("array<double>")


def _cut(df: DataFrame, value: str, slice_rows: int, most: int) -> tuple[DataFrame, int]:
    """Add ``_slice`` and, inside it, ``_part``; also the number of slices.

    The cut points of the slices (at most ``most`` numbers) come from one pass,
    those of the parts, needed above ``most * slice_rows`` rows, from another.
    """
    wanted = -(-df.count() // slice_rows)
    if wanted <= 1:
        return df.withColumns({"_slice": F.lit(0.0), "_part": F.lit(0)}), 1
    slices = min(wanted, most)
    number = F.col(value).cast("double")
    sketch = F.percentile_approx(number, _fractions(slices), 10 * slices).alias("cuts")
    cuts = sorted(set(df.agg(sketch).first()["cuts"]))
    splits = [float("-inf"), *cuts, float("inf")]
    sliced = Bucketizer(splits=splits, inputCol="_number", outputCol="_slice", handleInvalid="keep").transform(
        df.withColumn("_number", number)
    )
    parts = -(-wanted // slices)
    if parts == 1:
        return sliced.withColumn("_part", F.lit(0)).drop("_number"), len(splits) - 1
    inside = sliced.groupBy(F.col("_slice").alias("_of")).agg(
        F.percentile_approx("_number", _fractions(parts), 10 * parts).alias("_cuts")
    )
    if wanted <= BROADCAST_CUTS:
        inside = F.broadcast(inside)
    passed = F.size(F.filter("_cuts", lambda cut: cut <= F.col("_number")))
    parted = sliced.join(inside, F.col("_slice") == F.col("_of")).withColumn("_part", passed)
    return parted.drop("_number", "_of", "_cuts"), len(splits) - 1


def running_totals(
    df: DataFrame,
    value: str,
    sums: Sequence[str],
    descending: bool = False,
    slice_rows: int = SLICE_ROWS,
    most: int = MOST_SLICES,
) -> DataFrame:
    """Add ``<sum>_upto`` (inclusive) for each sum column, in the order of ``value``.

    ``value`` must be distinct and not NULL.
    """
    sliced, slices = _cut(df, value, slice_rows, most)

    def way(column: str) -> Column:
        return F.col(column).desc() if descending else F.col(column).asc()

    inner = Window.partitionBy("_slice", "_part").orderBy(way(value)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = sliced.select("*", *[F.sum(c).over(inner).alias(f"{c}_upto") for c in sums])
    if slices == 1:
        return local.drop("_slice", "_part")
    # parts are summed up inside their slice; at most ``most`` + 1 slices, so one task orders those
    per_part = sliced.groupBy("_slice", "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    per_slice = per_part.groupBy("_slice").agg(*[F.sum(f"_t_{c}").alias(f"_t_{c}") for c in sums])
    inside = Window.partitionBy("_slice").orderBy(way("_part")).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy(way("_slice")).rowsBetween(Window.unboundedPreceding, -1)

    def shifts(window: WindowSpec, name: str) -> list[Column]:
        return [F.coalesce(F.sum(f"_t_{c}").over(window), F.lit(0)).alias(f"{name}_{c}") for c in sums]

    outer = per_slice.select(F.col("_slice").alias("_of"), *shifts(across, "_o"))
    shift = per_part.select("_slice", "_part", *shifts(inside, "_i")).join(
        F.broadcast(outer), F.col("_slice") == F.col("_of")
    )
    return local.join(shift.drop("_of"), ["_slice", "_part"]).select(
        *df.columns, *[(F.col(f"{c}_upto") + F.col(f"_i_{c}") + F.col(f"_o_{c}")).alias(f"{c}_upto") for c in sums]
    )
