"""Ranked scores and reduced columns."""

import pytest
from pyspark.sql import functions as F

from staywise.functions import tails
from staywise.operators import scores


def test_unknown_scores_rank_last_and_are_not_kept(spark):
    table = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0), ("d", 1.0)], "feature string, score double")
    got = {r["feature"]: (r["rank"], r["kept"]) for r in scores.selection(table, 3).collect()}
    assert got == {"c": (1, 1), "a": (2, 1), "d": (3, 1), "b": (4, 0)}
    assert {r["feature"] for r in scores.selection(table, 9).filter("kept = 1").collect()} == {"a", "c", "d"}
    assert scores.selection(table.limit(0), 2).count() == 0


def test_reduced_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "id int, a int, b int, y int")
    assert scores.reduced(df, ["a", "b"], ["b"]).columns == ["id", "b", "y"]


def test_even_tail_equals_the_general_one(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (2.5,), (40.0,), (300.0,), (None,)], "x double")
    for freedom in (2, 4, 10, 60):
        got = df.select(tails.chi2_tail_even(F.col("x"), freedom).alias("a"), tails.chi2_tail("x", F.lit(float(freedom))).alias("b")).collect()
        for r in got[:-1]:
            assert r["a"] == pytest.approx(r["b"], rel=1e-9, abs=1e-300)
        assert got[-1]["a"] is None
    with pytest.raises(ValueError):
        tails.chi2_tail_even(F.lit(1.0), 3)
