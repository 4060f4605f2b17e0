"""Quantiles, ranks, scores, resampling and neighbours against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from staywise.functions import tails
from staywise.operators import knn, quantiles, resample, scaling, scores, split, stats
from staywise.operators.quantiles import exact_quantiles
from staywise.operators.ranks import running_totals

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]
NAMES = ["q0", "q25", "q50", "q90", "q100"]


def sample(kind, n, rng):
    if kind == "ties":
        return [float(rng.randrange(4)) for _ in range(n)]
    if kind == "heavy":
        return [rng.paretovariate(0.7) for _ in range(n)]
    return [rng.gauss(0, 1) for _ in range(n)]


@pytest.mark.parametrize("kind", ["ties", "heavy", "normal"])
@pytest.mark.parametrize("by", [["g"], []])
def test_wide_brackets_are_narrowed(spark, monkeypatch, kind, by):
    rng = random.Random(4)
    data = [("big", v) for v in sample(kind, 4000, rng)] + [("small", v) for v in sample(kind, 50, rng)] + [(None, 1.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    rounds = []
    once = quantiles.reliable_checkpoint
    monkeypatch.setattr(quantiles, "reliable_checkpoint", lambda d: rounds.append(1) or once(d))
    # a sketch of this accuracy leaves a tenth of the rows inside a bracket
    found = exact_quantiles(df, "v", PROBS, NAMES, by, 40, bracket_rows=20)
    frame = pd.DataFrame(data, columns=["g", "v"])
    for r in found.collect():
        values = frame if not by else frame[frame.g.isna()] if r["g"] is None else frame[frame.g == r["g"]]
        assert [r[n] for n in NAMES] == pytest.approx(list(np.quantile(values.v, PROBS)), rel=1e-12)
    assert 1 <= len(rounds) <= 6


def test_brackets_that_miss_move(spark):
    values = [float(i) for i in range(1000)]
    data = spark.createDataFrame([(0, v) for v in values], "_g0 int, _v double")
    wrong = spark.createDataFrame([(0, 900.0, -5.0, 950.0, -1.0)], "_g0 int, _lo0 double, _lo1 double, _hi0 double, _hi1 double")
    row = quantiles._narrowed(data, ["_g0"], wrong, [0.1, 0.9], 30, 10).first()
    for i, rank in ((0, 99.9), (1, 899.1)):
        assert row[f"_lo{i}"] <= math.floor(rank) and row[f"_hi{i}"] >= math.ceil(rank)
        assert row[f"_hi{i}"] - row[f"_lo{i}"] <= 40


@pytest.mark.parametrize("kind", ["ties", "heavy", "normal"])
@pytest.mark.parametrize("accuracy,groups", [(100_000, 10_000), (40, 10_000), (40, 1)])
def test_quantiles_are_exact(spark, kind, accuracy, groups):
    rng = random.Random(3)
    data = [("big", v) for v in sample(kind, 2000, rng)]
    data += [(None, v) for v in sample(kind, 7, rng)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("void", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    got = {r["g"]: r for r in exact_quantiles(df, "v", PROBS, NAMES, ["g"], accuracy, groups).collect()}
    frame = pd.DataFrame(data, columns=["g", "v"]).dropna(subset=["v"])
    assert set(got) == {"big", None, "one", "two"}
    for g in got:
        values = frame[frame.g.isna()] if g is None else frame[frame.g == g]
        assert [got[g][n] for n in NAMES] == pytest.approx(list(np.quantile(values.v, PROBS)), rel=1e-12)
    whole = exact_quantiles(df, "v", PROBS, NAMES, accuracy=accuracy).first()
    assert [whole[n] for n in NAMES] == pytest.approx(list(np.quantile(frame.v, PROBS)), rel=1e-12)


@pytest.mark.parametrize("slice_rows", [10, 97, 100_000])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_slices(spark, slice_rows, descending):
    rng = random.Random(4)
    values = sorted({round(rng.paretovariate(0.5), 6) for _ in range(500)}, reverse=descending)
    weights = [rng.randrange(5) for _ in values]
    df = spark.createDataFrame(list(zip(values, weights)), "v double, w int").repartition(4)
    got = running_totals(df, "v", ["w"], descending, slice_rows)
    found = {r["v"]: r["w_upto"] for r in got.collect()}
    assert [found[v] for v in values] == list(np.cumsum(weights))


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_two_levels(spark, descending):
    rng = random.Random(8)
    values = sorted({round(rng.paretovariate(0.5), 6) for _ in range(400)}, reverse=descending)
    df = spark.createDataFrame([(v, 1) for v in values], "v double, w int").repartition(4)
    got = running_totals(df, "v", ["w"], descending, slice_rows=10, most=5)
    found = {r["v"]: r["w_upto"] for r in got.collect()}
    assert [found[v] for v in values] == list(range(1, len(values) + 1))


def test_spearman_with_ties(spark):
    rng = random.Random(6)
    data = [(rng.randrange(6), rng.randrange(9)) for _ in range(300)]
    df = spark.createDataFrame(data, "a int, b int")
    frame = pd.DataFrame(data, columns=["a", "b"])
    assert stats.spearman(df, "a", "b").first()["spearman"] == pytest.approx(
        frame.a.rank().corr(frame.b.rank()), abs=1e-6
    )


def test_scores_of_flat_and_perfect_features(spark):
    df = spark.createDataFrame([(i, 3.0, float(2 * i), float(i % 3)) for i in range(20)], "y int, flat double, same double, z double")
    table = scores.score_f_regression(df, ["flat", "same", "z"], "y")
    got = {r["feature"]: r["score"] for r in table.collect()}
    assert got["flat"] is None and got["same"] == float("inf") and 0 <= got["z"] < 1
    assert scores.top_features(table, 2) == ["same", "z"]
    p = {r["feature"]: r["p_value"] for r in scores.with_f_p_values(table, df).collect()}
    assert p["flat"] is None and p["same"] == 0.0 and 0.5 < p["z"] <= 1.0


def test_known_tail_probabilities(spark):
    df = spark.createDataFrame([(3.841459, 1.0, 4.964603, 10.0), (18.307038, 10.0, 10.044289, 10.0)], "x double, k double, f double, d double")
    got = df.select(tails.chi2_tail("x", "k").alias("c"), tails.f_tail("f", "d").alias("f")).collect()
    assert [r["c"] for r in got] == pytest.approx([0.05, 0.05], abs=1e-6)
    assert [r["f"] for r in got] == pytest.approx([0.05, 0.01], abs=1e-6)


def test_chi2_against_hand_count(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 0.0), (1, 0.0)], "y int, x double")
    table = scores.score_chi2(df, ["x"], "y")
    assert table.first()["score"] == 4.0
    assert scores.with_chi2_p_values(table, df, "y").first()["p_value"] == pytest.approx(0.0455003, abs=1e-6)


def test_splits_cover_all_rows_once(spark):
    df = spark.range(1000)
    train, test = split.split_random(df)
    assert train.count() + test.count() == 1000 and train.intersect(test).count() == 0
    assert 600 < train.count() < 800
    parted = split.split_by_hash(df, "id")
    again = split.split_by_hash(df.repartition(3), "id")
    assert parted.exceptAll(again).count() == 0
    assert 600 < parted.filter("part = 'train'").count() < 800


def test_chi2_rejects_negative_values(spark):
    df = spark.createDataFrame([(0, -1.0), (1, 2.0)], "y int, x double")
    with pytest.raises(Exception, match="x: negative value"):
        scores.score_chi2(df, ["x"], "y").collect()


def test_boxcox_names_the_bad_column(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "stay double")
    with pytest.raises(Exception, match="stay: Box-Cox"):
        scaling.boxcox_profile(df, "stay", [0.0]).collect()


def test_boxcox_finds_the_log(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(math.exp(rng.gauss(1, 0.6)),) for _ in range(4000)], "x double")
    lam = scaling.fit_boxcox(df, ["x"])
    assert abs(lam["x"]) < 0.08
    assert scaling.apply_boxcox(df, {"x": 0.0}).agg(F.avg("x")).first()[0] == pytest.approx(1, abs=0.05)


def test_scaling_round_trip_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in scaling.scale_standard(df, df, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    back = scaling.unscale_standard(scaling.scale_standard(df, df, ["a", "b"]), df, ["a", "b"])
    assert [tuple(r) for r in back.collect()] == [(1.0, 5.0), (3.0, 5.0)]
    assert [tuple(r) for r in scaling.scale_minmax(df, df, ["a", "b"]).collect()] == [(0.0, 0.0), (1.0, 0.0)]


def test_bootstrap_is_repeatable_and_sized(spark):
    df = spark.range(20_000)
    first = resample.bootstrap(df, ["id"], "s")
    assert abs(first.count() - 20_000) < 600
    again = resample.bootstrap(df.repartition(3), ["id"], "s")
    assert first.exceptAll(again).count() == 0 == again.exceptAll(first).count()
    few = resample.bootstrap(spark.range(10), ["id"], "s", draws=2000)
    assert abs(few.count() - 2000) < 250


@pytest.mark.parametrize("block_rows,pivots", [(8192, 64), (7, 5), (50, 1)])
def test_neighbours_against_brute_force(spark, block_rows, pivots):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 6)) * 5
    train = [(i, (centres[i % 4] + rng.normal(size=6)).tolist(), float(rng.integers(10))) for i in range(150)]
    train += [(1000 + i, train[0][1], float(i)) for i in range(8)]  # exact copies: ties go by id
    test = [(i, (centres[i % 4] + rng.normal(size=6)).tolist(), 0.0) for i in range(40)] + [(99, train[0][1], 0.0)]
    kind = "id long, v array<double>, y double"
    got = knn.knn_regress(
        spark.createDataFrame(train, kind), spark.createDataFrame(test, kind), "id", "v", "y", 5, pivots, block_rows
    )
    found = {r["id"]: r["prediction"] for r in got.collect()}
    assert len(found) == len(test)
    for i, v, _ in test:
        order = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j, y) for j, w, y in train)
        assert found[i] == pytest.approx(sum(y for _, _, y in order[:5]) / 5)
