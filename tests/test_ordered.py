"""The segmented path must equal the plain window, whatever the skew."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from staywise.operators.asof import asof_latest, event_in_span
from staywise.operators.ordered import HOT_SHARE, NO_HOT_KEYS, _segmented, find_hot_keys, ordered
from tests.conftest import rows

START = dt.datetime(2024, 1, 1)


def skewed(spark, n=600, seed=1):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        key = 7 if rng.random() < 0.4 else rng.randrange(30)
        at = START + dt.timedelta(minutes=rng.randrange(0, 2000))
        data.append((i, key, at, rng.choice([None, 1, 2, 3]), rng.choice(["a", "b", None])))
    return spark.createDataFrame(data, "id long, k long, at timestamp_ntz, x int, u string")


def all_columns(df, hot):
    return ordered(
        df, ["k"], "at", ["id"],
        previous={"p_id": F.col("id"), "p_u": F.col("u")},
        following={"f_id": F.col("id"), "f_u": F.col("u")},
        running={"r": F.coalesce("x", F.lit(0)), "n": F.lit(1)},
        latest={"l": F.col("u")},
        totals={"t": F.lit(1), "s": F.col("x")},
        hot=hot,
    )


@pytest.mark.parametrize("floor", [5, 40, 200])
def test_segments_equal_plain_window(spark, floor):
    df = skewed(spark)
    hot = find_hot_keys(df, "k", "at", rows=floor, share=10_000)
    assert hot, "the fixture must have hot keys"
    assert rows(all_columns(df, hot)) == rows(all_columns(df, NO_HOT_KEYS))


def test_segments_hold_equal_rows_however_dense_the_times(spark):
    dense = [(i, 7, START + dt.timedelta(microseconds=i)) for i in range(999)]
    df = spark.createDataFrame([*dense, (999, 7, START + dt.timedelta(days=900))], "id long, k long, at timestamp_ntz")
    hot = find_hot_keys(df, "k", "at", rows=100)
    sizes = [r["count"] for r in _segmented(df, "at", hot).groupBy("_segment").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 120


@pytest.mark.parametrize("ties", [["id"], ["u", "id"]])
def test_rows_of_one_instant_are_cut_by_their_ties(spark, ties):
    rng = random.Random(8)
    one = [(i, 7, START, rng.choice([None, 1]), rng.choice(["a", "é", None])) for i in range(500)]
    more = [(1000 + i, 7, START + dt.timedelta(minutes=rng.randrange(-50, 50)), 2, "b") for i in range(200)]
    two = [(2000 + i, 8, START + dt.timedelta(days=i % 2), 1, None) for i in range(300)]
    df = spark.createDataFrame([*one, *more, *two, (5000, 9, START, 1, "x"), (5001, None, START, 1, "x"), (5002, 7, None, 1, "x")], "id long, k long, at timestamp_ntz, x int, u string").repartition(4)
    hot = find_hot_keys(df, "k", "at", rows=60)
    assert {(k, n) for k, _, n, _ in hot.instants} == {(7, 500 + sum(r[2] == START for r in more)), (8, 150)}
    sizes = [r["count"] for r in _segmented(df, "at", hot, ties).filter("_segment is not null").groupBy("k", "_segment").count().collect()]
    assert max(sizes) <= 120

    def added(by):
        return ordered(
            df, ["k"], "at", ties, previous={"p": F.col("id")}, following={"f": F.col("id")}, running={"r": F.lit(1)},
            latest={"l": F.col("u")}, totals={"t": F.lit(1)}, hot=by,
        )

    assert rows(added(hot)) == rows(added(NO_HOT_KEYS))


def test_many_hot_keys_are_joined(spark):
    df = skewed(spark)
    hot = find_hot_keys(df, "k", "at", rows=10, few=3)
    assert hot and not hot.entries and hot.table.count() > 3
    assert rows(all_columns(df, hot)) == rows(all_columns(df, NO_HOT_KEYS))


def test_small_tables_are_only_counted(spark, monkeypatch):
    df = skewed(spark)
    monkeypatch.setattr(type(df), "groupBy", None)
    assert find_hot_keys(df, "k", "at", rows=600) is NO_HOT_KEYS


def test_hot_keys_are_few_by_share(spark):
    df = skewed(spark)
    hot = find_hot_keys(df, "k", "at", rows=1, share=5)
    assert [e[0] for e in hot.entries] == [7]
    assert len(find_hot_keys(df, "k", "at").entries) == 0
    assert HOT_SHARE <= 10_000


def test_composite_is_the_same_with_hot_entities(spark, tables):
    from workload.features import SPEC, build_composite

    hot = find_hot_keys(tables.events, "user_id", "ts", rows=20).renamed("entity_id")
    assert hot
    plain = rows(build_composite(tables.fx_transfers, SPEC))
    assert plain
    tables.__dict__.pop("fx_transfers")
    tables.__dict__["hot"] = hot
    assert rows(build_composite(tables.fx_transfers, SPEC, hot=hot)) == plain


@pytest.mark.parametrize("hot_rows", [None, 10])
def test_asof_and_containment_against_brute_force(spark, hot_rows):
    rng = random.Random(5)
    spans, events = [], []
    for i in range(120):
        key = 1 if rng.random() < 0.5 else rng.randrange(5)
        a = rng.randrange(0, 400)
        b = None if rng.random() < 0.05 else a + rng.randrange(0, 30)
        spans.append((i, key, a, b))
    for i in range(150):
        key = 1 if rng.random() < 0.5 else rng.randrange(6)
        events.append((i, key, rng.randrange(0, 400), rng.random()))

    def at(minute):
        return None if minute is None else START + dt.timedelta(minutes=minute)

    left = spark.createDataFrame([(i, k, at(a), at(b)) for i, k, a, b in spans], "sid long, k long, a timestamp_ntz, b timestamp_ntz")
    right = spark.createDataFrame([(i, k, at(m), v) for i, k, m, v in events], "eid long, k long, at timestamp_ntz, v double")
    hot = find_hot_keys(right, "k", "at", rows=hot_rows) if hot_rows else NO_HOT_KEYS

    got = asof_latest(left, right, ["k"], "b", "at", {"eid": F.col("eid"), "v": F.col("v")}, tie="eid", hot=hot)
    found = {r["sid"]: r["eid"] for r in got.collect()}
    assert len(found) == len(spans)
    for i, k, a, b in spans:
        match = [(m, e) for e, kk, m, _ in events if kk == k and b is not None and m <= b]
        assert found[i] == (max(match)[1] if match else None)

    flagged = event_in_span(left, right, ["k"], "a", "b", "at", "eid", hot=hot)
    for r in flagged.collect():
        i, k, a, b = spans[r["sid"]]
        inside = b is not None and any(kk == k and a <= m <= b for _, kk, m, _ in events)
        assert r["event_in_span"] == int(inside)


def test_event_exactly_at_the_ends(spark):
    spans = spark.createDataFrame([(1, 1, START, START + dt.timedelta(hours=1))], "sid long, k long, a timestamp_ntz, b timestamp_ntz")
    for offset, want in ((0, 1), (60, 1), (61, 0), (-1, 0)):
        event = spark.createDataFrame([(9, 1, START + dt.timedelta(minutes=offset))], "eid long, k long, at timestamp_ntz")
        assert event_in_span(spans, event, ["k"], "a", "b", "at", "eid").first()["event_in_span"] == want
    unknown = spark.createDataFrame([(9, 1, None)], "eid long, k long, at timestamp_ntz")
    assert event_in_span(spans, unknown, ["k"], "a", "b", "at", "eid").first()["event_in_span"] == 0


def test_lab_at_before_after_and_tie(spark):
    end = START + dt.timedelta(hours=2)
    stay = spark.createDataFrame([(1, 5, end)], "sid long, k long, b timestamp_ntz")
    labs = spark.createDataFrame(
        [(1, 5, START, 0), (2, 5, end, 0), (3, 5, end, 1), (4, 5, end + dt.timedelta(seconds=1), 0)],
        "eid long, k long, at timestamp_ntz, flag int",
    )
    got = asof_latest(stay, labs, ["k"], "b", "at", {"eid": F.col("eid"), "flag": F.col("flag")}, tie="eid").first()
    assert (got["eid"], got["flag"]) == (3, 1)
