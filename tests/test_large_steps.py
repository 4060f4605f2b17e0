"""Steps that must not grow with the table: what they keep, send and sort."""

import datetime as dt
import random

from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from staywise.operators import groups, models
from staywise.streaming import stays as streaming
from tests.test_streaming import SCHEMA, batch, made
from workload import base


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_split_model_makes_its_rows_once(spark):
    left = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"))
    right = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 50).cast("double").alias("y"))
    rows = left.join(F.broadcast(right), F.col("id") == F.col("k"))
    errors, rates = models.split_model(rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0"), ["a"], "y", 20.0)
    assert "Join" not in plan(errors) + plan(rates)  # the metrics are there, nothing joins again
    (e,), (r,) = errors.collect(), rates.collect()
    short = rows.filter("id % 3 = 0 and y <= 20").count()
    assert e["n_rows"] == short and r["tp"] + r["fp"] + r["fn"] + r["tn"] == rows.filter("id % 3 = 0").count()


def test_scoreboard_reads_both_sides_once(spark):
    read = {side: spark.sparkContext.accumulator(0) for side in ("train", "test")}

    def counted(rows, side):
        def run(batches):
            for batch in batches:
                read[side].add(batch.num_rows)
                yield batch

        return rows.mapInArrow(run, rows.schema)

    random_ = random.Random(3)
    values = [(float(i), random_.random(), 3.0 * i + 5 * random_.random()) for i in range(300)] + [(None, 1.0, 2.0)]
    rows = spark.createDataFrame(values, "a double, b double, y double").coalesce(1)
    train, test = rows.filter("a is null or a % 3 > 0"), rows.filter("a is null or a % 3 = 0")
    candidates = {
        "linear": LinearRegression(labelCol="y"),
        "robust": LinearRegression(labelCol="y", loss="huber", maxIter=20),
        "forest": RandomForestRegressor(labelCol="y", numTrees=3, seed=2),
        "boosting": GBTRegressor(labelCol="y", maxIter=3, maxDepth=2, seed=2),
    }
    got = models.scoreboard(counted(train, "train"), counted(test, "test"), ["a", "b"], "y", candidates)
    each = [models.regression_metrics(models.fit(train, ["a", "b"], e).transform(test), "y", "prediction").first() for e in candidates.values()]
    assert [tuple(r) for r in got.collect()] == [(*w, name) for w, name in zip(each, candidates)]
    assert got.columns == [*each[0].asDict(), "model"] and each[0]["n_rows"] == 100
    assert (read["train"].value, read["test"].value) == (201, 101)


def test_scoreboard_without_test_rows_keeps_a_row_per_model(spark):
    rows = spark.createDataFrame([(float(i), float(2 * i)) for i in range(20)], "a double, y double")
    got = models.scoreboard(rows, rows.limit(0), ["a"], "y", {"one": LinearRegression(labelCol="y"), "two": LinearRegression(labelCol="y", regParam=0.1)})
    assert [tuple(r) for r in got.collect()] == [(0, None, None, None, None, name) for name in ("one", "two")]


def test_join_sides_are_dealt_by_their_rows(spark, monkeypatch):
    left, right = spark.range(1000).withColumnRenamed("id", "a"), spark.range(100).withColumnRenamed("id", "b")
    assert base.dealt(left, "a", right, "b") == (left, right)
    monkeypatch.setattr(base, "TASK_ROWS", 100)
    one, two = base.dealt(left, "a", right, "b")
    assert one.rdd.getNumPartitions() == two.rdd.getNumPartitions() == 11
    assert one.join(two, F.col("a") == F.col("b")).count() == 100


def test_union_branches_sorts_bounded_parts(spark, tables, monkeypatch):
    from workload import aggregates

    want = sorted(map(tuple, aggregates.union_branches(tables).collect()))
    monkeypatch.setattr(base, "TASK_ROWS", 1000)
    frame = aggregates.union_branches(tables)
    assert "RepartitionByExpression" in plan(frame) and sorted(map(tuple, frame.collect())) == want


def test_short_hit_lists_go_to_the_rows(spark):
    texts = [(1, "a heart beats"), (2, "nothing near"), (3, "hart and soul"), (4, None), (5, "Cardiacs")]
    df = spark.createDataFrame(texts, "id long, text string")
    found = groups.fuzzy_rows(df, "id", "text", ["heart", "cardiac"])
    assert "strategy=broadcast" in plan(found) and "levenshtein" not in plan(found)  # the list is made once
    assert sorted(r["id"] for r in found.collect()) == [1, 3, 5]


def test_state_is_held_by_group_and_lots_are_taken_whole(spark, tmp_path, monkeypatch):
    events, rng = made(seed=3), random.Random(3)
    monkeypatch.setattr(streaming, "BUCKETS", 2)  # six entities share two groups
    arrival = sorted(events, key=lambda e: e[2] + dt.timedelta(hours=rng.randrange(47)))
    end = max(e[2] for e in events) + dt.timedelta(days=30)
    lots = [arrival[:100], arrival[100:200], arrival[200:], [(10**6, 99, end, None, None)]]
    for lot in lots:  # many files a lot, more than one of them in no order of time
        spark.createDataFrame(lot, SCHEMA).repartition(5).write.mode("append").parquet(f"{tmp_path}/in")
        found = streaming.run_to_end(streaming.stays_from_stream(streaming.event_files(spark, f"{tmp_path}/in", SCHEMA), "2 days"), str(tmp_path))
    assert sorted(map(tuple, found.collect())) == batch(events)
