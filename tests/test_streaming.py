"""Stays from a stream of late and unordered events against the batch form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from staywise.streaming.stays import OpenStay, event_files, run_to_end, stays_from_stream

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, entity_id long, ts timestamp, unit string, value double"


def made(n=300, seed=1):
    rng = random.Random(seed)
    out, at = [], {e: START for e in range(6)}
    for i in range(n):
        e = rng.randrange(6)
        at[e] += dt.timedelta(minutes=rng.choice([0, 1, 30, 200, 719, 720, 721, 900, 1440, 1441, 3000]))
        out.append((i, e, at[e], rng.choice(["a", "b", "", None, "c"]), rng.choice([None, 1.0, 2.5])))
    return sorted(out, key=lambda e: e[2])


def batch(events, stay=12, admission=24):
    """Stays by a plain loop over each entity's events."""
    out = []
    for entity in {e[1] for e in events}:
        own = sorted((e for e in events if e[1] == entity), key=lambda e: (e[2], e[0]))
        runs, admissions = [], []
        for i, e in enumerate(own):
            gap = (e[2] - own[i - 1][2]) if i else None
            admissions.append(e[0] if gap is None or gap > dt.timedelta(hours=admission) else admissions[-1])
            if gap is None or gap > dt.timedelta(hours=stay):
                runs.append([])
            runs[-1].append((e, admissions[-1]))
        for run in runs:
            units = [i for i, (e, _) in enumerate(run) if e[3]]
            if units:
                ends = [run[i + 1][0][2] if i + 1 < len(run) else run[i][0][2] + dt.timedelta(hours=1) for i in units]
                values = [run[i][0][4] for i in units if run[i][0][4] is not None]
                out.append((entity, run[0][1], run[0][0][0], run[units[0]][0][2], max(ends), len(units), sum(values), len(values)))
    return sorted(out)


def streamed(spark, folder, lots, delay, files=1):
    for i, lot in enumerate(lots):
        spark.createDataFrame(lot, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stays = stays_from_stream(event_files(spark, f"{folder}/in", SCHEMA, files), delay)
    return sorted(map(tuple, run_to_end(stays, str(folder)).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_late_and_unordered_events_give_the_batch_stays(spark, tmp_path, seed):
    events = made(seed=seed)
    rng = random.Random(seed)
    # each event arrives up to two days late, in five files; the last file ends the stream
    arrival = sorted(events, key=lambda e: e[2] + dt.timedelta(hours=rng.randrange(47)))
    lots = [arrival[len(arrival) * i // 5 : len(arrival) * (i + 1) // 5] for i in range(5)]
    end = max(e[2] for e in events) + dt.timedelta(days=30)
    got = streamed(spark, tmp_path, [*lots, [(10**6, None, end, None, None), (10**6 + 1, 99, end, None, None)]], "2 days")
    assert got == batch(events)


def test_events_beyond_the_delay_are_dropped(spark, tmp_path):
    day = dt.timedelta(days=1)
    first = [(1, 1, START, "a", 1.0), (2, 1, START + 9 * day, "a", 1.0)]
    late = [(3, 1, START + dt.timedelta(hours=1), "a", 1.0), (4, 2, START + 9 * day, "b", None)]
    got = streamed(spark, tmp_path, [first, late, [(9, 99, START + 30 * day, None, None)]], "1 hour")
    assert [r[:3] for r in got] == [(1, 1, 1), (1, 2, 2), (2, 4, 4)]


def test_state_does_not_grow_with_the_stay():
    stay = OpenStay(12, 24, None)
    sizes = set()
    for i in range(1000):
        assert stay.add(i * 1_000_000, i, i % 3 > 0, 1.0) is None
        sizes.add(len(stay.now))
    assert sizes == {9} and stay.close()[1] == 0
