"""Similarity by matching blocks against Python's own, and the sieves before it."""

import difflib
import random

from pyspark.sql import functions as F

from staywise.operators import groups

WORDS = ["cardiac", "infection", "pneumonia", "renal", "bb", "coronary artery"]


def ratio(a, b):
    return difflib.SequenceMatcher(a=a, b=b).ratio()


def strings(n, seed):
    rng = random.Random(seed)
    out = ["", "a", "é", "🙂b", "abcabc", "cardiac", "cardiacs", "cardac", "candiac", "infektion", "rénal"]
    for _ in range(n):
        w = list(rng.choice(WORDS))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "a", "c", "i", "xy"])
        out.append("".join(w))
    return out


def test_ratio_equals_difflib(spark):
    rng = random.Random(1)
    pairs = [(a, rng.choice(WORDS + strings(5, 2))) for a in strings(250, 3)]
    pairs += [("".join(rng.choices("ab", k=rng.randrange(9))), "".join(rng.choices("ab", k=rng.randrange(9)))) for _ in range(250)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", groups.similarity(F.col("a"), F.col("b")).alias("r")).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert r["r"] == ratio(r["a"], r["b"]), (r["a"], r["b"])


def test_no_close_token_is_left_out_and_no_python_runs(spark):
    tokens = [t for t in strings(400, 4) if t and " " not in t]
    df = spark.createDataFrame([(i, f"{t} {t.upper()}  \t other") for i, t in enumerate(tokens)] + [(-1, None), (-2, "")], "id long, text string")
    for cutoff in (0.6, 0.8, 0.95):
        found = groups.fuzzy_tokens(df, "text", WORDS, cutoff)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
        want = {t.lower() for t in [*tokens, "other"] if any(ratio(t.lower(), w) >= cutoff for w in WORDS)}
        assert {r["token"] for r in found.collect()} == want
