"""Edge rows of the scalar, cohort and stay operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from staywise.functions import codes, times
from staywise.operators import cohort, groups, split, stats, stays, transitions
from staywise.operators.metrics import classification_metrics, roc_auc
from staywise.plans.clinical import procedure_flags
from tests.conftest import rows

T0 = dt.datetime(2020, 1, 1)


def hours(n):
    return T0 + dt.timedelta(hours=n)


STAYS = "entity_id long, admission_id long, stay_id long, stay_in timestamp_ntz, stay_out timestamp_ntz"


def test_first_stay_has_no_gap(spark):
    one = spark.createDataFrame([(1, 1, 1, hours(0), hours(5))], STAYS)
    assert stays.readmissions(one).count() == 0
    kept = stays.readmissions(one, include_first=True).first()
    assert kept["readm_days"] is None and kept["prev_stay_id"] is None


def test_gap_and_tie_on_start(spark):
    two = spark.createDataFrame(
        [(1, 1, 2, hours(0), hours(3)), (1, 1, 1, hours(0), hours(2)), (1, 1, 3, hours(26), hours(30))], STAYS
    )
    got = {r["stay_id"]: (r["prev_stay_id"], r["readm_days"]) for r in stays.readmissions(two).collect()}
    assert got == {2: (1, -0.083), 3: (2, 0.958)}


TRANSFERS = (
    "event_id long, entity_id long, stay_id long, prev_unit string, curr_unit string, "
    "intime timestamp_ntz, outtime timestamp_ntz"
)


def test_handoff_stays_within_the_entity(spark):
    moves = spark.createDataFrame(
        [
            (1, 1, 10, "", "MICU", hours(0), hours(4)),
            (2, 2, 20, "CCU", "SICU", hours(4), hours(9)),
            (3, 1, 11, "MICU", "", hours(4), hours(6)),
        ],
        TRANSFERS,
    )
    got = stays.handoffs(moves, ["MICU", "SICU"]).collect()
    assert [(r["entity_id"], r["event_id"], r["next_event_id"]) for r in got] == [(1, 1, 3)]


def test_not_equal_keeps_null(spark):
    units = spark.createDataFrame([(None,), ("NICU",), ("MICU",)], "u string")
    assert rows(units.filter(codes.is_not("u", "NICU"))) == [("MICU",), (None,)]


def test_day_and_night(spark):
    at = [dt.datetime(2020, 1, 1, 5, 59), dt.datetime(2020, 1, 1, 6), dt.datetime(2020, 1, 1, 18, 59), dt.datetime(2020, 1, 1, 19), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "i int, t timestamp_ntz")
    got = df.orderBy("i").select(times.day_flag("t").alias("f"), times.day_label("t").alias("l")).collect()
    assert [r["f"] for r in got] == [0, 1, 1, 0, None]
    assert [r["l"] for r in got] == ["night", "day", "day", "night", None]


def test_ages(spark):
    ages = spark.createDataFrame([(17,), (18,), (89,), (90,), (300,)], "age int")
    assert [r[0] for r in ages.select(times.unshift_age("age")).collect()] == [17, 18, 89, -120, 90]
    born = spark.createDataFrame([(dt.datetime(2000, 1, 1), dt.datetime(1999, 12, 31))], "b timestamp_ntz, a timestamp_ntz")
    got = born.select(times.age_in_years("b", "a").alias("f"), times.age_truncated("b", "a").alias("t")).first()
    assert (got["f"], got["t"]) == (-1, 0)


def test_any_admission_as_adult_keeps_the_entity(spark):
    people = spark.createDataFrame([(1, dt.datetime(1980, 1, 1)), (2, dt.datetime(1990, 1, 1))], "e long, dob timestamp_ntz")
    adm = spark.createDataFrame(
        [(1, dt.datetime(1997, 6, 1)), (1, dt.datetime(1998, 6, 1)), (2, dt.datetime(1998, 6, 1))], "e long, t timestamp_ntz"
    )
    assert rows(cohort.adult_entities(adm, people, "e", "t", "dob")) == [(1,)]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(F.bround("x", 0)).collect()] == [0.0, 2.0, 2.0]


def test_code_ranges_are_lexicographic(spark):
    df = spark.createDataFrame([("3995",), ("39",), ("9671",), ("0013",), ("",)], "c string")
    rules = codes.PROCEDURE_RULES
    got = df.select(
        codes.in_code_ranges("c", rules["operation_cardiovascular"]).alias("v"),
        codes.in_code_ranges("c", rules["intubation_res_gas"]).alias("g"),
        codes.in_code_ranges("c", rules["dialysis"]).alias("d"),
        groups.numeric_code("c").alias("n"),
    ).collect()
    assert [tuple(r) for r in got] == [(0, 0, 1, 3995), (1, 0, 0, 39), (0, 0, 0, 9671), (1, 0, 0, 13), (0, 0, 0, None)]
    with pytest.raises(ValueError):
        codes.in_code_ranges("c", [("5", "3")])
    with pytest.raises(ValueError):
        groups.category_counts(df, groups.numeric_code("c"), {7: (495, 446)})


def test_bucketed_highest_sequence(spark):
    data = [(key, seq, "39") for key, top in ((1, 5), (2, 6), (3, 10), (4, 11)) for seq in range(1, top + 1)]
    df = spark.createDataFrame(data, "k int, s int, c string")
    got = procedure_flags(df, ["k"], "c", "s").orderBy("k").collect()
    assert [r["num_operations"] for r in got] == [1, 2, 2, 3]
    assert {r["operation_cardiovascular"] for r in got} == {1}


def test_split_sizes(spark):
    data = [(n, i, hours(i)) for n in (1, 2, 3, 5, 10) for i in range(n)]
    df = spark.createDataFrame(data, "e long, i long, t timestamp_ntz")
    parted = split.split_by_entity(df, "e", "t", "i", 0.8)
    train = {r["e"]: r["n"] for r in parted.filter("part = 'train'").groupBy("e").agg(F.count("*").alias("n")).collect()}
    assert train == {1: 1, 2: 1, 3: 2, 5: 4, 10: 8}
    assert parted.count() == df.count()
    early = parted.filter("part = 'train'").agg(F.max(F.col("i"))).first()[0]
    assert early == 7
    with pytest.raises(ValueError):
        split.split_by_entity(df, "e", "t", "i", 0.84)


def test_negative_spans(spark):
    df = spark.createDataFrame(
        [(hours(0), T0 - dt.timedelta(minutes=34)), (hours(2), hours(0)), (hours(0), hours(1))], "a timestamp_ntz, b timestamp_ntz"
    )
    assert [r[0] for r in df.select(times.is_negative_span("a", "b")).collect()] == [True, True, False]
    assert [r[0] for r in df.select(times.minute_part("a", "b")).collect()] == [-34, 0, 0]


def test_metrics_of_empty_and_one_class(spark):
    none = spark.createDataFrame([], "label int, guess int, score double")
    got = classification_metrics(none, "label", "guess").first()
    assert got["accuracy"] is None and got["f1"] is None
    one = spark.createDataFrame([(1, 1, 0.2), (1, 0, 0.3)], "label int, guess int, score double")
    assert classification_metrics(one, "label", "guess").first()["specificity"] is None
    assert roc_auc(one, "label", "score").first()["auc"] is None


def test_auc_ignores_monotone_transforms(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.4)], "y int, s double")
    a = roc_auc(df, "y", "s").first()["auc"]
    b = roc_auc(df.withColumn("s", F.exp(F.col("s") * 3)), "y", "s").first()["auc"]
    assert a == b == pytest.approx(4.5 / 6, abs=1e-6)


def test_row_in_two_groups_and_in_none(spark):
    df = spark.createDataFrame(
        [(1, "Septicemia with heart failure"), (2, "Broken toe"), (3, "Pulmonary procedure"), (4, None)], "i int, d string"
    )
    got = groups.stratify(df, "d", groups.DIAGNOSIS_GROUPS)
    assert rows(got.select("i", "grp")) == [
        (1, "cardiovascular"), (1, "infectious"), (2, "other"), (3, "respiratory_surgical"), (4, "other"),
    ]


def test_code_is_other_only_when_no_description_matches(spark):
    table = spark.createDataFrame([(1, "cardiac arrest"), (1, "unknown"), (2, "unknown")], "code int, d string")
    cases = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "case int, code int")
    got = groups.stratify_by_code(cases, table, "code", "d", groups.DIAGNOSIS_GROUPS)
    assert rows(got.select("case", "grp")) == [(10, "cardiovascular"), (11, "other"), (12, "other")]


def test_fuzzy_tokens(spark):
    df = spark.createDataFrame([(1, "Cardac arrest"), (2, "heart"), (3, "two  Hearts"), (4, "art of")], "i int, d string")
    got = groups.fuzzy_rows(df, "i", "d", ["cardiac", "heart"])
    assert rows(got.select("i")) == [(1,), (2,), (3,)]


def test_fuzzy_equals_difflib_on_whole_texts(spark, tables):
    import difflib
    import re

    words = groups.FUZZY_KEYWORDS["cardiovascular"] + groups.FUZZY_KEYWORDS["nervous"]
    docs = tables.documents.select("doc_id", "text")
    got = {r["doc_id"] for r in groups.fuzzy_rows(docs, "doc_id", "text", words, 0.7).select("doc_id").collect()}
    want, known = set(), {}
    for r in docs.collect():
        for token in set(re.split(r"\s+", r["text"].lower())) - {""}:
            if token not in known:
                known[token] = any(difflib.get_close_matches(w, [token], cutoff=0.7) for w in words)
            if known[token]:
                want.add(r["doc_id"])
    assert got == want


def test_top_pairs_tie_goes_by_label(spark):
    df = spark.createDataFrame([(p,) for p in ("b-a", "b-a", "a-c", "a-b")], "pair string")
    got = transitions.top_pairs(df, 2).orderBy("pair_rank").collect()
    assert [(r["pair"], r["pair_rank"]) for r in got] == [("b-a", 1), ("a-b", 2)]


def test_probabilities_sum_to_one(spark, tables):
    from workload.aggregates import pairs

    sums = transitions.transition_probabilities(pairs(tables)).groupBy("curr_unit").agg(F.sum("prob").alias("p"))
    assert all(r["p"] == pytest.approx(1.0) for r in sums.collect())


def test_risk_counts_run_from_zero(spark, tables):
    got = stays.risk_counts(tables.fx_stays).groupBy("entity_id").agg(
        F.min("readm_risk").alias("lo"), F.max("readm_risk").alias("hi"), F.count_distinct("readm_risk").alias("n")
    )
    assert all(r["lo"] == 0 and r["hi"] == r["n"] - 1 for r in got.collect())


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert rows(stats.histogram(df, F.col("x"), 5)) == [(0, 2, 2.0, 2.0)]
