"""The full data set from inline source tables, and reading them back from files."""

import datetime as dt

import pytest

from staywise.operators.ordered import find_hot_keys
from staywise.plans.episodes import as_transfers, episode_dataset
from staywise.session import reliable_checkpoint
from staywise.sources.tables import read_source, register_views, source_schema, sql_frame


def at(day, hour=12):
    return dt.datetime(2100, 1, 1) + dt.timedelta(days=day, hours=hour)


@pytest.fixture()
def sources(spark):
    transfers, stays, admissions = [], [], []
    # each entity: ward, first stay, ward, second stay, ward; 30 is admitted to an excluded unit, 40 is a minor
    for subject, unit, gap in ((10, "MICU", 2), (20, "CCU", 40), (30, "NICU", 2), (40, "SICU", 2)):
        a, b, s1, s2 = subject * 10 + 1, subject * 10 + 2, subject * 100 + 1, subject * 100 + 2
        second = 3 + gap
        transfers += [
            (subject, a, None, "admit", "", "", 0, 1, at(0, 0), at(0, 8), 8.0),
            (subject, a, s1, "transfer", "", unit, 1, 2, at(0, 8), at(3, 8), 72.0),
            (subject, a, None, "transfer", unit, "", 2, 1, at(3, 8), at(3, 20), 12.0),
            (subject, b, s2, "admit", "", unit, 1, 2, at(second, 8), at(second + 1, 8), 24.0),
            (subject, b, s2, "transfer", unit, unit, 2, 2, at(second + 1, 8), at(second + 2, 20), 36.0),
            (subject, b, None, "discharge", unit, "", 2, 1, at(second + 2, 20), None, None),
        ]
        stays += [
            (subject, a, s1, unit, unit, at(3, 8), 3.0),
            (subject, b, s2, unit, unit, at(second + 2, 20), 2.5),
        ]
        admissions += [
            (subject, a, at(0, 0), at(3, 20), "WHITE - RUSSIAN", "MARRIED", "Private", "ENGL"),
            (subject, b, at(second, 8), at(second + 3), "HISPANIC", "", "Medicare", None),
        ]
    made = {
        "transfers": transfers,
        "icustays": stays,
        "admissions": admissions,
        "patients": [(s, dt.datetime(2095 if s == 40 else 2040, 1, 1)) for s in (10, 20, 30, 40)],
        "services": [(10, 102, at(5, 9), "CSURG"), (10, 101, at(9), "MED")],
        "labevents": [
            (10, 102, 7, at(5, 10), "9", "abnormal"), (10, 102, 7, at(5, 9), "13", None),
            (10, 102, 7, at(9), "13", None), (10, 102, 8, at(6), "1", None),
        ],
        "d_labitems": [(7, "HEMOGLOBIN", "BLOOD"), (8, "GLUCOSE", "BLOOD")],
        "procedures_icd": [(10, 102, 1, "3995"), (10, 102, 6, "35"), (10, 101, 1, "42")],
        "drgcodes": [(10, 102, "MS", "291", "HEART FAILURE"), (10, 102, "HCFA", "", None)],
    }
    return {n: spark.createDataFrame(rows, source_schema(n)) for n, rows in made.items()}


def test_one_readmission_with_all_features(sources):
    got = episode_dataset(sources, codes=False).collect()
    assert len(got) == 1
    row = got[0].asDict()
    assert row == {
        "subjectid": 10, "hadmid": 102, "icustayid": 1002, "readm_days": 2.0, "prev_iculos": 3.0, "age": 60,
        "ethnicity": 3, "marital_status": 6, "insurance": 2, "NonEnglish": 1, "n_icutrav": 2, "curr_cu": 1,
        "prev_cu": 0, "prev_ICU": 0, "disch_cu": 0, "disch_ICU": 0, "icu_in_day": 1, "icu_out_day": 0,
        "readm_risk": 0, "nonicu-MICU": 0.667, "nonicu-SICU": 0.0, "nonicu-TSICU": 0.0, "nonicu-CSRU": 0.0,
        "MICU-MICU": 0.333, "TSICU-TSICU": 0.0, "nonicu-CCU": 0.0, "CCU-CCU": 0.0, "CSRU-CSRU": 0.0,
        "SICU-SICU": 0.0, "surg": 1, "hemoglobin": 1, "operation_nervous": 0, "operation_respiratory": 0,
        "operation_cardiovascular": 1, "dialysis": 1, "operation_digestive": 0, "intubation_res_gas": 0,
        "num_operations": 2, "icu_los": 2.5,
    }


def test_codes_fan_out_and_hot_keys_change_nothing(sources):
    hot = find_hot_keys(as_transfers(sources["transfers"]), "entity_id", "intime", rows=2)
    assert hot
    cut = episode_dataset(sources, hot=hot).orderBy("drg_code").collect()
    assert [r["drg_code"] for r in cut] == [0, 291]
    assert cut == episode_dataset(sources).orderBy("drg_code").collect()


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_sources_round_trip(spark, sources, tmp_path, fmt):
    path = str(tmp_path / fmt)
    options = {"header": "true"} if fmt == "csv" else {}
    sources["icustays"].write.format(fmt).options(**options).save(path)
    back = read_source(spark, "icustays", path, fmt)
    assert back.schema.simpleString() == source_schema("icustays").simpleString()
    assert sorted(back.collect()) == sorted(sources["icustays"].collect())


def test_missing_column_is_named(spark, sources, tmp_path):
    path = str(tmp_path / "p")
    sources["patients"].drop("dob").write.parquet(path)
    with pytest.raises(ValueError, match="dob"):
        read_source(spark, "patients", path)


def test_sql_text_under_new_names(spark, sources):
    got = sql_frame(spark, "SELECT subject_id, count(*) FROM {t} GROUP BY 1 HAVING count(*) > 5", ["s", "n"], t=sources["transfers"])
    assert got.columns == ["s", "n"] and got.count() == 4


def test_views_by_name(spark, sources):
    register_views(spark, {"t_patients": sources["patients"]})
    assert spark.sql("SELECT count(*) FROM t_patients").first()[0] == 4


def test_checkpoint_uses_the_configured_folder(spark, sources, tmp_path):
    cut = reliable_checkpoint(sources["patients"])
    assert cut.count() == 4
    assert "LogicalRDD" in cut._jdf.queryExecution().logical().toString()
