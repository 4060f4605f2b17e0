"""The whole data set from the nine care-episode source tables (C12-C14 in one lazy plan)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.functions.codes import (
    ETHNICITY_CODES,
    ETHNICITY_KEYWORDS,
    INSURANCE_CODES,
    MARITAL_CODES,
    PROCEDURE_RULES,
)
from staywise.operators.cohort import adult_entities
from staywise.operators.ordered import HotKeys, find_hot_keys
from staywise.plans.clinical import clinical_flags, procedure_flags
from staywise.plans.composite import CompositeSpec, composite_features
from staywise.plans.demographics import demographics

KEYS = {"subject_id": "entity_id", "hadm_id": "admission_id", "icustay_id": "stay_id"}


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in KEYS.items() if k in df.columns})


def as_transfers(transfers: DataFrame) -> DataFrame:
    """Source transfers under the package's names; the tie-break is a hash of the row."""
    row = F.xxhash64("eventtype", "prev_careunit", "curr_careunit", "prev_wardid", "curr_wardid", "outtime")
    return _keyed(transfers).select(
        row.alias("event_id"),
        "entity_id",
        "admission_id",
        "stay_id",
        "eventtype",
        F.coalesce("prev_careunit", F.lit("")).alias("prev_unit"),
        F.coalesce("curr_careunit", F.lit("")).alias("curr_unit"),
        "intime",
        "outtime",
    )


def episode_dataset(
    tables: Mapping[str, DataFrame],
    spec: CompositeSpec | None = None,
    codes: bool = True,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Identifiers, 35 features, diagnosis code and the label ``icu_los``.

    ``tables`` maps source table names to frames. With ``codes`` a stay appears
    once per diagnosis code of its admission, so split by stay before training;
    without, the code column is left out and each stay appears once. NULL
    features become 0. Unless ``hot`` is given, one small job looks for hot
    entities when the plan is built.
    """
    spec = spec or CompositeSpec()
    moves = as_transfers(tables["transfers"])
    if hot is None:
        hot = find_hot_keys(moves, "entity_id", "intime")
    admissions, persons = _keyed(tables["admissions"]), _keyed(tables["patients"])
    adults = adult_entities(admissions, persons, "entity_id", "admittime", "dob")
    los = _keyed(tables["icustays"]).select("stay_id", "los")
    base = composite_features(
        moves, replace(spec, nulls="keep"), keep=adults, los=los, hot=hot, with_times=True
    )
    texts = {"ethnicity": "ethnicity_text", "marital_status": "marital_text", "insurance": "insurance_text"}
    described = demographics(
        base, persons, admissions.withColumnsRenamed(texts),
        entity="entity_id", admission="admission_id", at="stay_in", born="dob", order=["admittime", "admission_id"],
        group_text="ethnicity_text", group_rules=ETHNICITY_KEYWORDS, group_codes=ETHNICITY_CODES,
        coded={"marital_status": ("marital_text", MARITAL_CODES), "insurance": ("insurance_text", INSURANCE_CODES)},
        language="language", home_language="ENGL",
    )
    surgery = _keyed(tables["services"]).filter(F.col("curr_service").contains("SURG"))
    items = tables["d_labitems"].filter((F.upper("label") == "HEMOGLOBIN") & (F.upper("fluid") == "BLOOD"))
    labs = _keyed(tables["labevents"]).join(items.select("itemid"), "itemid", "left_semi").select(
        "entity_id",
        "admission_id",
        "charttime",
        F.xxhash64("itemid", "value", "flag").alias("lab_tie"),
        F.when(F.col("flag") == "abnormal", 1).otherwise(0).alias("abnormal"),
    )
    keys = ["entity_id", "admission_id"]
    operations = procedure_flags(_keyed(tables["procedures_icd"]), keys, "icd9_code", "seq_num")
    full = clinical_flags(
        described, surgery, labs, operations,
        service_by=keys, lab_by=keys, service_time="transfertime", service_tie="curr_service",
        lab_time="charttime", lab_tie="lab_tie", abnormal="abnormal", procedure_keys=keys, hot=hot,
        # lab events are another table: an entity may hold many of them and few transfers
        lab_hot=find_hot_keys(labs, "entity_id", "charttime"),
    )
    if codes:
        coded = _keyed(tables["drgcodes"]).select(
            *keys, F.nullif("drg_code", F.lit("")).try_cast("int").alias("drg_code")
        )
        full = full.join(coded, keys, "left")
    pairs = dict(zip(spec.pair_columns, spec.pairs))
    out = full.select(
        F.col("entity_id").alias("subjectid"),
        F.col("admission_id").alias("hadmid"),
        F.col("stay_id").alias("icustayid"),
        "readm_days",
        F.col("prev_los").alias("prev_iculos"),
        "age",
        "ethnicity",
        "marital_status",
        "insurance",
        F.col("non_home_language").alias("NonEnglish"),
        F.col("n_transfers").alias("n_icutrav"),
        "curr_cu",
        "prev_cu",
        F.col("prev_flag").alias("prev_ICU"),
        "disch_cu",
        F.col("disch_flag").alias("disch_ICU"),
        F.col("in_day").alias("icu_in_day"),
        F.col("out_day").alias("icu_out_day"),
        "readm_risk",
        *[F.col(c).alias(label) for c, label in pairs.items()],
        "surg",
        F.col("abnormal_lab").alias("hemoglobin"),
        *PROCEDURE_RULES,
        "num_operations",
        *(["drg_code"] if codes else []),
        F.col("los").alias("icu_los"),
    )
    return out.na.fill(0)
