"""Cohort filters and exclusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.functions.times import age_in_years, unshift_age


def multi_stay_entities(stays: DataFrame, entity: str = "entity_id", more_than: int = 1) -> DataFrame:
    """Entities with more than ``more_than`` stays and their count (A5)."""
    return stays.groupBy(entity).agg(F.count("*").alias("n_stays")).filter(F.col("n_stays") > more_than)


def keep_entities(df: DataFrame, entities: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Semi join: rows whose entity is in ``entities``."""
    return df.join(entities.select(entity), entity, "left_semi")


def drop_stays_touching(
    stays: DataFrame,
    transfers: DataFrame,
    excluded: Sequence[str],
    keys: Sequence[str] = ("entity_id", "stay_id"),
    unit: str = "curr_unit",
) -> DataFrame:
    """Anti join: stays with no row in an excluded unit (P5); ``keys`` tell stays apart, the last one may be NULL in ``transfers``."""
    keys = list(keys)
    touched = (
        transfers.filter(F.col(unit).isin(*excluded) & F.col(keys[-1]).isNotNull()).select(*keys).distinct()
    )
    return stays.join(touched, keys, "left_anti")


def entity_ages(
    admissions: DataFrame, persons: DataFrame, entity: str, admitted: str, born: str
) -> DataFrame:
    """Age at each admission, shift undone above 89."""
    return admissions.join(persons.select(entity, born), entity).select(
        entity, unshift_age(age_in_years(born, admitted)).alias("age")
    )


def adult_entities(
    admissions: DataFrame, persons: DataFrame, entity: str, admitted: str, born: str, above: int = 17
) -> DataFrame:
    """Entities with any admission above the age limit (Q6)."""
    ages = entity_ages(admissions, persons, entity, admitted, born)
    return ages.filter(F.col("age") > above).select(entity).distinct()


def apply_exclusions(
    stays: DataFrame,
    transfers: DataFrame,
    excluded_units: Sequence[str],
    keep: DataFrame,
    entity: str = "entity_id",
) -> DataFrame:
    """Stays outside the excluded units, of the entities to keep."""
    return keep_entities(drop_stays_touching(stays, transfers, excluded_units), keep, entity)
