"""Demographic block: age and category codes per admission."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.functions.codes import bin_by_keyword, encode, flag_differs
from staywise.functions.times import age_truncated, unshift_age


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First row per key in a stated order, as an aggregate."""
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("_f")
    return df.groupBy(*keys).agg(first).select(*keys, "_f.*")


def demographics(
    cases: DataFrame,
    persons: DataFrame,
    admissions: DataFrame,
    *,
    entity: str,
    admission: str,
    at: str,
    born: str,
    order: Sequence[str],
    group_text: str,
    group_rules: Sequence[tuple[str, Sequence[str]]],
    group_codes: Mapping[str, int],
    coded: Mapping[str, tuple[str, Mapping[str, int]]],
    language: str,
    home_language: str,
    above: int = 17,
    age: Column | None = None,
) -> DataFrame:
    """Add ``age``, ``ethnicity``, one code per entry of ``coded`` and ``non_home_language``.

    The broad group comes from the entity's first admission; the others from
    the admission itself. Cases at or below the age limit are dropped.
    """
    # one row per admission and one per entity, so neither join can repeat a case
    by_entity = first_per_key(admissions, [entity], order, [group_text]).select(
        entity,
        encode(bin_by_keyword(group_text, group_rules), group_codes).alias("ethnicity"),
    )
    source = {name: column for name, (column, _) in coded.items()}
    wanted = list(dict.fromkeys([*source.values(), language]))
    by_admission = first_per_key(admissions, [entity, admission], order, wanted).select(
        entity,
        admission,
        *[encode(column, table).alias(name) for name, (column, table) in coded.items()],
        flag_differs(language, home_language).alias("non_home_language"),
    )
    age = unshift_age(age_truncated(born, at)) if age is None else age
    return (
        cases.join(persons.select(entity, born), entity, "left")
        .withColumn("age", age)
        .filter(F.col("age") > above)
        .drop(born)
        .join(by_entity, entity, "left")
        .join(by_admission, [entity, admission], "left")
    )
