"""Column expressions over categorical codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category codes of the composite dataset.
UNIT_CODES = {"": 0, "MICU": 1, "CSRU": 2, "SICU": 3, "CCU": 4, "TSICU": 5, "NICU": 6, "NWARD": 7}
ETHNICITY_CODES = {"asian": 0, "black": 1, "hispanic": 2, "white": 3, "other": 4, "na": 5}
MARITAL_CODES = {
    "SINGLE": 0, "MARRIED": 1, "DIVORCED": 2, "SEPARATED": 3, "WIDOWED": 4, "LIFE PARTNER": 5,
    "UNKNOWN (DEFAULT)": 6, "": 6,
}
INSURANCE_CODES = {"Government": 0, "Medicaid": 1, "Medicare": 2, "Private": 3, "Self Pay": 4}
ETHNICITY_KEYWORDS = (
    ("hispanic", ("hispanic",)),
    ("asian", ("asian", "pacific islander")),
    ("white", ("white",)),
    ("black", ("black",)),
    ("na", ("decline", "unable")),
)
# Procedure-code rules, compared as strings.
PROCEDURE_RULES = {
    "operation_nervous": (("01", "05"),),
    "operation_respiratory": (("30", "34"), ("9390", "9399")),
    "operation_cardiovascular": (("35", "39"), ("0013", "0013"), ("0017", "0017"), ("9960", "9969")),
    "dialysis": (("3995", "3995"), ("5498", "5498")),
    "operation_digestive": (("42", "54"),),
    "intubation_res_gas": (("960", "967"),),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode(c: Column | str, codes: Mapping[str, int]) -> Column:
    """Integer code of a category, NULL when it is not in the map."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in codes.items()))
    return F.try_element_at(table, _col(c))


def bin_by_keyword(
    c: Column | str, rules: Sequence[tuple[str, Sequence[str]]], default: str = "other"
) -> Column:
    """Name of the first rule with a keyword contained in the lower-cased text."""
    text = F.lower(_col(c))
    out = None
    for name, words in rules:
        hit = text.contains(words[0])
        for word in words[1:]:
            hit = hit | text.contains(word)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def flag_between(c: Column | str, low: int, high: int) -> Column:
    """1 when strictly between the bounds, else 0; NULL gives 0."""
    c = _col(c)
    return F.when((c > low) & (c < high), 1).otherwise(0)


def flag_differs(c: Column | str, value: str) -> Column:
    """0 iff equal to ``value``; NULL gives 1."""
    return F.when(_col(c).eqNullSafe(F.lit(value)), 0).otherwise(1)


def fill_blank(c: Column | str, value: str) -> Column:
    """Empty or NULL becomes ``value``."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(value))


def is_not(c: Column | str, *values: str) -> Column:
    """``!=`` that keeps NULL rows."""
    keep = F.lit(True)
    for value in values:
        keep = keep & ~_col(c).eqNullSafe(F.lit(value))
    return keep


def in_code_ranges(c: Column | str, ranges: Sequence[tuple[str, str]]) -> Column:
    """1 when the string code lies in any range, compared lexicographically."""
    c = _col(c)
    hit = F.lit(False)
    for low, high in ranges:
        if low > high:
            raise ValueError(f"reversed range {low!r}..{high!r}")
        hit = hit | c.between(low, high)
    return F.when(hit, 1).otherwise(0)


def exceeds(c: Column | str, threshold: float) -> Column:
    """1 when above the threshold (P25)."""
    return (_col(c) > threshold).cast("int")


def pair_label(a: Column | str, b: Column | str) -> Column:
    """``a-b`` (P23)."""
    return F.concat_ws("-", _col(a), _col(b))


def hash_unit(seed: str, *keys: Column | str) -> Column:
    """Repeatable number in [0, 1) from the keys: first 32 bits of an md5 digest."""
    text = F.concat_ws(":", F.lit(seed), *[_col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
