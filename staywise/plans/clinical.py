"""Clinical block: service during the stay, last lab flag, procedure flags (C14)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.functions.codes import PROCEDURE_RULES, in_code_ranges
from staywise.operators.asof import asof_latest, event_in_span
from staywise.operators.ordered import NO_HOT_KEYS, HotKeys


def procedure_flags(
    procedures: DataFrame,
    keys: Sequence[str],
    code: str,
    sequence: str,
    rules: Mapping[str, Sequence[tuple[str, str]]] | None = None,
    buckets: tuple[int, int] = (5, 10),
) -> DataFrame:
    """Any-match flag per rule and the bucketed highest sequence number."""
    rules = PROCEDURE_RULES if rules is None else rules
    last = F.max(sequence)
    few, some = buckets
    return procedures.groupBy(*keys).agg(
        *[F.max(in_code_ranges(code, r)).alias(name) for name, r in rules.items()],
        F.when(last <= few, 1).when(last <= some, 2).otherwise(3).alias("num_operations"),
    )


def clinical_flags(
    stays: DataFrame,
    services: DataFrame,
    labs: DataFrame,
    procedures: DataFrame,
    *,
    service_by: Sequence[str],
    lab_by: Sequence[str],
    service_time: str,
    service_tie: str,
    lab_time: str,
    lab_tie: str,
    abnormal: str,
    procedure_keys: Sequence[str],
    start: str = "stay_in",
    end: str = "stay_out",
    fill: bool = True,
    hot: HotKeys = NO_HOT_KEYS,
    lab_hot: HotKeys | None = None,
) -> DataFrame:
    """Add ``surg``, ``abnormal_lab`` and the procedure columns; no match gives 0 when ``fill``."""
    with_service = event_in_span(
        stays, services, service_by, start, end, service_time, service_tie, name="surg", hot=hot
    )
    with_lab = asof_latest(
        with_service, labs, lab_by, end, lab_time, {"abnormal_lab": F.col(abnormal)}, tie=lab_tie,
        hot=hot if lab_hot is None else lab_hot,
    )
    out = with_lab.join(procedures, list(procedure_keys), "left")
    added = ["surg", "abnormal_lab", *[c for c in procedures.columns if c not in procedure_keys]]
    return out.na.fill(0, added) if fill else out
