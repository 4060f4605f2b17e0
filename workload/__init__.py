"""All registered queries; importing the modules fills the registry."""

from workload import aggregates, ensembles, features, filters, joins, modelling, preparation, regression, scalars, streams  # noqa: F401
from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
