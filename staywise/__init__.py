"""Spark-native analytics over entity / admission / stay / transfer data."""

from staywise.session import session

__all__ = ["session"]
