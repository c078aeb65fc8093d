"""Registered queries. Importing the package registers all of them."""

from . import flows, folds, logs, messages, models, more, steps, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
