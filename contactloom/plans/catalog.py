"""Imports every plan module, so that all queries are registered."""

from contactloom.plans import arriving, entities, explorer, fileio, folders, layouts, rows, schemas, tables, texts  # noqa: F401
from contactloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
