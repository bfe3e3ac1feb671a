"""Registered queries by name, and their DuckDB SQL."""

from .plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
