"""Registry of the engine's queries and of the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.plans import details, invoices, layout, records, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = invoices.QUERIES | records.QUERIES | details.QUERIES | stored.QUERIES | layout.QUERIES
ORACLES: dict[str, str] = invoices.ORACLES | records.ORACLES | details.ORACLES | stored.ORACLES | layout.ORACLES
