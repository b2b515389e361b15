"""All queries of the library outside the subpackage for language-model data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesforge.plans import circles, extras, files, imaging, prepare, rasters, series, streams, tables

MODULES = (series, tables, circles, rasters, imaging, prepare, extras, files, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
