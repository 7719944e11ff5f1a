"""The pN_ queries of schema drift, over the whole of ``raw_records``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codexweave.operators import schema_drift
from codexweave.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.found_changes(table(spark, sf_dir, "raw_records"))


def _consistent(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return schema_drift.consistent_table(table(spark, sf_dir, "raw_records"), kind, table(spark, sf_dir, kind))

    return query


QUERIES = {"p2_found": p2_found} | {f"p2_{kind}": _consistent(kind) for kind in ("history", "job_status", "quality")}
