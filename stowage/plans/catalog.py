"""Every query over object inventories, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators import audit, changes, decisions, files, members, placement
from stowage.operators import inventory as _inventory
from stowage.plans.registry import ORACLES, QUERIES
from stowage.sources import inventory

_MODULES = (audit, changes, decisions, files, members, _inventory, placement)

__all__ = ["ORACLES", "QUERIES", "entry"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by primary instance."""
    first = placement.primary(inventory.doc_oids(spark, sf_dir), inventory.inst(spark), 2)
    return first.groupBy("primary").agg(F.count("*").alias("objects")).orderBy("primary")
