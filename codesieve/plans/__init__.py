"""Registered queries by subject; each module has QUERIES and ORACLE (DuckDB SQL)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; operators cut lineage in the folder that the session names for it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; it is not created."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def registered() -> tuple[dict, dict]:
    from . import advice, attributes, clones, cohesion, facts, findings, nested, rules, signal, streams, trees

    queries, oracle = {}, {}
    for m in (clones, findings, signal, cohesion, advice, trees, nested, rules, attributes, streams, facts):
        queries |= m.QUERIES
        oracle |= m.ORACLE
    return queries, oracle
