"""Sessions and the scope in which 64-bit arithmetic wraps."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_or_create(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


@contextmanager
def wrapping(spark: SparkSession):
    """Expressions analysed within the scope wrap on overflow; the mode stays with them when they run later."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; it is not created."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the folder that driver and executors share, and read back: lineage ends here as with ``checkpoint``,
    which runs its last stage twice and writes rows uncompressed."""
    path = new_path(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_table(folder: str, number: int, columns: list[str] | None = None):
    """The rows of one block of a folder that was written by ``block``, read by a task."""
    import pyarrow.dataset as pads
    from pyarrow import fs

    store, path = (fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")) if folder.startswith("file:") else fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    return pads.dataset(f"{path}/block={number}", filesystem=store, format="parquet").to_table(columns=columns).combine_chunks()
