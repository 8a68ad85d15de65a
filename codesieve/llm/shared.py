"""Shared helpers of the training-data operators: stage tables, shared files, text iteration."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words are maximal runs of characters other than space and the five ASCII controls 9 to 13.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
#: On UTF-8 bytes: A-Z to lower case, the five controls to blanks; bytes of other characters stay.
_FOLD = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; there is no other that all can be known to see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is not created."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends here,
    so an executor lost later costs a file read, not a recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    return df.mapInArrow(releasing(run), schema)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a stage folder that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def open_store(uri: str):
    """(pyarrow file system, path) of a URI in the shared folder; works on the driver and on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, name: str, data: bytes) -> str:
    """Write one file under a folder: first under a name of this attempt, then moved, so a reader never sees half of it."""
    store, base = open_store(uri)
    store.create_dir(base, recursive=True)
    attempt = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as out:
        out.write(data)
    store.move(attempt, f"{base}/{name}")
    return f"{uri}/{name}"


@contextmanager
def written(uri: str):
    """An open file to write in a folder of the shared one; no other attempt may write under this name."""
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:  # as it is, whatever the name ends with
        yield out


@contextmanager
def opened(uri: str):
    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        yield f


def get_file(uri: str) -> bytes:
    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        return f.read()


def texts(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def folded(text: str) -> bytes:
    """UTF-8 bytes with A-Z lower-cased (other letters keep their case) and the five controls as blanks."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


def words(text: str) -> list[str]:
    """Words with A-Z lower-cased."""
    return [w for w in folded(text).decode("utf-8", "surrogatepass").split(" ") if w]


#: One entry: what this worker keeps from task to task.
_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """This worker's object of a name, made anew if the last one asked for had another name.

    Workers live on from stage to stage; so only one operator's table takes memory at a time.
    """
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def release() -> None:
    """Give freed memory back to the system, since an idle worker's memory counts as well."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def releasing(run: Callable) -> Callable:
    """A function for mapInArrow that gives memory back when its task ends."""

    def released(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return released


def slices(batches: Iterator[pa.RecordBatch], column: str | tuple[str, ...], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one piece, in all columns named, come to about ``most`` bytes (a longer text stands alone)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = [pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ((column,) if isinstance(column, str) else column)]
        size = np.cumsum(sum(lengths))
        at = 0
        while at < n:
            done = int(size[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir}/{name}.parquet")
