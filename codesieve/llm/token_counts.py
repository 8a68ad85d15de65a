"""Token-count rollups kept by deltas.

A batch holds signed changes of documents: ``insert`` adds a document's tokens, ``delete`` takes them
away, ``revise`` puts a new count in the place of an old one. Its changes are summed to one row for
each source, language and tokenizer version before anything is stored, so a batch costs its own size
and a total is the sum of the committed batches' rows. A batch is a folder named by its id and is
moved into place in one step: a second commit of the same id changes nothing.

Cases: null source, lang or text are kept (a null text has its end id alone); repeated rows count
each; an empty batch commits and changes nothing; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shared, tokens

KEYS = ("source", "lang", "tokenizer_version")
SUMS = ("n_docs", "n_tokens", "n_chars")
DELTAS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long"
VERSION = "word_bpe_49k-1"
_COUNTED = pa.schema([("source", pa.string()), ("lang", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_chars", pa.int64())])


def counted(docs: DataFrame, version: str = VERSION, path: str | None = None) -> DataFrame:
    """Counts of whole texts, summed within each batch of rows: source, lang, tokenizer_version, n_docs, n_tokens, n_chars."""

    def run(batches):
        encode = tokens.encoder(path).encode
        sums: dict[tuple, list[int]] = {}
        for b in shared.slices(batches, "text"):
            t = shared.texts(b.column("text"))
            _, n = encode(t)
            for source, lang, k, x in zip(b.column("source").to_pylist(), b.column("lang").to_pylist(), n.tolist(), t):
                s = sums.setdefault((source, lang), [0, 0, 0])
                s[0] += 1
                s[1] += k
                s[2] += len(x)
            if len(sums) > 10_000:
                yield _flush(sums)
        yield _flush(sums)

    def _flush(sums):
        keys, values = list(sums), list(sums.values())
        sums.clear()
        columns = [[k[0] for k in keys], [k[1] for k in keys], *([v[i] for v in values] for i in range(3))]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _COUNTED)], schema=_COUNTED)

    rows = shared.in_arrow(docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), "text"), run, "source string, lang string, n_docs long, n_tokens long, n_chars long")
    return rows.select("source", "lang", F.lit(version).alias("tokenizer_version"), *SUMS)


def inserts(counts: DataFrame) -> DataFrame:
    return counts


def deletes(counts: DataFrame) -> DataFrame:
    """Counts with the sign turned."""
    return counts.select(*KEYS, *((-F.col(c)).alias(c) for c in SUMS))


def revises(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old counts go, the new ones come; the keys may differ."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Additive totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or shared.new_folder(spark, "rollup")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def committed(self) -> list[str]:
        return sorted(n[6:] for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(""))) if n.startswith("batch="))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Commit a batch; False where its id is committed already (nothing changes then)."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch_id):
            raise ValueError(f"batch id {batch_id!r}")
        if self._fs.exists(self._path(f"batch={batch_id}")):
            return False
        attempt = f"_attempt-{uuid.uuid4().hex}"
        summed = deltas.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        summed.coalesce(1).write.parquet(f"{self.folder}/{attempt}")
        # the rename is the commit: of two writers of one id the second finds the folder and drops its own
        target = self._path(f"batch={batch_id}")
        if self._fs.exists(target) or not self._fs.rename(self._path(attempt), target):
            self._fs.delete(self._path(attempt), True)
            return False
        nested = self._path(f"batch={batch_id}/{attempt}")
        if self._fs.exists(nested):  # the other writer's rename came in between
            self._fs.delete(nested, True)
            return False
        return True

    def batches(self) -> DataFrame:
        names = self.committed()
        if not names:
            return self.spark.createDataFrame([], DELTAS)
        return self.spark.read.schema(DELTAS).parquet(*(f"{self.folder}/batch={n}" for n in names))

    def totals(self) -> DataFrame:
        """One row for each key whose documents aren't all gone."""
        t = self.batches().groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        return t.filter(" or ".join(f"{c} <> 0" for c in SUMS))



def estimated(docs: DataFrame, version: str = VERSION, chars_per_token: int = 4) -> DataFrame:
    """Provisional counts from lengths alone, for a first batch that a revision replaces."""
    return (
        docs.groupBy(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))
        .select("source", "lang", F.lit(version).alias("tokenizer_version"), "n_docs", F.expr(f"n_chars div {chars_per_token} + n_docs").alias("n_tokens"), "n_chars")
    )


def rolled_up(docs: DataFrame, version: str = VERSION, path: str | None = None) -> DataFrame:
    """Totals of a table by way of three commits: estimated inserts, the revision to exact counts, and a replay of the first."""
    spark = docs.sparkSession
    rollup = Rollup(spark)
    first = shared.staged(estimated(docs, version), "estimated")
    exact = counted(docs, version, path)
    rollup.commit("0-estimate", inserts(first))
    rollup.commit("1-exact", revises(first, exact))
    rollup.commit("0-estimate", inserts(first))
    return rollup.totals()
