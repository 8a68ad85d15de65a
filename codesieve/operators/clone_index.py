"""A clone index that grows by loads: each load passes over new and changed texts alone.

Sets of retained shingles are known by their digest. A folder that all executors share has, for each load, the
members that changed (which text has which set), the sets that are new, their bands in the order of shards (the
first bits of the bucket), and the candidate pairs that have a new set; a marker that is made last makes a load
count. Nothing that an earlier load wrote is written again. A load of few shards reads those parts of earlier
files alone that hold them, since files are cut and sorted by shard.

Cases: a text whose content and settings are known is not passed again; a text that has fewer tokens than a
shingle is a member without a set; of rows that repeat a key the greatest text counts; a set whose last member
goes has no part in pairs from then on; an empty load commits and changes nothing.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import staged
from . import pairs as P, sketch as S

MEMBERS = "doc_id long, content string, config string, digest binary, gone boolean, load int"
SETS = "digest binary, hashes array<bigint>"
BANDS = "band int, bucket string, digest binary, shard int"
PAIRS = "a binary, b binary"
#: Shards that a filter names; more are left to the join.
MOST_LISTED = 500


class CloneIndex:
    def __init__(self, spark: SparkSession, folder: str, k: int, window: int, profile: str = "T1", n_bands: int = 32, rows: int = 4, bits: int = 12):
        S.check_bands(n_bands, rows)
        self.spark, self.folder = spark, folder.rstrip("/")
        self.k, self.window, self.profile, self.n_bands, self.rows, self.bits = k, window, profile, n_bands, rows, bits
        self.config = hashlib.sha256(repr((k, window, profile, n_bands, rows, bits)).encode()).hexdigest()
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def loads(self) -> list[str]:
        """Folders of the committed loads, in order."""
        marks = sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(""))) if n.startswith("load-"))
        return [f"{self.folder}/data-{m.split('-', 2)[2]}" for m in marks]

    def _read(self, part: str, schema: str, shards: list[int] | None = None) -> DataFrame:
        paths = [f"{x}/{part}" for x in self.loads()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).parquet(*paths)
        return found if shards is None else found.filter(F.col("shard").isin(shards))

    def members(self) -> DataFrame:
        """(doc_id, content, config, digest) as of the last load."""
        last = Window.partitionBy("doc_id").orderBy(F.desc("load"))
        rows = self._read("members", MEMBERS).withColumn("_n", F.row_number().over(last)).filter("_n = 1 and not gone")
        return rows.select("doc_id", "content", "config", "digest")

    def load(self, docs: DataFrame, complete: bool = False) -> int:
        """Take in ``docs`` (doc_id, text); with ``complete`` texts that they lack go. Returns how many texts were passed over."""
        number, attempt = len(self.loads()), uuid.uuid4().hex
        to = f"{self.folder}/data-{attempt}"
        texts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")).withColumn("content", F.sha2(F.col("text").cast("binary"), 256))
        known = self.members().select("doc_id", F.col("content").alias("_c"), F.col("config").alias("_s"))
        same = (F.col("_c") == F.col("content")) & (F.col("_s") == self.config)
        dirty = texts.join(known, "doc_id", "left").filter(~F.coalesce(same, F.lit(False))).select("doc_id", "text", "content").transform(staged)
        signed = S.signed_sets(dirty, self.k, self.window, (self.profile,)).transform(staged)
        changed = dirty.select("doc_id", "content").join(signed.select("doc_id", "digest"), "doc_id", "left").select("doc_id", "content", F.lit(self.config).alias("config"), "digest", F.lit(False).alias("gone"), F.lit(number).alias("load"))
        if complete:
            gone = self.members().join(texts.select("doc_id"), "doc_id", "left_anti").select("doc_id", "content", "config", "digest", F.lit(True).alias("gone"), F.lit(number).alias("load"))
            changed = changed.unionByName(gone)
        changed.write.parquet(f"{to}/members")

        old = self._read("sets", SETS)
        fresh = signed.join(old.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.min_by(F.struct("hashes", "lanes"), "doc_id").alias("x")).select("digest", "x.hashes", "x.lanes").transform(staged)
        fresh.select("digest", "hashes").write.parquet(f"{to}/sets")
        cut = S.bands(fresh, self.n_bands, self.rows, "digest").select("band", F.md5(F.array_join(F.transform("band_key", lambda x: x.cast("string")), ",")).alias("bucket"), "digest")
        bands = cut.withColumn("shard", F.shiftright(F.conv(F.substring("bucket", 1, 4), 16, 10).cast("int"), 16 - self.bits)).transform(staged)
        bands.repartitionByRange("shard", "band", "bucket").sortWithinPartitions("shard", "band", "bucket").write.parquet(f"{to}/bands")
        shards = [r.shard for r in bands.select("shard").distinct().limit(MOST_LISTED + 1).collect()]
        theirs = self._read("bands", BANDS, shards if len(shards) <= MOST_LISTED else None).select("band", "bucket", "shard", "digest").unionByName(bands.select("band", "bucket", "shard", "digest"))
        met = bands.withColumnRenamed("digest", "mine").join(theirs.withColumnRenamed("digest", "other"), ["shard", "band", "bucket"]).filter("mine <> other")
        met.select(F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")).distinct().write.parquet(f"{to}/pairs")
        own = self._path(f"_{attempt}")
        self._fs.create(own, False).close()
        if number != len(self.loads()) or not self._fs.rename(own, self._path(f"load-{number:08d}-{attempt}")):
            raise RuntimeError("another load was committed meanwhile")
        return dirty.count()

    def verified(self, numerator: int, denominator: int) -> DataFrame:
        """(left, right, intersection, union, score) of the sets' smallest members whose similarity reaches the fraction."""
        P.check_threshold(numerator, denominator)
        live = self.members().filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        sets = self._read("sets", SETS).join(live, "digest").select("digest", "doc_id", "hashes")
        side = lambda s: sets.select(F.col("digest").alias(s), F.col("doc_id").alias(f"{s}_id"), F.col("hashes").alias(f"{s}_hashes"))
        both = self._read("pairs", PAIRS).distinct().join(side("a"), "a").join(side("b"), "b")
        ends = both.select(F.least("a_id", "b_id").alias("left"), F.greatest("a_id", "b_id").alias("right"), F.size(F.array_intersect("a_hashes", "b_hashes")).cast("bigint").alias("intersection"), (F.size("a_hashes") + F.size("b_hashes")).cast("bigint").alias("total"))
        out = ends.withColumn("union", F.col("total") - F.col("intersection")).drop("total")
        return out.filter(P.meets(F.col("intersection"), F.col("union"), numerator, denominator)).withColumn("score", P.X.ratio_text(F.col("intersection"), F.col("union")))
