"""Hard negatives by blocked matrix products.

Vectors become integers floor(scale * x). Candidates lie in shard files of at most ``SHARD`` rows, anchors in
block files of at most ``ANCHORS``. A task takes one block of anchors and a group of shards, multiplies the
block with slices of the shards as float64 matrices (exact below 2**53, else Python integers) and keeps a
list for each anchor that merges with the lists of other tasks.

First pass: an anchor's ``positives`` best rows of its own label. Second pass: the anchor blocks are written
anew with their positives' scores, and each positive keeps its best rows of other labels in the window
low * positive <= 100 * negative <= 100 * positive. Higher scores come first, ties by smaller vec_id.

Cases: rows with a null id, label or vector or a null or non-finite component take no part; rows that repeat
a vec_id are rows of their own, none of them is a candidate of that id's anchor; exact repeats of an anchor
are one anchor; a negative positive score has an empty window; shorter vectors are filled up with zeros; an
empty table gives no row; other columns are ignored. A score beyond 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import shared, vectors

SCALE = 256
SHARD, ANCHORS, SLICE = 1 << 15, 512, 4096
SHARDS_A_TASK = 8
_FILES = pa.schema([("file", pa.string())])
_POSITIVES = pa.schema([("anchor_id", pa.int64()), ("anchor_no", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_NEGATIVES = pa.schema([("anchor_id", pa.int64()), ("anchor_no", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Best:
    """The ``k`` best (score, id) of each row: higher scores first, ties by smaller id."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.floor = np.full(rows, -np.inf)

    def merge(self, scores: np.ndarray, ok: np.ndarray, ids: np.ndarray) -> None:
        """Take a matrix of scores against ``ids``; ``ok`` tells which count."""
        if scores.dtype == object:
            row, at = np.nonzero(ok)
            score = scores[row, at]
        else:
            s = np.where(ok, scores, -np.inf)
            least = self.floor
            if s.shape[1] > self.k:  # nothing below a slice's own k-th can be among the best
                least = np.maximum(least, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
            row, at = np.nonzero((s >= least[:, None]) & ok)
            score = s[row, at]
        row, id_ = np.concatenate([self.row, row]), np.concatenate([self.id, ids[at]])
        score = np.concatenate([self.score.astype(score.dtype), score])
        if score.dtype == object:
            order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], id_[i])), np.int64)
        else:
            order = np.lexsort((id_, -score, row))
        row, score, id_ = row[order], score[order], id_[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < self.k
        self.row, self.score, self.id = row[keep], score[keep], id_[keep]
        if score.dtype != object:
            full, counts = np.unique(self.row, return_counts=True)
            last = np.cumsum(counts) - 1
            self.floor[full[counts == self.k]] = self.score[last[counts == self.k]]


def _products(anchors: np.ndarray, m: np.ndarray):
    """Slices of the shard's rows and the anchors' products with them."""
    most = 100 * max(int(np.abs(anchors).max(initial=0)), 1) * max(int(np.abs(m).max(initial=0)), 1) * m.shape[1]
    kind = np.float64 if most < 2**53 else object
    a = anchors.astype(kind)
    for at in range(0, len(m), SLICE):
        part = slice(at, at + SLICE)
        yield part, a @ m[part].astype(kind).T


def _written(folder: str, name: str, dims: int, scale: int, most: int, extra: int):
    """Tasks that write blocks: ids, labels, matrix, then ``extra`` further columns of integers or lists of integers."""

    def run(batches):
        pid, held, n, files = TaskContext.get().partitionId(), [], 0, 0
        for b in batches:
            keep, m = vectors.integers(b.column(2), scale, dims)
            rest = [b.column(i).take(pa.array(keep)).to_pylist() for i in range(3, 3 + extra)]
            held.append([b.column(0).to_numpy()[keep], b.column(1).to_numpy()[keep], m, *(np.array(x, np.int64).reshape(len(keep), -1) if x and isinstance(x[0], list) else np.array(x, np.int64) for x in rest)])
            n += len(keep)
            while n >= most:
                columns = [np.concatenate(c) for c in zip(*held)]
                held, n = [[c[most:] for c in columns]], n - most
                yield _file(shared.put_file(folder, f"{name}-{pid:06d}-{files:06d}", _block([c[:most] for c in columns])))
                files += 1
        if n:
            yield _file(shared.put_file(folder, f"{name}-{pid:06d}-{files:06d}", _block([np.concatenate(c) for c in zip(*held)])))

    return run


def _block(columns: list[np.ndarray]) -> bytes:
    return vectors.packed([columns[0], columns[1], vectors.narrow(columns[2]), *columns[3:]])


def _file(name: str) -> pa.RecordBatch:
    return shared.batch_of(_FILES, {"file": [name]})


def _work(anchor_files: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """A row (file, shards) for each block of anchors and group of shards; only names are joined."""
    pairs = anchor_files.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    tasks = max(1, min(10_000, anchor_files.count() * n_groups))
    return pairs.join(groups, "part").select("file", "shards").repartition(tasks)


def _nearest(k: int):
    """First pass of a task."""

    def run(batches):
        for b in batches:
            for file, shards in zip(b.column("file").to_pylist(), b.column("shards").to_pylist()):
                ids, labels, a, no = vectors.unpacked(shared.get_file(file))
                best = Best(len(ids), k)
                for shard in shards:
                    own, theirs, m = vectors.unpacked(shared.get_file(shard))
                    for part, scores in _products(a, m):
                        best.merge(scores, (labels[:, None] == theirs[part]) & (ids[:, None] != own[part]), own[part])
                yield shared.batch_of(_POSITIVES, {"anchor_id": ids[best.row], "anchor_no": no[best.row], "vec_id": best.id, "score": [int(s) for s in best.score]})

    return run


def _windowed(k: int, low: int):
    """Second pass of a task."""

    def run(batches):
        for b in batches:
            for file, shards in zip(b.column("file").to_pylist(), b.column("shards").to_pylist()):
                ids, labels, a, no, count, wanted = vectors.unpacked(shared.get_file(file))
                best = [Best(len(ids), k) for _ in range(wanted.shape[1])]
                for shard in shards:
                    own, theirs, m = vectors.unpacked(shared.get_file(shard))
                    for part, scores in _products(a, m):
                        other = (labels[:, None] != theirs[part]) & (ids[:, None] != own[part])
                        hundred = scores * 100
                        for j, mine in enumerate(best):
                            p = wanted[:, j : j + 1].astype(scores.dtype)
                            mine.merge(scores, other & (count > j)[:, None] & (hundred <= 100 * p) & (hundred >= low * p), own[part])
                for j, mine in enumerate(best):
                    yield shared.batch_of(_NEGATIVES, {"anchor_id": ids[mine.row], "anchor_no": no[mine.row], "place": np.full(len(mine.row), j, np.int32), "vec_id": mine.id, "score": [int(s) for s in mine.score]})

    return run


def mined(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = SCALE, shard: int = SHARD, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (vec_id, label, embedding)."""
    spark = rows.sparkSession
    good = F.coalesce(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    used = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and label is not null").filter(good)
    dims, count = used.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    dims, count, folder = max(dims or 0, 1), count or 0, shared.new_folder(spark, "negatives")
    n_shards = max(1, -(-count // shard))
    # whole shards: rows are dealt out evenly, whatever their ids and labels
    shard_files = shared.staged(shared.in_arrow(used.repartition(n_shards), _written(folder, "shard", dims, scale, shard * 2, 0), "file string"), "shards")
    groups = shard_files.withColumn("part", F.pmod(F.xxhash64("file"), F.lit(max(1, -(-n_shards // SHARDS_A_TASK))))).groupBy("part").agg(F.collect_list("file").alias("shards"))
    groups = shared.staged(groups.withColumn("part", F.col("part").cast("int")), "shard-groups")
    n_groups = max(1, -(-n_shards // SHARDS_A_TASK))

    chosen = shared.staged(used.filter(is_anchor).withColumn("anchor_no", F.xxhash64("label", "embedding")).distinct(), "anchors")
    n_blocks = max(1, -(-chosen.count() // anchors))
    blocks = shared.staged(shared.in_arrow(chosen.select("vec_id", "label", "embedding", "anchor_no").repartition(n_blocks), _written(folder, "anchors", dims, scale, anchors * 2, 1), "file string"), "anchor-files")
    near = shared.in_arrow(_work(blocks, groups, n_groups), _nearest(positives), "anchor_id long, anchor_no long, vec_id long, score long")
    by = Window.partitionBy("anchor_id", "anchor_no").orderBy(F.desc("score"), "vec_id")
    first = near.withColumn("place", F.row_number().over(by) - 1).filter(F.col("place") < positives)
    first = shared.staged(first.select("anchor_id", "anchor_no", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    listed = first.groupBy(F.col("anchor_id").alias("vec_id"), "anchor_no").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("x"))
    padded = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.try_element_at("x", i + 1)["positive_score"], F.lit(0).cast("long")))
    again = chosen.join(listed, ["vec_id", "anchor_no"]).select("vec_id", "label", "embedding", "anchor_no", "n", padded.alias("wanted"))
    blocks = shared.staged(shared.in_arrow(again.repartition(n_blocks), _written(folder, "windows", dims, scale, anchors * 2, 3), "file string"), "anchor-files")
    found = shared.in_arrow(_work(blocks, groups, n_groups), _windowed(negatives, low), "anchor_id long, anchor_no long, place int, vec_id long, score long")
    by = Window.partitionBy("anchor_id", "anchor_no", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= negatives)
    out = ranked.join(first, ["anchor_id", "anchor_no", "place"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
