"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integers floor(1024 x) and lie in shard files: ranges of at most ``SHARD`` vectors in an
order that puts like sign patterns together, cut into blocks of ``BLOCK``. A shard's head has each block's
minimum and maximum of each component; behind it stand the blocks' forward indexes (ids and components).
For a query a block's bound is the sum over components of the larger of q * maximum and q * minimum. A
task takes one batch of queries and one shard: every query visits the shard's blocks by falling bound and
stops where the bound is below its k-th score so far (an equal bound may hold a smaller id). The shards'
lists are merged per query.

Scores are exact: products of float64 matrices while every sum stays below 2**53, else Python integers; a score beyond 64 bits is an error.

Cases: null vectors, null or non-finite components and null ids take no part; exact repeats of a row count
once; rows that repeat an id with another vector are vectors of their own, and none of them is a candidate
for that id's query; shorter vectors are filled up with zeros; an empty table gives no row; other columns
are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import shared

SCALE = 1024
BLOCK = 256
SHARD = 1 << 15
QUERY_BATCH = 256
PLANES = 12
_FILES = pa.schema([("queries", pa.bool_()), ("file", pa.string())])
_ROWS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the valid vectors, their integers)."""
    keep, rows = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is None or None in v:
            continue
        x = np.floor(np.array(v, np.float64) * SCALE)
        if np.isfinite(x).all():
            keep.append(i)
            rows.append(np.pad(x, (0, dims - len(x))))
    m = np.array(rows).reshape(len(rows), dims)
    return np.array(keep, np.int64), m.astype(np.int64) if not len(m) or np.abs(m).max() < 2**62 else m.astype(object)


def _pattern(m: np.ndarray) -> np.ndarray:
    """Sign pattern against fixed planes, as an order of like vectors."""
    planes = np.random.default_rng(11).standard_normal((m.shape[1], PLANES))
    return ((m.astype(np.float64) @ planes > 0) * (1 << np.arange(PLANES))).sum(axis=1)


def pack(ids: np.ndarray, m: np.ndarray, block: int = BLOCK) -> bytes:
    """A shard: rows, dims, block size, block minima and maxima, then the blocks."""
    cuts = range(0, len(ids), block)
    low = np.array([m[a : a + block].min(axis=0) for a in cuts], "<i8")
    high = np.array([m[a : a + block].max(axis=0) for a in cuts], "<i8")
    return struct.pack("<QQQ", len(ids), m.shape[1], block) + low.tobytes() + high.tobytes() + ids.astype("<i8").tobytes() + m.astype("<i8").tobytes()


def unpack(data: bytes):
    n, dims, block = struct.unpack_from("<QQQ", data)
    k = -(-n // block)
    at = 24
    low = np.frombuffer(data, "<i8", k * dims, at).reshape(k, dims)
    high = np.frombuffer(data, "<i8", k * dims, at + 8 * k * dims).reshape(k, dims)
    at += 16 * k * dims
    return low, high, np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "<i8", n * dims, at + 8 * n).reshape(n, dims), block


def search(query_ids: np.ndarray, q: np.ndarray, shard, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score): each query's best of a shard, ties by smaller id."""
    low, high, ids, m, block = shard
    most = max(int(np.abs(q).max(initial=0)), 1) * max(int(np.abs(low).max(initial=0)), int(np.abs(high).max(initial=0)), 1) * m.shape[1]
    kind = np.float64 if most < 2**53 else object
    q, m, low, high = (x.astype(kind) for x in (q, m, low, high))
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bounds.astype(np.float64), axis=1, kind="stable")
    if kind is object:  # floats don't order large integers
        order = np.array([sorted(range(len(b)), key=lambda i: -b[i]) for b in bounds])
    best: list[list[tuple]] = [[] for _ in q]  # (-score, id)
    active = np.arange(len(q))
    for turn in range(len(low)):
        places = order[active, turn]
        kth = [-best[i][k - 1][0] if len(best[i]) >= k else None for i in active]
        go = np.array([t is None or bounds[i, b] >= t for i, b, t in zip(active, places, kth)], bool)
        active, places = active[go], places[go]
        if not len(active):
            break
        for b in np.unique(places):
            mine = active[places == b]
            part = slice(b * block, (b + 1) * block)
            scores, own = q[mine] @ m[part].T, ids[part]
            for i, s in zip(mine.tolist(), scores):
                floor = -best[i][k - 1][0] if len(best[i]) >= k else None
                at = np.flatnonzero(s >= floor) if floor is not None else np.arange(len(s))
                new = [(-int(s[j]), int(own[j])) for j in at if own[j] != query_ids[i]]
                if new:
                    best[i] = sorted(best[i] + new)[:k]
    return [(int(query_ids[i]), v, -s) for i, rows in enumerate(best) for s, v in rows]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, shard_rows: int = SHARD, block: int = BLOCK, query_batch: int = QUERY_BATCH) -> DataFrame:
    """query_id, rank, vec_id, score of ``vectors`` (vec_id, embedding) for the rows where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    found = rows.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    dims, count = found[0] or 0, found[1]
    folder = shared.new_folder(spark, "vectors")

    def write(queries: bool, most: int):
        def run(batches):
            pid, ids, parts, files, n = TaskContext.get().partitionId(), [], [], [], 0

            def flush():
                nonlocal ids, parts, n
                i, m = np.concatenate(ids), np.concatenate(parts)
                by = np.lexsort((i, _pattern(m)))
                i, m = i[by], m[by]
                new = np.ones(len(i), bool)
                new[1:] = (i[1:] != i[:-1]) | (m[1:] != m[:-1]).any(axis=1)
                i, m = i[new], m[new]
                files.append(shared.put_file(folder, f"{'queries' if queries else 'shard'}-{pid:06d}-{len(files):06d}", pack(i, m, block)))
                ids, parts, n = [], [], 0

            for b in batches:
                keep, m = _integers(b.column(1), dims)
                own = b.column(0).to_numpy()[keep] if len(keep) else np.zeros(0, np.int64)
                for a in range(0, len(own), most):
                    room = most - n
                    for lo, hi in ((a, min(a + room, a + most, len(own))), (min(a + room, len(own)), min(a + most, len(own)))):
                        if hi > lo:
                            ids.append(own[lo:hi])
                            parts.append(m[lo:hi])
                            n += hi - lo
                        if n >= most:
                            flush()
            if n:
                flush()
            yield shared.batch_of(_FILES, {"queries": [queries] * len(files), "file": files})

        return run

    shards = max(1, -(-count // shard_rows))
    # exact repeats of a row meet in one partition and are dropped there
    spread = rows.repartition(shards, F.xxhash64("vec_id", "embedding"))
    query_rows = rows.filter(is_query)
    files = spread.mapInArrow(write(False, shard_rows * 2), "queries boolean, file string").unionByName(
        query_rows.repartition(max(1, min(shards, 1 + count // (100 * query_batch))), F.xxhash64("vec_id", "embedding")).mapInArrow(write(True, query_batch), "queries boolean, file string")
    )
    files = shared.staged(files, "vector-files")
    names = [r.file for r in files.filter("not queries").collect()]  # one name for each shard

    def run(batches):
        held: dict[str, tuple] = {}
        for b in batches:
            for file, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, _, query_ids, q, _ = unpack(shared.get_file(file))
                if names[s] not in held:
                    held = {names[s]: unpack(shared.get_file(names[s]))}
                out = search(query_ids, q, held[names[s]], k)
                yield shared.batch_of(_ROWS, dict(zip(_ROWS.names, zip(*out))) if out else {c: [] for c in _ROWS.names})

    # a task for each batch of queries and shard
    work = files.filter("queries").select("file", F.explode(F.sequence(F.lit(0), F.lit(max(0, len(names) - 1)))).alias("shard"))
    tasks = max(1, min(10_000, len(names) * max(1, count // (100 * query_batch) + 1)))
    out = work.repartition(tasks, "shard", "file").sortWithinPartitions("shard").mapInArrow(run, "query_id long, vec_id long, score long")
    ranked = out.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
