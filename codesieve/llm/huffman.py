"""Token-id files: canonical length-limited Huffman code, independent blocks, bit-offset checkpoints.

File (little-endian): magic ``IDH1``; u64 documents, u64 ids, u64 blocks, u64 first id's index in the
corpus part (0: within the file); per block u64 byte position, u32 ids, u32 checkpoints; then the
blocks, then the documents' (i64 doc_id, u8 known, u64 ids) columns. A block holds ``BLOCK`` ids (the
last fewer): u32 bit offsets of every ``STRIDE``-th id, then the codes from the high bit on. All files
of a set share ``codebook.bin``: one u8 code length for each id. Codes are canonical: by length, then id.

Decoding is by one table of 2**LIMIT entries and runs over all checkpoints of a block at once: in each
of STRIDE steps every lane reads LIMIT bits, looks up id and length, and moves on.

Cases: null text is the empty text and has its end id alone; a null doc_id sorts first and is kept;
repeated rows keep one entry each; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import shared, tokens

LIMIT = 16
BLOCK = 1 << 16
STRIDE = 64
#: Ids after which a task begins its next file.
FILE_IDS = 1 << 23
MAGIC = b"IDH1"
_IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
_FILES = pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); ids that don't occur get 0."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(ids) < 2:
        out[ids] = 1
        return out
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids need codes of more than {limit} bits")
    order = ids[np.argsort(counts[ids], kind="stable")]
    weight = counts[order].astype(np.float64)
    n, kept, row = len(order), [], weight
    for _ in range(limit - 1):  # packages of the level below among the single ids
        m = len(row) // 2
        packages = row[0 : 2 * m : 2] + row[1 : 2 * m : 2]
        merged = np.concatenate([weight, packages])
        by = np.argsort(merged, kind="stable")
        kept.append(by >= n)  # which of the merged row's items are packages
        row = merged[by]
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for packed in reversed(kept):
        chosen = packed[:take]
        single = take - int(chosen.sum())
        lengths[:single] += 1
        take = 2 * int(chosen.sum())
    lengths[:take] += 1
    out[order] = lengths
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then id."""
    out = np.zeros(len(lengths), np.uint32)
    ids = np.flatnonzero(lengths)
    order = ids[np.lexsort((ids, lengths[ids]))]
    code, last = 0, 0
    starts = {}
    for n in range(1, LIMIT + 1):
        k = int((lengths[order] == n).sum())
        code <<= n - last
        last = n
        starts[n] = code
        code += k
    for n, first in starts.items():
        mine = order[lengths[order] == n]
        out[mine] = first + np.arange(len(mine), dtype=np.uint32)
    return out


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for each LIMIT bits."""
    ids = np.flatnonzero(lengths)
    order = ids[np.lexsort((ids, lengths[ids]))]
    span = (1 << (LIMIT - lengths[order].astype(np.int64))).astype(np.int64)
    sym, n = np.zeros(1 << LIMIT, np.int32), np.ones(1 << LIMIT, np.uint8)
    total = int(span.sum())
    sym[:total] = np.repeat(order, span)
    n[:total] = np.repeat(lengths[order], span)
    return sym, n


def encode_block(ids: np.ndarray, code: np.ndarray, lengths: np.ndarray) -> bytes:
    n = lengths[ids].astype(np.int64)
    at = np.cumsum(n) - n
    value = code[ids].astype(np.int64) << (24 - (at & 7) - n)  # a code lies in three bytes at most
    first = at >> 3
    out = np.zeros((int(n.sum()) + 7 >> 3) + 3, np.uint8)
    starts = np.flatnonzero(np.diff(first, prepend=-1))
    whole = np.bitwise_or.reduceat(value, starts)
    places = first[starts]
    for k in range(3):  # places are distinct, so each of the three writes hits a byte once
        out[places + k] |= (whole >> (16 - 8 * k) & 255).astype(np.uint8)
    return at[::STRIDE].astype("<u4").tobytes() + out.tobytes()


def decode_block(data: memoryview, count: int, sym: np.ndarray, lengths: np.ndarray, lanes: tuple[int, int] | None = None) -> np.ndarray:
    """Ids of a block, or of its checkpoints from lanes[0] on up to lanes[1]."""
    k = -(-count // STRIDE)
    at = np.frombuffer(data, "<u4", k).astype(np.int64)
    bits = np.frombuffer(data, np.uint8, offset=4 * k)
    lo, hi = lanes or (0, k)
    at = at[lo:hi]
    out = np.zeros((STRIDE, len(at)), np.int32)
    size = np.full(len(at), STRIDE)
    if hi == k and len(at):
        size[-1] = count - STRIDE * (k - 1)
    last = len(bits) - 3
    for i in range(STRIDE):
        b = np.minimum(at >> 3, last)
        word = (bits[b].astype(np.int64) << 16) | (bits[b + 1].astype(np.int64) << 8) | bits[b + 2]
        peek = word >> (8 - (at & 7)) & 0xFFFF
        out[i] = sym[peek]
        at = at + lengths[peek]
    return out.T[np.arange(STRIDE)[None, :] < size[:, None]]


def file_bytes(doc_ids: list, counts: np.ndarray, ids: np.ndarray, code: np.ndarray, lengths: np.ndarray) -> bytes:
    blocks = [encode_block(ids[a : a + BLOCK], code, lengths) for a in range(0, len(ids), BLOCK)]
    head = struct.pack("<4sQQQ", MAGIC, len(doc_ids), len(ids), len(blocks))
    at, index = len(head) + 16 * len(blocks), b""
    for a, b in zip(range(0, len(ids), BLOCK), blocks):
        n = min(BLOCK, len(ids) - a)
        index += struct.pack("<QII", at, n, -(-n // STRIDE))
        at += len(b)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + counts.astype("<u8").tobytes()
    return head + index + b"".join(blocks) + docs


class IdFile:
    """Reader of one file; ``ids(a, b)`` decodes only the blocks and checkpoints that it needs."""

    def __init__(self, data: bytes, lengths: np.ndarray):
        magic, self.n_docs, self.n_ids, k = struct.unpack_from("<4sQQQ", data)
        if magic != MAGIC:
            raise ValueError("not an id file")
        self.data = memoryview(data)
        self.index = [struct.unpack_from("<QII", data, 28 + 16 * i) for i in range(k)]
        self.sym, self.len = decode_table(lengths)
        at = len(data) - 17 * self.n_docs
        self.ends = [p for p, _, _ in self.index[1:]] + [at]
        ids = np.frombuffer(data, "<i8", self.n_docs, at).tolist()
        known = np.frombuffer(data, np.uint8, self.n_docs, at + 8 * self.n_docs)
        self.doc_ids = [d if k else None for d, k in zip(ids, known.tolist())]
        self.counts = np.frombuffer(data, "<u8", self.n_docs, at + 9 * self.n_docs).astype(np.int64)

    def block(self, i: int, lanes: tuple[int, int] | None = None) -> np.ndarray:
        at, n, _ = self.index[i]
        return decode_block(self.data[at : self.ends[i]], n, self.sym, self.len, lanes)

    def ids(self, a: int, b: int) -> np.ndarray:
        out = []
        for i in range(a // BLOCK, -(-b // BLOCK) if b > a else 0):
            lo, hi = max(a - i * BLOCK, 0), min(b - i * BLOCK, self.index[i][1])
            first = lo // STRIDE
            part = self.block(i, (first, -(-hi // STRIDE)))
            out.append(part[lo - first * STRIDE : hi - first * STRIDE])
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def write(docs: DataFrame, folder: str | None = None, path: str | None = None) -> tuple[DataFrame, str]:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into files under a shared folder.

    Returns the manifest (part, file, n_docs, n_ids) and the folder. Ids are cut once and staged; the
    global counts come with them as one vector of the vocabulary's size from each task.
    """
    spark = docs.sparkSession
    folder = folder or shared.new_folder(spark, "ids")

    def cut(batches):
        run = tokens.encoder(path)
        size = run.tokenizer.get_vocab_size()
        counts = np.zeros(size, np.int64)
        for b in shared.slices(batches, "text"):
            ids, n = run.encode(shared.texts(b.column("text")))
            counts += np.bincount(ids, minlength=size)
            raw, ends = ids.astype("<u2" if size <= 1 << 16 else "<u4"), np.cumsum(n)
            each = [raw[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist())]
            yield shared.batch_of(_IDS, {"doc_id": b.column("doc_id"), "n_tokens": n, "ids": each, "counts": [None] * len(each)})
        yield shared.batch_of(_IDS, {"doc_id": [None], "n_tokens": [-1], "ids": [None], "counts": [counts.astype("<i8").tobytes()]})

    def summed(batches):
        total = None
        for b in batches:
            for c in b.column("counts").to_pylist():
                c = np.frombuffer(c, "<i8")
                total = c.copy() if total is None else total + c
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    cut_ids = shared.staged(shared.in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), cut, "doc_id long, n_tokens long, ids binary, counts binary"), "ids")
    vectors = cut_ids.filter("n_tokens < 0").select("counts")
    # at most one row for each id of the vocabulary comes to the driver
    rows = vectors.mapInArrow(summed, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows.id.max()) + 1 if len(rows) else 1, np.int64)
    counts[rows.id.to_numpy()] = rows.n.to_numpy()
    lengths = code_lengths(counts)
    shared.put_file(folder, "codebook.bin", lengths.tobytes())
    code = codes(lengths)
    width = "<u2" if len(counts) <= 1 << 16 else "<u4"

    def encode(batches):
        part, doc_ids, n, parts, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def roll():
            nonlocal part, held
            ids = np.concatenate(parts)
            file = shared.put_file(folder, f"part-{part >> 32:06d}-{part & 0xFFFFFFFF:05d}.ids", file_bytes(doc_ids, np.array(n, np.int64), ids, code, lengths))
            out = shared.batch_of(_FILES, {"part": [part], "file": [file], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]})
            for x in (doc_ids, n, parts):
                x.clear()
            part, held = part + 1, 0
            return out

        for b in batches:
            for doc, k, x in zip(b.column("doc_id").to_pylist(), b.column("n_tokens").to_pylist(), b.column("ids")):
                doc_ids.append(doc)
                n.append(k)
                parts.append(np.frombuffer(x.as_buffer(), width))
                held += k
                if held >= FILE_IDS:
                    yield roll()
        if doc_ids:
            yield roll()

    ordered = cut_ids.filter("n_tokens >= 0").drop("counts").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("ids"))
    return shared.staged(shared.in_arrow(ordered, encode, "part long, file string, n_docs long, n_ids long"), "files"), folder


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files; files are decoded each on its own."""
    # the window runs over one row for each file
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = None

    def decode(batches):
        nonlocal lengths
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                if lengths is None:
                    lengths = np.frombuffer(shared.get_file(f"{folder}/codebook.bin"), np.uint8)
                f = IdFile(shared.get_file(file), lengths)
                ends, crcs = np.cumsum(f.counts), []
                held, first, k = np.zeros(0, np.int32), 0, 0
                for e, c in zip(ends.tolist(), f.counts.tolist()):
                    while first + len(held) < e:
                        held, k = np.concatenate([held, f.block(k)]), k + 1
                    crcs.append(tokens.crc(held[e - c - first : e - first]))
                    if e - first > 4 * BLOCK:
                        held, first = held[e - first :], e
                yield shared.batch_of(_OUT, {"doc_id": f.doc_ids, "start": start + ends - f.counts, "n_tokens": f.counts, "ids_crc32": crcs})

    based = manifest.withColumn("base", base).select("part", "file", "base")
    files = manifest.agg(F.count(F.lit(1))).first()[0]
    spread = based.repartition(max(1, min(files, 10_000)), "part")
    return shared.in_arrow(spread, decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
