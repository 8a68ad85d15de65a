"""Packing of token ids into sequences: bounded-space online best fit.

Each partition keeps at most ``open_windows`` windows open. A document goes to the window whose
room is the smallest that holds it; when none has room and no further window may be opened, the
fullest is filled with the document's head, emitted, and the rest of the document goes on. What is
still open at a partition's end is merged in rounds of ``fan_in`` partitions until one is left; its
last window is cut at powers of two, so no sequence needs padding but for the final ids' tail.

Cases: null text is the empty text and packs as its end id; a null doc_id is kept; repeated rows are
packed each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import shared, tokens

SEQUENCE = 4096
OPEN_WINDOWS = 8
FAN_IN = 16
FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("group", pa.int64()), ("ids", pa.list_(pa.int32()))]
)
SCHEMA = FIELDS + ", group long, ids array<int>"


class Packer:
    """Windows of one partition; ``done`` holds rows of finished sequences."""

    def __init__(self, size: int, windows: int, first_id: int):
        self.size, self.windows, self.next_id = size, windows, first_id
        self.open: list[list] = []  # [room, pieces]
        self.done: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), tokens.crc(ids), total, self.next_id, at, None, None))
            at += len(ids)
        self.next_id += 1

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.size:
            self._emit([(doc, start, ids[: self.size], total)])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            n = len(ids)
            fit = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if fit is None and len(self.open) < self.windows:
                fit = [self.size, []]
                self.open.append(fit)
            if fit is None:  # the fullest takes the head and goes
                fit = min(self.open, key=lambda w: w[0])
            n = min(n, fit[0])
            fit[1].append((doc, start, ids[:n], total))
            fit[0] -= n
            start, ids = start + n, ids[n:]
            if not fit[0]:
                self.open.remove(fit)
                self._emit(fit[1])

    def finish(self) -> None:
        """Close what is open in sequences whose lengths are powers of two."""
        rest = [p for _, pieces in self.open for p in pieces]
        self.open = []
        left = sum(len(p[2]) for p in rest)
        while left:
            room = 1 << (min(left, self.size).bit_length() - 1)
            left -= room
            pieces = []
            while room:
                doc, start, ids, total = rest.pop(0)
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], total))
                    ids = ids[:room]
                pieces.append((doc, start, ids, total))
                room -= len(ids)
            self._emit(pieces)

    def rows(self, group: int, last: bool) -> list[tuple]:
        rows, self.done = self.done, []
        if last:
            rows += [(doc, start, len(ids), None, total, None, None, group, ids.tolist()) for _, pieces in self.open for doc, start, ids, total in pieces]
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _merger(size: int, windows: int, turn: int, final: bool):
    def merge(t: pa.Table) -> pa.Table:
        group = int(t.column("merge")[0].as_py())
        packer = Packer(size, windows, (turn << 56) + (group << 28))
        t = t.sort_by([("group", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        for doc, start, total, ids in zip(*(t.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
            packer.add(doc, start, np.array(ids, np.int32), total)
        if final:
            packer.finish()
        return pa.Table.from_batches([_batch(packer.rows(group, True))])

    return merge


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def first(batches):
        part = TaskContext.get().partitionId()
        packer, run = Packer(size, windows, part << 28), tokens.encoder(path)
        for b in shared.slices(batches, "text"):
            ids, n = run.encode(shared.texts(b.column("text")))
            ends = np.cumsum(n)
            for doc, end, k in zip(b.column("doc_id").to_pylist(), ends.tolist(), n.tolist()):
                packer.add(doc, 0, ids[end - k : end], k)
            yield _batch(packer.rows(part, False))
        yield _batch(packer.rows(part, True))

    done = []
    now = shared.staged(shared.in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), first, SCHEMA), "pack")
    turn = 0
    while True:
        done.append(now.filter("ids is null"))
        left = now.filter("ids is not null")
        parts = left.agg(F.max("group")).first()[0]
        if parts is None:
            break
        turn += 1
        now = shared.staged(left.withColumn("merge", F.floor(F.col("group") / fan_in)).groupBy("merge").applyInArrow(_merger(size, windows, turn, parts < fan_in), SCHEMA), "pack")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("group", "ids")
