"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may differ from a document's passage by ``budget(n)`` word edits (insertions,
deletions, substitutions). Cut into budget + 1 pieces, one piece at least stands unchanged in the
passage. Exact piece hits come from rolling word hashes; each is verified by Myers' bit-parallel
distance of the whole item against the words around it. Words are compared without case and without
marks that aren't letters or digits.

Items are taken in blocks of about ``BLOCK_CHARS`` characters, one after the other: a block's index is
broadcast, goes over all documents in a pass of its own whose findings are written, and is destroyed before
the next one is read. So memory is that of one block, and a larger benchmark costs more passes. Items of
equal words are looked for once.

An item of fewer than ``ERROR_SHARE`` words has no budget and matches where it stands word for word, a one-word item
wherever its word does: leave items out that are too short to tell anything.

Cases: null and empty texts and items never match; repeated items with one id count once; repeated
rows are reported each; empty tables give no row; other columns are ignored, or kept by ``clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import shared
from .shingles import _MIX, _finish

BLOCK_CHARS = 8_000_000
ERROR_SHARE = 5  # one edit for so many words
KEPT_WORDS = 250_000
FILTER_BITS = 22
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("item_words", pa.int32()), ("end_word", pa.int64())])
FOUND = "doc_id long, item_id long, distance int, item_words int, end_word long"


class _Keys(dict):
    """Hash of a word's letters and digits in lower case; 0 where it has none."""

    def __missing__(self, word: str) -> int:
        bare = "".join(c for c in word.lower() if c.isalnum())
        self[word] = h = (xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")) | 1) if bare else 0
        return h


def keys(text: str) -> np.ndarray:
    table = shared.kept("bare words", _Keys)
    if len(table) > KEPT_WORDS:
        table.clear()
    h = np.array(list(map(table.__getitem__, text.split())), np.uint64)
    return h[h != 0]


def budget(n_words: int) -> int:
    return n_words // ERROR_SHARE


def pieces(n_words: int) -> list[tuple[int, int]]:
    """budget + 1 ranges that cover the item, of nearly equal length."""
    k = budget(n_words) + 1
    cuts = [n_words * i // k for i in range(k + 1)]
    return list(zip(cuts, cuts[1:]))


def myers(pattern: list, text: list, most: int) -> tuple[int, int] | None:
    """(least distance of the pattern to a stretch of text, its first end), if it is at most ``most``."""
    m = len(pattern)
    masks: dict = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, None
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = vp & d0
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp = hp << 1 & full
        hn = hn << 1 & full
        vp = (hn | ~(d0 | hp)) & full
        vn = hp & d0
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Index:
    """Piece hashes of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        ids: dict[bytes, dict] = {}  # of items of equal words
        for i, t in items:
            w = keys(t or "")
            if len(w):
                ids.setdefault(w.tobytes(), {})[i] = None
        self.items = [(list(i), np.frombuffer(w, np.uint64)) for w, i in ids.items()]
        places: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, (_, w) in enumerate(self.items):
            for a, b in pieces(len(w)):
                h = int(_rolled(w[a:b], b - a)[0])
                places.setdefault(b - a, {}).setdefault(h, []).append((k, a))
        self.places = places
        self.sizes = sorted(places)
        self.filters = {}
        for n in self.sizes:
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[np.array(list(places[n]), np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
            self.filters[n] = bits

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Item to (distance, item's words, end), for the items that the text holds."""
        return {i: hit for k, hit in self._hits(text).items() for i in self.items[k][0]}

    def _hits(self, text: str) -> dict[int, tuple[int, int, int]]:
        words = keys(text)
        out: dict[int, tuple[int, int, int]] = {}
        if not self.sizes or len(words) < self.sizes[0]:
            return out
        tried, listed, x, done = set(), None, None, 0
        for n in self.sizes:
            if len(words) < n:
                break
            x, done = _rolled(words, n, x, done), n
            at = np.flatnonzero(self.filters[n][x >> np.uint64(64 - FILTER_BITS)])
            for p, h in zip(at.tolist(), x[at].tolist()):
                for k, a in self.places[n].get(h, ()):
                    pattern = self.items[k][1]
                    e, m = budget(len(pattern)), len(pattern)
                    if (k, p - a) in tried:
                        continue
                    tried.add((k, p - a))
                    if listed is None:
                        listed = words.tolist()
                    first = max(0, p - a - e)
                    hit = myers(pattern.tolist(), listed[first : p - a + m + e], e)
                    if hit and (k not in out or hit[0] < out[k][0]):
                        out[k] = (hit[0], m, first + hit[1])
        return out


def _rolled(words: np.ndarray, n: int, x: np.ndarray | None = None, done: int = 0) -> np.ndarray:
    """Hashes of all stretches of n words, built on those of ``done`` words."""
    count = len(words) - n + 1
    x = np.full(count, 7, np.uint64) if x is None else x[:count]
    for i in range(done, n):
        x = _finish(x ^ (words[i : i + count] * np.uint64(_MIX[i % len(_MIX)])))
    return x


def _blocks(benchmark: DataFrame, block_chars: int) -> list[DataFrame]:
    """The items (item_id, text) in blocks; equal texts are in one."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    return [rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else rows for k in range(n)]


def _index(block: DataFrame):
    return block.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in block.collect()]))


def _passes(blocks: list[DataFrame], search):
    """``search`` with each block's index; of several blocks each result is written before the next index is made."""
    if len(blocks) == 1:
        return search(_index(blocks[0]))
    out = None
    for block in blocks:
        index = _index(block)
        part = shared.staged(search(index), "contaminated")
        index.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item it holds: doc_id, item_id, distance, item_words, end_word."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))

    def search(index):
        def run(batches):
            for b in shared.slices(batches, "text"):
                rows = []
                for doc, t in zip(b.column("doc_id").to_pylist(), shared.texts(b.column("text"))):
                    rows += [(doc, item, *hit) for item, hit in index.value.find(t).items()]
                yield shared.batch_of(_FOUND, dict(zip(_FOUND.names, zip(*rows))) if rows else {c: [] for c in _FOUND.names})

        return shared.in_arrow(docs, run, FOUND)

    return _passes(_blocks(benchmark, block_chars), search)


def clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item, whole rows. One block filters them on the way; of several each names the hashes of the texts that go."""
    blocks = _blocks(benchmark, block_chars)
    if len(blocks) == 1:
        index = _index(blocks[0])

        def keep(batches):
            for b in shared.slices(batches, "text"):
                yield b.filter(pa.array([not index.value.find(t) for t in shared.texts(b.column("text"))], pa.bool_()))

        return shared.in_arrow(docs, keep, docs.schema)
    digest = F.sha2(docs["text"].cast("string").cast("binary"), 256).alias("digest")

    def search(index):
        def run(batches):
            for b in shared.slices(batches, "text"):
                hit = [bool(index.value.find(t)) for t in shared.texts(b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("digest").filter(pa.array(hit, pa.bool_()))], names=["digest"])

        return shared.in_arrow(docs.select(digest, docs["text"].cast("string").alias("text")), run, "digest string").distinct()

    found = shared.staged(_passes(blocks, search).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), digest)
    return rows.join(found, "digest", "left_anti").select("row.*")
