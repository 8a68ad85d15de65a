"""Language-model scores by context-tree weighting over bytes.

A text is its words (A-Z lower-cased) joined by blanks, then a line feed as its end. Each byte is eight
binary decisions down a tree of 255 nodes; at each node the Krichevsky-Trofimov estimates of all contexts
of 0 to ``DEPTH`` bytes before it are mixed with the weights of context-tree weighting. Block counts give
the same weights in any order of the training texts. The steps:

1. Tasks cut the texts into chunks. Each chunk is a file, and gives a row for each distinct (context, byte)
   and each distinct word: how often it stands in the chunk's training texts (0 if only in others).
2. Sums over the chunks are the counts; one row for each (context, byte) of the corpus, so a frequent one is
   no hot key from here on.
3. Upward, log Pw = log(1/2 Pe + 1/2 product of the children's Pw): contexts of 5 to 3 bytes in groups by the
   three nearest bytes, those of 2 from the groups' sums; contexts of 1 and 0 bytes (at most 256 x 255 nodes)
   on the driver.
4. Downward, each (context, node) gets the probabilities of a 0 and a 1 that hold where it is the deepest
   context seen, i.e. the mixture of its own and all shorter contexts' estimates. Contexts not seen in training
   end the tree (they add no estimate). Each (context, byte) of step 1 gets its log probability from them; one
   without any seen context costs one bit a decision.
5. These go back to the chunks by joins on the (context, byte) and the chunk, and each chunk is scored from its
   own rows alone: no task reads the whole model, at any size of it.

The base score is the add-half unigram over words from the same training texts; its counts go the same way.
The code length of a text in bits per byte is ``bits_per_byte``. A group by three bytes has at most 2**24 rows.

Cases: null and empty texts are their end alone; a null doc_id is held in training (its remainder is
unknown); repeated rows count and score each; a text of any length is counted block by block; without
training rows every decision costs one bit; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import shared
from .shingles import hashed_words

DEPTH = 5
BATCH_BYTES = 2_000_000
#: A chunk ends with so many bytes of text or distinct keys.
CHUNK_BYTES, CHUNK_KEYS = 64_000_000, 1_500_000
MERGE_ROWS = 1_000_000
#: Rows of the counts that the model's steps take at once, besides a whole group by three bytes.
GROUP_ROWS = 200_000
#: Parts by the third byte that a context of two bytes is dealt to.
SALTS = 8
END = 10
#: Keys: (context, byte) below TOKENS, words negative.
TOKENS, TEXTS = 1 << 48, (1 << 48) + 1
_WANTED = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64())])
_TOP = pa.schema([("key", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("pw", pa.float64())])
_MIXED = pa.schema([("key", pa.int64()), *((c, pa.float64()) for c in ("zero", "one", "done0", "done1", "rest"))])
_VALUES = pa.schema([("key", pa.int64()), ("value", pa.float64())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


class Texts:
    """The bytes of some texts, each with its end, one after another."""

    def __init__(self, texts: list[str]):
        pad = bytes([END]) * DEPTH
        raw = np.frombuffer(pad + b"".join(shared.folded(t).strip(b" ") + b"\n" + pad for t in texts), np.uint8)
        blank = raw == 32
        blank[:-1] &= blank[1:]  # of blanks in a row the last stays
        self.raw = raw[~blank]
        ends = np.flatnonzero(self.raw == END)  # DEPTH + 1 for each text, after the first pad
        self.ends = ends[DEPTH :: DEPTH + 1]
        self.starts = np.concatenate([[DEPTH], self.ends[:-1] + DEPTH + 1]) if len(texts) else np.zeros(0, np.int64)
        self.size = self.ends - self.starts + 1

    def keys(self, block: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, (context, byte)) of all texts' bytes in order, block by block; the nearest byte stands highest, the byte itself lowest."""
        for a in range(DEPTH, len(self.raw), block):
            x = self.raw[a - DEPTH : a + block].astype(np.int64)
            n = len(x) - DEPTH
            key = np.zeros(n, np.int64)
            for d in range(1, DEPTH + 1):
                key = key << 8 | x[DEPTH - d : DEPTH - d + n]
            key = key << 8 | x[DEPTH:]
            inside = np.ones(n, bool)  # not the padding behind each text
            i, j = np.searchsorted(self.ends, (a - DEPTH, a + n))
            pads = (self.ends[i:j, None] + np.arange(1, DEPTH + 1)).ravel() - a
            inside[pads[(pads >= 0) & (pads < n)]] = False
            yield np.flatnonzero(inside) + a, key[inside]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, text) of each word."""
        h, at = hashed_words(np.where(self.raw == END, np.uint8(32), self.raw))
        return (h | np.uint64(1 << 63)).view(np.int64), np.searchsorted(self.ends, at)


class _Sums:
    """Counts of keys, merged in numpy."""

    def __init__(self):
        self.keys, self.n, self.rows, self.merged = [], [], 0, 0

    def add(self, keys: np.ndarray, learn: bool) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.n.append(n if learn else np.zeros(len(k), np.int64))
        self.rows += len(k)
        if self.rows > self.merged + MERGE_ROWS:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            k, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(self.n), len(k)).astype(np.int64)
            self.keys, self.n = [k], [n]
        self.rows = self.merged = len(self.keys[0]) if self.keys else 0
        return (self.keys[0], self.n[0]) if self.keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def gathered(docs: DataFrame, folder: str) -> DataFrame:
    """(key, chunk, n) from ``docs`` (doc_id, text, learn); the chunks' texts lie in files of the folder."""

    def run(batches):
        base, part = TaskContext.get().taskAttemptId() << 20, 0  # an attempt's chunks are its own
        batches = shared.slices(batches, "text", BATCH_BYTES)
        batch = next(batches, None)
        while batch is not None:
            sums, size, n_tokens, n_texts = _Sums(), 0, 0, 0
            with shared.written(f"{folder}/{base + part}") as out, pa.ipc.new_stream(out, _DOCS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                while batch is not None and size < CHUNK_BYTES and sums.merged < CHUNK_KEYS:
                    file.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], schema=_DOCS))
                    texts, learn = shared.texts(batch.column("text")), batch.column("learn").to_pylist()
                    for flag in (True, False):
                        t = Texts([x for x, y in zip(texts, learn) if y == flag])
                        if len(t.ends):
                            for _, k in t.keys(1 << 20):
                                sums.add(k, flag)
                            w, _ = t.words()
                            sums.add(w, flag)
                            size += len(t.raw)
                            n_tokens += flag * (len(w) + len(t.ends))
                            n_texts += flag * len(t.ends)
                    batch = next(batches, None)
            keys, n = sums.merge()
            for a in range(0, len(keys), 100_000):
                k = keys[a : a + 100_000]
                yield shared.batch_of(_WANTED, {"key": k, "chunk": np.full(len(k), base + part), "n": n[a : a + 100_000]})
            yield shared.batch_of(_WANTED, {"key": [TOKENS, TEXTS], "chunk": [base + part] * 2, "n": [n_tokens, n_texts]})
            part += 1

    return shared.in_arrow(docs, run, "key long, chunk long, n long")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    below = np.zeros_like(x)
    for i in range(8):
        below += np.log(x + i)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - below


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a block with so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - 1.1447298858494002 - _log_gamma(zeros + ones + 1.0)


def _nodes(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From sorted (context, byte) counts: sorted (context, node), zeros, ones."""
    context, byte = key >> 8, key & 255
    all_keys, all_zero, all_one = [], [], []
    for bit in range(8):
        k = context << 8 | (1 << bit) | (byte >> (8 - bit))  # sorted as well
        first = np.flatnonzero(np.diff(k, prepend=-1))
        one = n * ((byte >> (7 - bit)) & 1)
        all_keys.append(k[first])
        if len(first):
            all_one.append(np.add.reduceat(one, first))
            all_zero.append(np.add.reduceat(n - one, first))
    k = np.concatenate(all_keys)
    if not len(k):
        return k, np.zeros(0), np.zeros(0)
    by = np.argsort(k, kind="stable")
    return k[by], np.concatenate(all_zero)[by].astype(float), np.concatenate(all_one)[by].astype(float)


def _parents(key: np.ndarray) -> np.ndarray:
    """(context, node) with the farthest byte left away."""
    return (key >> 16) << 8 | (key & 255)


class Level:
    """Nodes of one depth: keys, zeros, ones, log Pe, sum of the children's log Pw, log Pw."""

    def __init__(self, key, zero, one, child=None):
        self.key, self.zero, self.one = key, zero, one
        self.pe = log_kt(zero, one)
        self.child = child
        self.pw = self.pe if child is None else np.log(0.5) + np.logaddexp(self.pe, child)
        self.own = np.ones(len(key)) if child is None else 1 / (1 + np.exp(np.clip(child - self.pe, -700, 700)))

    def above(self) -> "Level":
        k, at = np.unique(_parents(self.key), return_inverse=True)
        return Level(k, np.bincount(at, self.zero, len(k)), np.bincount(at, self.one, len(k)), np.bincount(at, self.pw, len(k)))

    def below(self, done0: np.ndarray, done1: np.ndarray, rest: np.ndarray) -> "Mixed":
        """From the shorter contexts' mixture for each node: what they give a 0 and a 1, and the weight left."""
        kt0, kt1 = (self.zero + 0.5) / (self.zero + self.one + 1), (self.one + 0.5) / (self.zero + self.one + 1)
        part = rest * self.own
        return Mixed(self.key, done0 + rest * kt0, done1 + rest * kt1, done0 + part * kt0, done1 + part * kt1, rest * (1 - self.own))


class Mixed:
    """Nodes of one depth: probabilities of a 0 and a 1 where a node is the deepest seen; what the mixture of it and the shorter ones gives the next depth."""

    def __init__(self, key, zero, one, done0, done1, rest):
        self.key, self.zero, self.one, self.done0, self.done1, self.rest = key, zero, one, done0, done1, rest

    def rows(self) -> pa.RecordBatch:
        return shared.batch_of(_MIXED, {c: getattr(self, c) for c in _MIXED.names})

    def under(self, level: Level) -> "Mixed":
        """The next depth."""
        at = np.searchsorted(self.key, _parents(level.key))
        return level.below(self.done0[at], self.done1[at], self.rest[at])

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found)."""
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return at, self.key[at] == key if len(self.key) else np.zeros(len(key), bool)


def _levels(key: np.ndarray, n: np.ndarray) -> list[Level]:
    """Depths 5 to 3 of whole groups by three bytes."""
    seen = n > 0
    levels = [Level(*_nodes(key[seen], n[seen]))]
    for _ in range(DEPTH, 3, -1):
        levels.append(levels[-1].above())
    return levels


def _log_probability(key: np.ndarray, depths: list[Mixed]) -> np.ndarray:
    """log10 probability of each (context, byte) from the nodes of all depths, deepest first."""
    byte, context, out = key & 255, key >> 8, np.zeros(len(key))
    for bit in range(8):
        node, one = (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1
        p, left = np.full(len(key), 0.5), np.arange(len(key))
        for back, m in enumerate(depths):
            at, found = m.find((context[left] >> (8 * back)) << 8 | node[left])
            hit, at = left[found], at[found]
            p[hit] = np.where(one[hit] == 1, m.one[at], m.zero[at])
            left = left[~found]
            if not len(left):
                break
        out += np.log10(p)
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole groups by the three nearest bytes, GROUP_ROWS or more at once; the rows come sorted by near, kind and key."""
    held: list[pa.RecordBatch] = []
    rows, need = 0, GROUP_ROWS

    def columns():
        t = pa.Table.from_batches(held).combine_chunks()
        return {c: t.column(c).to_numpy() for c in t.column_names}

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows < need:
            continue
        t = columns()
        cut = int(np.searchsorted(t["group"], t["group"][-1]))  # the last group may go on
        if cut:
            yield {c: x[:cut] for c, x in t.items()}
            t = pa.Table.from_batches(held).slice(cut).combine_chunks()
            held, rows = t.to_batches(), t.num_rows
        need = max(GROUP_ROWS, 2 * rows)
    if held:
        yield columns()


def log_probabilities(counts: DataFrame) -> DataFrame:
    """(key, value): log10 probability of each (context, byte) of ``counts`` (key, n), learned from those with n > 0."""
    grams = counts.filter((F.col("key") >= 0) & (F.col("key") < TOKENS)).select("key", "n", F.shiftright("key", 24).alias("group"))

    def upward(batches):
        for t in _groups(batches):
            if (t["n"] > 0).any():
                two = _levels(t["key"], t["n"])[-1].above()  # this group's share of its contexts of two bytes
                yield shared.batch_of(_TOP, {"key": two.key, "a": two.zero, "b": two.one, "pw": two.child})

    sums = [F.sum(c).alias(c) for c in ("a", "b", "pw")]
    seen = grams.filter("n > 0").repartition("group").sortWithinPartitions("group", "key")
    two = shared.staged(shared.in_arrow(seen, upward, "key long, a double, b double, pw double").groupBy("key").agg(*sums), "lm-two")

    def level(b: pa.RecordBatch) -> Level:
        key = b.column("key").to_numpy()
        by = np.argsort(key)
        return Level(key[by], *(b.column(c).to_numpy()[by] for c in ("a", "b", "pw")))

    def top(batches):
        for b in batches:
            one = level(b).above()
            yield shared.batch_of(_TOP, {"key": one.key, "a": one.zero, "b": one.one, "pw": one.child})

    # 256 contexts times 255 nodes come to the driver at most
    parts = shared.in_arrow(two, top, "key long, a double, b double, pw double").groupBy("key").agg(*sums).toPandas().sort_values("key")
    one = Level(*(parts[c].to_numpy(t) for c, t in (("key", np.int64), ("a", float), ("b", float), ("pw", float))))
    root = one.above()
    mixed0 = root.below(np.zeros(len(root.key)), np.zeros(len(root.key)), np.ones(len(root.key)))
    mixed1 = mixed0.under(one)

    def downward(batches):
        for b in batches:
            yield mixed1.under(level(b)).rows()

    columns = [c for c in _MIXED.names if c != "key"]
    tops = shared.in_arrow(two, downward, ", ".join(f"{f.name} {'long' if f.name == 'key' else 'double'}" for f in _MIXED))
    # the group of a context of two bytes stands before those of three that end in it
    near = F.shiftright("key", 8).alias("near")
    tops = tops.select(near, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(-1).cast("long").alias("n"), "key", (F.shiftright("key", 8) * 256 - 1).alias("group"), *columns)
    third = (F.col("group") % SALTS).cast("int").alias("salt")
    rows = grams.select(F.shiftright("group", 8).alias("near"), third, "n", "key", "group", *(F.lit(None).cast("double").alias(c) for c in columns)).unionByName(tops)

    def answer(batches):
        tops: dict[str, np.ndarray] | None = None
        for t in _groups(batches):
            is_top = t["n"] < 0
            new = {c: t[c][is_top] for c in ("near", *_MIXED.names)}
            # a context's group may come in a later part than its top
            tops = new if tops is None else {c: np.concatenate([tops[c][tops["near"] >= t["near"][0]], x]) for c, x in new.items()}
            key, n = t["key"][~is_top], t["n"][~is_top]
            if not len(key):
                continue
            mixed = [Mixed(*(tops[c] for c in _MIXED.names))]
            for lv in reversed(_levels(key, n)):
                mixed.insert(0, mixed[0].under(lv))
            value = _log_probability(key, [*mixed, mixed1, mixed0])
            for a in range(0, len(key), 100_000):
                yield shared.batch_of(_VALUES, {"key": key[a : a + 100_000], "value": value[a : a + 100_000]})

    return shared.in_arrow(rows.repartition("near", "salt").sortWithinPartitions("group", "key"), answer, "key long, value double")


def _found(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of up to 2**16 (context, byte) keys in a sorted table that has them all."""
    packed = np.sort(keys.astype(np.uint64) << np.uint64(16) | np.arange(len(keys), dtype=np.uint64))
    sorted_keys, place = (packed >> np.uint64(16)).astype(np.int64), (packed & np.uint64(0xFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    out = np.empty(len(keys), np.int64)
    out[place] = np.repeat(np.searchsorted(table, sorted_keys[first]), np.diff(first, append=len(keys)))
    return out


def language_model_scores(docs: DataFrame, learn: F.Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of ``docs`` (doc_id, text).

    ``learn`` tells the training rows; those that the contract doesn't hold out, unless given.
    """
    spark = docs.sparkSession
    learn = ~held_out() if learn is None else learn
    folder = shared.new_folder(spark, "lm-chunks")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    wanted = shared.staged(gathered(rows, folder), "lm-wanted")
    counts = shared.staged(wanted.groupBy("key").agg(F.sum("n").alias("n")), "lm-counts")
    sums = counts.agg(*(F.sum(F.when(F.col("key") == k, F.col("n"))) for k in (TOKENS, TEXTS)), F.sum(((F.col("key") < 0) & (F.col("n") > 0)).cast("long"))).first()
    n_tokens, ends, words = (x or 0 for x in sums)
    total = np.log10(n_tokens + 0.5 * (words + (ends > 0) + 1))
    known = counts.filter("key < 0").select("key", F.col("n").cast("double").alias("value"))
    values = shared.staged(log_probabilities(counts).unionByName(known), "lm-values")

    def score(t: pa.Table) -> pa.Table:
        keys, values = t.column("key").to_numpy(), t.column("value").to_numpy()
        by = np.argsort(keys)
        keys, values = keys[by], values[by]
        grams = int(np.searchsorted(keys, 0))
        word_keys, word_counts = keys[:grams], values[:grams]
        keys, values = keys[grams:], values[grams:]
        out = []
        with shared.opened(f"{folder}/{t.column('chunk')[0].as_py()}") as f, pa.ipc.open_stream(f) as file:
            for b in file:
                texts = Texts(shared.texts(b.column("text")))
                k = len(texts.ends)
                score = np.zeros(k)
                for place, key in texts.keys():
                    if len(key):
                        i, j = np.searchsorted(texts.ends, (place[0], place[-1]))
                        cuts = np.searchsorted(place, np.maximum(texts.starts[i : j + 1], place[0]))
                        score[i : j + 1] += np.add.reduceat(values[_found(keys, key)], cuts)
                h, doc = texts.words()
                distinct, at = np.unique(h, return_inverse=True)
                c = word_counts[np.searchsorted(word_keys, distinct)]
                base = np.bincount(doc, (np.log10(c + 0.5) - total)[at], k) + np.log10(ends + 0.5) - total
                seen = np.bincount(doc, (c > 0)[at], k).astype(np.int64) + int(ends > 0)
                n = np.bincount(doc, minlength=k) + 1
                out.append(shared.batch_of(_SCORED, {"doc_id": b.column("doc_id"), "n_tokens": n, "n_known": seen, "base_score": base, "score": score, "bits_per_byte": -score / np.log10(2) / texts.size}))
        shared.release()
        return pa.Table.from_batches(out)

    rows = wanted.filter(F.col("key") < TOKENS).select("key", "chunk").join(values, "key")
    out = rows.groupBy("chunk").applyInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
