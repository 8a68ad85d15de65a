"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Each text becomes the set of its distinct word shingles, a digest of the set and ``TREES * DEPTH``
   minima. Equal sets meet in one partial aggregate and are one node from then on.
2. Each tree sorts the nodes by its own ``DEPTH`` minima. Candidates are the nearest predecessors whose
   common prefix reaches ``LEAST_PREFIX``, ``NEIGHBOURS`` of them at most: where many nodes share a
   short prefix, the nearest ones share a longer one, so the depth adapts to the region.
3. Candidates whose signatures agree on less than ``least_estimate`` go, which is ``DEVIATIONS`` standard
   deviations below the threshold.
4. Links are confirmed on the full sets. Each node's best candidate comes first; what lies within one
   component then needs no further check, and the rest is checked in a last turn.
5. Buckets (one tree, one prefix of ``LEAST_PREFIX``) of more nodes than the neighbours reach, and of
   several components, are compared whole: each node outside the bucket's largest component with each
   node of another component, block by block, in the first of the trees whose bucket both share. A block
   that has pairs which may link gets their texts and confirms them, best first, until each pair is
   confirmed, refuted or within one component; only links leave it. This costs the product of the nodes
   outside and the bucket.

A node is a set of shingles, whatever ids have it; its text is that of its smallest (doc_id, text hash).

Cases: null and empty texts have an empty set and link with nothing; rows that repeat a doc_id with another
text are documents of their own, each judged by its own text; exact repeats of a row are one document (of
``one_of_each`` one row of them stays); a null doc_id links with nothing and is kept; an empty table gives
no row; other columns are ignored, or kept by ``one_of_each``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import shared
from .components import components
from .shingles import common, shingle_set

TREES, DEPTH = 16, 8
LEAST_PREFIX = 4
NEIGHBOURS = 4
DEVIATIONS = 5
#: Rows and shingles of each side of a comparison within a crowded bucket.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Keys of candidate documents are broadcast up to this count (24 MB), beyond it the texts are shuffled.
MOST_BROADCAST = 1_000_000
_RNG = np.random.default_rng(20_240_601)
_A = _RNG.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_SIGNED = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])
_TREE = pa.schema([("tree", pa.int32()), ("key", pa.binary()), ("node", pa.int64())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_MEMBERS = pa.schema([("bucket", pa.int64()), ("tree", pa.int32()), ("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64())])


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the hash functions over a set, which isn't empty."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        h = np.multiply.outer(_A, x[at : at + 2048])
        h += _B[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, digest and signature (both null for the empty set)."""

    def run(batches):
        for b in shared.slices(batches, "text"):
            n, digest, sig = [], [], []
            for text in shared.texts(b.column("text")):
                s = shingle_set(text, size)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).astype(">u4").tobytes() if len(s) else None)
            yield shared.batch_of(_SIGNED, {"doc_id": b.column("doc_id"), "t": b.column("t"), "n_shingles": n, "digest": digest, "signature": sig})

    return shared.in_arrow(docs.select("doc_id", "t", "text"), run, "doc_id long, t long, n_shingles long, digest binary, signature binary")


def _branches(batches):
    """A row for each tree and node."""
    for b in batches:
        nodes = b.column(0).to_numpy()
        sigs = b.column(1).to_pylist()
        width = 4 * DEPTH
        for t in range(TREES):
            yield shared.batch_of(_TREE, {"tree": np.full(len(nodes), t, np.int32), "key": [s[t * width : (t + 1) * width] for s in sigs], "node": nodes})


def _neighbours(batches):
    """Pairs of near neighbours in sorted order; the last rows of a batch go before the next."""
    tree, key, node = np.zeros(0, np.int64), np.zeros((0, DEPTH), np.uint32), np.zeros(0, np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        tree = np.concatenate([tree, b.column(0).to_numpy().astype(np.int64)])
        key = np.concatenate([key, np.frombuffer(b"".join(b.column(1).to_pylist()), ">u4").reshape(-1, DEPTH)])
        node = np.concatenate([node, b.column(2).to_numpy()])
        new = len(node) - b.num_rows
        out = []
        for k in range(1, NEIGHBOURS + 1):
            at = np.arange(max(new, k), len(node))
            same = (key[at, :LEAST_PREFIX] == key[at - k, :LEAST_PREFIX]).all(axis=1) & (tree[at] == tree[at - k])
            out.append(np.stack([node[at[same]], node[at[same] - k]]))
        pairs = np.concatenate(out, axis=1)
        pairs = np.unique(np.sort(pairs, axis=0), axis=1)
        yield shared.batch_of(_PAIRS, {"a": pairs[0], "b": pairs[1]})
        tree, key, node = tree[-NEIGHBOURS:], key[-NEIGHBOURS:], node[-NEIGHBOURS:]


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b, from ``nodes`` (node, signature)."""
    rows = shared.in_arrow(nodes.select("node", "signature"), _branches, "tree int, key binary, node long")
    ordered = rows.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    return shared.in_arrow(ordered, _neighbours, "a long, b long").filter("a <> b").distinct()


def least_estimate(percent: int) -> float:
    """The share of equal minima below which a pair can't be expected to reach the threshold."""
    p = percent / 100
    return p - DEVIATIONS * (p * (1 - p) / (TREES * DEPTH)) ** 0.5


def _estimated(least: float):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), ">u4").reshape(b.num_rows, -1) for c in ("sa", "sb"))
            same = (x == y).mean(axis=1)
            keep = same >= least
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep)), pa.array(same[keep])], names=["a", "b", "estimate"])

    return run


def _members(batches):
    """A row for each tree and node; nodes with one prefix in a tree have one bucket."""
    for b in batches:
        sigs = b.column("signature").to_pylist()
        for t in range(TREES):
            at = 4 * DEPTH * t
            bucket = np.array([xxhash.xxh3_64_intdigest(s[at : at + 4 * LEAST_PREFIX], t) for s in sigs], np.uint64).view(np.int64)
            yield shared.batch_of(_MEMBERS, {"bucket": bucket, "tree": np.full(len(sigs), t, np.int32), "node": b.column("node"), "root": b.column("root"), "n": b.column("n")})


def _pairs(t: pa.Table, least: float, percent: int):
    """(place of a node outside the largest component, places of nodes of other components, their estimates) of a block.

    Pairs that may link and have no common prefix in an earlier tree, where they are compared as well if need be.
    """
    sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), "<u4").reshape(t.num_rows, -1)
    node, root, main, outside, n = (t.column(c).to_numpy() for c in ("node", "root", "main", "outside", "n"))
    tree, rows = t.column("tree")[0].as_py(), np.flatnonzero(~outside)
    others, ids, roots, sizes = sig[rows], node[rows], root[rows], n[rows]
    in_main = roots == main[rows]
    for i in np.flatnonzero(outside):
        # two nodes outside meet twice; sets of unlike sizes can't be alike
        ok = (roots != root[i]) & (in_main | (ids < node[i])) & (100 * np.minimum(sizes, n[i]) >= percent * np.maximum(sizes, n[i]))
        at = np.flatnonzero(ok)
        equal = others[at] == sig[i]
        same = equal.mean(axis=1)
        likely = same >= least
        at, same = at[likely], same[likely]
        earlier = equal[likely].reshape(-1, TREES, DEPTH)[:, :tree, :LEAST_PREFIX].all(axis=2).any(axis=1)
        if not earlier.all():
            yield i, rows[at[~earlier]], same[~earlier]


def _compared(least: float, percent: int):
    """The rows of a block that have a pair."""

    def run(t: pa.Table) -> pa.Table:
        keep = np.zeros(t.num_rows, bool)
        for i, at, _ in _pairs(t, least, percent):
            keep[i] = True
            keep[at] = True
        return t.filter(pa.array(keep))

    return run


def _linked(least: float, size: int, percent: int):
    """Links within a block, the likeliest pairs first; what they have joined already needs no more."""

    def run(t: pa.Table) -> pa.Table:
        texts, held = t.column("text"), {}
        node, root = (t.column(c).to_pylist() for c in ("node", "root"))
        up: dict[int, int] = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def of(i):
            if i not in held:
                held[i] = shingle_set(texts[i].as_py() or "", size)
            return held[i]

        found = [(np.full(len(at), i), at, same) for i, at, same in _pairs(t, least, percent)]
        x, y, same = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else ((), (), ())))
        a, b = [], []
        for k in np.argsort(-same, kind="stable").tolist():
            i, j = int(x[k]), int(y[k])
            p, q = find(root[i]), find(root[j])
            if p == q:
                continue
            n = common(of(i), of(j))
            if 100 * n >= percent * (len(of(i)) + len(of(j)) - n):
                up[max(p, q)] = min(p, q)
                a.append(node[i])
                b.append(node[j])
        shared.release()
        return pa.Table.from_batches([shared.batch_of(_PAIRS, {"a": a, "b": b})])

    return run


def crowded(nodes: DataFrame, roots: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of nodes (node, doc_id, t, signature, n) of different components that share a bucket which neighbours don't exhaust."""
    least = least_estimate(percent)
    placed = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "signature", "n")
    members = shared.staged(shared.in_arrow(placed, _members, "bucket long, tree int, node long, root long, n long"), "members")
    by_root = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    largest = by_root.groupBy("bucket").agg(F.max(F.struct("k", "root", "s")).alias("x"), F.sum("k").alias("n"), F.sum("s").alias("s")).filter((F.col("n") > NEIGHBOURS + 1) & (F.col("n") > F.col("x.k")))

    def cut(rows, shingles):
        return F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES))

    blocks = largest.select("bucket", F.col("x.root").alias("main"), cut(F.col("n") - F.col("x.k"), F.col("s") - F.col("x.s")).alias("rows"), cut(F.col("n"), F.col("s")).alias("columns"))
    crowd = shared.staged(members.join(shared.staged(blocks, "crowded"), "bucket"), "crowd")
    spread = F.xxhash64("node")
    outside = crowd.filter("root <> main").withColumn("i", F.pmod(spread, "rows")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).withColumn("outside", F.lit(True))
    inside = crowd.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("j", F.pmod(spread, "columns")).withColumn("outside", F.lit(False))
    columns = ["bucket", "tree", "i", "j", "node", "root", "main", "outside", "n"]
    both = outside.select(columns).unionByName(inside.select(columns)).join(nodes.select("node", "signature"), "node").select(*columns, "signature")
    likely = shared.staged(both.groupBy("bucket", "i", "j").applyInArrow(_compared(least, percent), both.schema), "likely")
    if likely.isEmpty():
        return likely.select(F.col("node").alias("a"), F.col("node").alias("b"))
    texts = _texts_of(docs, nodes, likely.select("node"))
    return likely.join(texts, "node").groupBy("bucket", "i", "j").applyInArrow(_linked(least, size, percent), "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet 100 * intersection >= percent * union."""

    def run(batches):
        last: dict[tuple, np.ndarray] = {}
        for batch in shared.slices(batches, ("ta", "tb")):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i, j, x, y in zip(a, b, shared.texts(batch.column("ta")), shared.texts(batch.column("tb"))):
                if len(last) > 16:
                    last.clear()
                sets = []
                for k in ((i, x), (j, y)):
                    if k not in last:
                        last[k] = shingle_set(k[1], size)
                    sets.append(last[k])
                n = common(*sets)
                keep.append(100 * n >= percent * (len(sets[0]) + len(sets[1]) - n))
            yield shared.batch_of(_PAIRS, {"a": [x for x, k in zip(a, keep) if k], "b": [x for x, k in zip(b, keep) if k]})

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return shared.in_arrow(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb"), run, "a long, b long")


def _texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the nodes ``wanted``; ``docs`` has doc_id, t, text."""
    need = nodes.select("node", "doc_id", "t").join(wanted.distinct(), "node")
    return shared.staged(_among(docs, shared.staged(need, "need"), "inner").select("node", "text").dropDuplicates(["node"]), "texts")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``pairs`` whose nodes lie in different components ra and rb."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
    return pairs.filter("ra <> rb")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links."""
    return roots if links.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def _keyed_columns(docs: DataFrame) -> tuple:
    """doc_id as a whole number and ``t``, the hash of the text."""
    return docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("t")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*_keyed_columns(docs), docs["text"].cast("string").alias("text"))


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, t, n_shingles, component_id, first (whether (doc_id, t) is its component's smallest) for every row of ``docs``."""
    docs = _keyed(docs)
    all_rows = shared.staged(signed(docs, size), "signed")
    grouped = all_rows.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "t", "signature", "n_shingles")).alias("x"))
    nodes = shared.staged(grouped.select("digest", F.xxhash64("digest").alias("node"), F.col("x.doc_id").alias("doc_id"), F.col("x.t").alias("t"), F.col("x.signature").alias("signature"), F.col("x.n_shingles").alias("n")), "nodes")
    pairs, least = candidates(nodes), least_estimate(percent)
    sig = nodes.select("node", "signature")
    both = pairs.join(sig.withColumnsRenamed({"node": "a", "signature": "sa"}), "a").join(sig.withColumnsRenamed({"node": "b", "signature": "sb"}), "b").select("a", "b", "sa", "sb")
    likely = shared.staged(shared.in_arrow(both, _estimated(least), "a long, b long, estimate double").groupBy("a", "b").agg(F.max("estimate").alias("estimate")), "likely")

    texts = _texts_of(docs, nodes, likely.select(F.explode(F.array("a", "b")).alias("node")))
    best = F.max(F.struct("estimate", "b")).alias("x"), F.max(F.struct("estimate", "a")).alias("x")
    first = likely.groupBy("a").agg(best[0]).select("a", F.col("x.b").alias("b")).unionByName(likely.groupBy("b").agg(best[1]).select(F.col("x.a").alias("a"), "b")).distinct()
    links = shared.staged(confirmed(first, texts, size, percent).distinct(), "links")
    roots = components(links)
    rest = likely.select("a", "b").join(first, ["a", "b"], "left_anti")
    rest = shared.staged(_apart(rest, roots).select("a", "b"), "rest")
    if not rest.isEmpty():
        roots = _joined(roots, shared.staged(confirmed(rest, texts, size, percent).distinct(), "links"))

    roots = _joined(roots, shared.staged(crowded(nodes.drop("digest"), roots, docs, size, percent), "links"))

    placed = shared.staged(nodes.select("digest", "node", "doc_id", "t").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), "doc_id", "t"), "placed")
    least = placed.groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("least"))
    named = placed.select("digest", "root").join(least, "root").select("digest", "least")
    out = all_rows.select("doc_id", "t", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id"))
    first = F.col("least").isNull() | F.col("doc_id").isNull() | (F.struct("doc_id", "t") == F.col("least"))
    return out.select("doc_id", "t", "n_shingles", component.alias("component_id"), first.alias("first"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    out = _grouped(docs, size, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _among(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` joined with keys (doc_id, t), which are broadcast up to a checked count."""
    small = keys.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return docs.join(F.broadcast(keys) if small else keys, ["doc_id", "t"], how)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row of the smallest doc_id (and hash of the text) stays, once.

    A row goes for its own text alone; rows without words and rows without a doc_id stay.
    """
    found = shared.staged(_grouped(docs, size, percent), "near")
    # columns of their own beside all that the rows have
    rows = docs.select(F.struct("*").alias("row"), *_keyed_columns(docs))
    out = _among(rows, shared.staged(found.filter(~F.col("first")).select("doc_id", "t").distinct(), "dropped"), "left_anti")
    repeated = shared.staged(found.filter("first and doc_id is not null").groupBy("doc_id", "t").count().filter("count > 1").select("doc_id", "t"), "repeated")
    if not repeated.isEmpty():
        again = _among(out, repeated, "left_semi").dropDuplicates(["doc_id", "t"])
        out = _among(out, repeated, "left_anti").select("row").unionByName(again.select("row"))
    return out.select("row.*")
