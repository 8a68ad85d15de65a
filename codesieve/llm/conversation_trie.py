"""Prefix trie of conversations: nodes shared by conversations that begin alike.

1. Turns become digests of (role, text) and word counts before anything moves. A conversation is one row: a
   path of ``WIDTH`` characters for each turn, and the counts. ``rebuilt`` gives it another conversation's
   head. Equal paths meet in a partial aggregate and are one weighted path from then on; the ids that end at
   a path are sorted by a range shuffle and hashed piece by piece, so no list of them is ever whole.
2. Paths are dealt out by the hash of their first turn, many first turns to a bucket of about ``BUCKET``
   turns, and each bucket builds a trie of dictionaries whose totals come from an iterative postorder.
3. A first turn whose paths have more than ``MOST_TURNS`` turns is oversized: its node (with the chain of
   nodes below it that all its paths share) is made from aggregates, and the paths are dealt out anew by the
   turn behind it, again and again until every part fits. Totals of such nodes are sums over the parts.

A task holds one bucket: paths of about ``BUCKET`` + ``MOST_TURNS`` turns, and one conversation's digests (about 60
bytes a turn) where a single conversation is longer than that.

Cases: null role or text is empty; a null turn comes first; rows of one conversation and turn are in the order
of role, then of the digest; rows with a null conv_id belong to no conversation; a conversation without
turns is a member of the root alone; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared

WIDTH = 32
BUCKET, MOST_TURNS = 100_000, 200_000
PIECE_IDS = 20_000
_PIECES = pa.schema([("seq", pa.int64()), ("at", pa.int64()), ("ids", pa.binary())])
_HASHED = pa.schema([("seq", pa.int64()), ("ends", pa.string())])
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, under string"
NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, digests (array of text), counts (array of int) in order, from ``turns`` (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(shared.WORD_PATTERN)).cast("int")
    # the sort of structs puts null turns first
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), words.alias("n")).alias("x"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return own.select("conv_id", F.col("x.digest").alias("digests"), F.col("x.n").alias("counts"))


def rebuilt(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The sequences with the first h turns of conversation c - c % every in place of c's first h; h is crc32(c) % most."""
    heads = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("digests", 1, most - 1).alias("hd"), F.slice("counts", 1, most - 1).alias("hc"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(heads, "base", "left")

    def parts(head: str, tail: str, kind: str):
        first = F.slice(F.coalesce(head, F.array().cast(f"array<{kind}>")), F.lit(1), F.col("h"))
        return F.concat(first, F.slice(tail, F.col("h") + 1, F.greatest(F.size(tail), F.lit(1)))).alias(tail)

    return rows.select("conv_id", parts("hd", "digests", "string"), parts("hc", "counts", "int"))


def _pieces(batches):
    """Sorted (seq, conv_id) rows as pieces of comma-joined ids; a piece has one sequence's."""
    for b in batches:
        if not b.num_rows:
            continue
        seq, ids = b.column("seq").to_numpy(), b.column("conv_id").to_numpy()
        cuts = np.flatnonzero(np.diff(seq)) + 1
        starts = [0, *cuts.tolist(), len(seq)]
        rows = [(i, min(i + PIECE_IDS, z)) for a, z in zip(starts, starts[1:]) for i in range(a, z, PIECE_IDS)]
        yield shared.batch_of(_PIECES, {"seq": [int(seq[a]) for a, _ in rows], "at": [int(ids[a]) for a, _ in rows], "ids": [",".join(map(str, ids[a:z].tolist())).encode() for a, z in rows]})


def _digested(batches):
    """SHA-256 of each sequence's pieces, which come in order."""
    seq, state = None, None
    for b in batches:
        done = []
        for s, ids in zip(b.column("seq").to_pylist(), b.column("ids").to_pylist()):
            if s != seq:
                if seq is not None:
                    done.append((seq, state.hexdigest()))
                seq, state = s, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids)
        yield shared.batch_of(_HASHED, {"seq": [s for s, _ in done], "ends": [e for _, e in done]})
    if seq is not None:
        yield shared.batch_of(_HASHED, {"seq": [seq], "ends": [state.hexdigest()]})


def paths(convs: DataFrame) -> DataFrame:
    """Distinct paths: path, counts, turns, n (conversations), seq (the smallest of them), ends (digest of their ids)."""
    rows = shared.staged(convs.select("conv_id", F.array_join("digests", "").alias("path"), "counts"), "rebuilt")
    keyed = rows.withColumn("key", F.md5("path"))
    grouped = keyed.groupBy("key").agg(F.min(F.struct("conv_id", "path", "counts")).alias("x"), F.count(F.lit(1)).alias("n"))
    one = shared.staged(grouped.select("key", F.col("x.conv_id").alias("seq"), F.col("x.path").alias("path"), F.col("x.counts").alias("counts"), F.size("x.counts").cast("long").alias("turns"), "n"), "paths")
    copied = one.filter("n > 1").select("key", "seq")
    ids = shared.staged(keyed.select("key", "conv_id").join(copied, "key").select("seq", "conv_id"), "copies")
    pieces = shared.in_arrow(ids.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id"), _pieces, "seq long, at long, ids binary")
    hashed = shared.in_arrow(pieces.repartition("seq").sortWithinPartitions("seq", "at"), _digested, "seq long, ends string")
    columns = ["path", "counts", "turns", "n", "seq"]
    single = one.filter("n = 1").select(*columns, F.sha2(F.col("seq").cast("string").cast("binary"), 256).alias("ends"))
    return shared.staged(single.unionByName(one.filter("n > 1").join(hashed, "seq").select(*columns, "ends")), "weighted")


def build(rows: list[tuple], above: dict) -> list[tuple]:
    """Nodes of the tries of ``rows`` (under, at, path, counts, n, seq, ends); ``above``: the parents' (depth, conv_id) by ``under``.

    A node is a place in parallel lists; its children are a dictionary from the next turn's digest to their places.
    """
    tops: dict[tuple, int] = {}
    children: list[dict] = []
    parent, depth, n, least, words, ends, top = [], [], [], [], [], [], []

    def new(up: int, d: int, count: int, under: str | None) -> int:
        children.append({})
        for column, value in zip((parent, depth, n, least, words, ends, top), (up, d, 0, None, count, NOTHING, under)):
            column.append(value)
        return len(children) - 1

    for under, path, counts, weight, seq, end in rows:
        at, d = -1, above[under][0]
        for d in range(d, len(counts)):
            turn = path[d * WIDTH : (d + 1) * WIDTH]
            known = tops if at < 0 else children[at]
            key = (under, turn) if at < 0 else turn
            node = known.get(key)
            if node is None:
                node = known[key] = new(at, d + 1, counts[d], under if at < 0 else None)
            n[node] += weight
            if least[node] is None or seq < least[node]:
                least[node] = seq
            at = node
        ends[at] = end
    leaves, saved = [0] * len(children), [0] * len(children)
    stack = [(t, False) for t in tops.values()]
    while stack:
        node, below_done = stack.pop()
        kids = children[node]
        if not below_done and kids:
            stack.append((node, True))
            stack += [(k, False) for k in kids.values()]
            continue
        leaves[node] = sum(leaves[k] for k in kids.values()) or 1
        saved[node] = sum(saved[k] for k in kids.values()) + (n[node] - 1) * words[node]
    up = [above[top[i]][1] if p < 0 else least[p] for i, p in enumerate(parent)]
    return list(zip(least, depth, up, n, map(len, children), leaves, saved, ends, top))


def _bucket(pdf):
    import pandas as pd

    above = {u: (d, p) for u, d, p in zip(pdf["under"], pdf["depth"], pdf["parent"])}
    rows = list(zip(pdf["under"], pdf["path"], pdf["counts"], pdf["n"], pdf["seq"], pdf["ends"]))
    return pd.DataFrame(build(rows, above), columns=[c.split()[0] for c in NODES.split(", ")])


def _chains(batches):
    """Nodes of an oversized part: its first, and those below that all its paths go through."""
    names = [c.split()[0] for c in NODES.split(", ")]
    schema = pa.schema([(c, pa.string() if c in ("ends_sha256", "under") else pa.int64()) for c in names])
    for b in batches:
        for r in b.to_pylist():
            first, last, n = r["depth"] + 1, r["common"], r["n"]
            words = np.array(r["counts"][first - 1 : last], np.int64)
            own = (np.cumsum(words[::-1])[::-1] * (n - 1) + r["saved"]).tolist()
            k = last - first + 1
            children = [1] * (k - 1) + [r["kids"]]
            yield shared.batch_of(schema, {
                "conv_id": [r["least"]] * k, "depth": list(range(first, last + 1)), "parent_conv_id": [r["parent"]] + [r["least"]] * (k - 1), "n_convs": [n] * k, "n_children": children,
                "n_leaves": [max(1, r["leaves"])] * k, "saved_tokens": own, "ends_sha256": [NOTHING] * (k - 1) + [r["ends"] or NOTHING], "under": [r["under"]] + [None] * (k - 1),
            })


def nodes(found: DataFrame, bucket: int = BUCKET, most_turns: int = MOST_TURNS) -> DataFrame:
    """All nodes below the root and the root, from ``paths``: the columns of ``NODES`` without ``under``."""
    total = found.agg(F.min("seq"), F.sum("n")).first()
    if total[0] is None:
        return found.sparkSession.createDataFrame([], NODES).drop("under")
    # parts: paths that share their first depth + 1 turns; ``under`` is the digest of the node they hang from
    rows = found.filter("turns > 0").select("*", F.lit("").alias("under"), F.lit(0).cast("long").alias("depth"), F.lit(total[0]).cast("long").alias("parent"))
    built, large = None, []
    while True:
        rows = rows.withColumn("part", F.md5(F.expr(f"substring(path, 1, cast((depth + 1) * {WIDTH} as int))")))
        sizes = shared.staged(rows.groupBy("part").agg(F.sum("turns").alias("size"), F.sum("n").alias("n"), F.min("seq").alias("least"), F.first("under").alias("under"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
            F.min(F.struct("path", "counts")).alias("low"), F.max("path").alias("high")), "parts")
        big = sizes.filter(F.col("size") - F.col("depth") > most_turns)
        rest = rows.join(big.select("part"), "part", "left_anti")
        small = sizes.filter(F.col("size") - F.col("depth") <= most_turns).agg(F.sum("size")).first()[0] or 0
        dealt = rest.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(max(1, -(-small // bucket)))))
        level = shared.staged(dealt.select("bucket", "under", "depth", "parent", "path", "counts", "n", "seq", "ends").groupBy("bucket").applyInPandas(_bucket, NODES), "nodes")
        built = level if built is None else built.unionByName(level)
        if big.isEmpty():
            break
        # equal beginnings of the least and the greatest path are those of all between
        common = F.aggregate(F.sequence(F.lit(1), (F.least(F.length("low.path"), F.length("high")) / WIDTH).cast("int")), F.lit(0).cast("long"),
                             lambda acc, i: F.when((acc == i - 1) & (F.substr("low.path", (i - 1) * WIDTH + 1, F.lit(WIDTH)) == F.substr("high", (i - 1) * WIDTH + 1, F.lit(WIDTH))), i.cast("long")).otherwise(acc))
        groups = shared.staged(big.withColumn("common", common).select("part", "n", "least", "under", "depth", "parent", "common", F.col("low.counts").alias("counts")), "oversized")
        split = rows.drop("under", "depth", "parent").join(groups.select("part", F.col("common").alias("depth"), F.col("least").alias("parent")), "part")
        ending = shared.staged(split.filter("turns = depth").select("part", "ends"), "ending")
        large.append(groups.join(ending, "part", "left"))
        rows = shared.staged(split.filter("turns > depth").select(*found.columns, F.col("part").alias("under"), "depth", "parent"), "split")
    for groups in reversed(large):
        below = built.filter("under is not null").groupBy(F.col("under").alias("part")).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        full = groups.join(below, "part", "left").fillna(0, ["kids", "leaves", "saved"])
        built = built.unionByName(shared.staged(shared.in_arrow(full, _chains, NODES), "nodes"))
    ends = found.filter("turns = 0").agg(F.max("ends")).first()[0] or NOTHING
    top = built.filter("under = ''").agg(F.count(F.lit(1)).alias("n_children"), F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).cast("long").alias("saved_tokens"))
    root = top.select(F.lit(total[0]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total[1]).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.lit(ends).alias("ends_sha256"))
    return built.drop("under").unionByName(root)


def trie(turns: DataFrame, bucket: int = BUCKET, most_turns: int = MOST_TURNS) -> DataFrame:
    """The nodes of the rebuilt conversations of ``turns`` (conv_id, turn, role, text)."""
    return nodes(paths(rebuilt(shared.staged(sequences(turns), "conversations"))), bucket, most_turns)
