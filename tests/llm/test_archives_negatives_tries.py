"""Archives, hard negatives and conversation tries against brute force and round trips."""

import hashlib
import io
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesieve.llm import conversation_trie, hard_negatives, vectors, warc

HTML = "page_id long, url string, html string, error string"


def _pages(spark):
    big = "<p>ß " + "x" * 1500 + "</p>"
    rows = [(1, "http://a/1", big, "e"), (2, "http://a/2", big, None), (7, None, big, None), (7, "http://a/7", big, None), (None, "http://a/n", big, None), (3, "u\r\nv", "short", None), (4, "http://b", "short", None),
            (5, "http://c", None, None), (6, "http://d", "", None), (None, "http://e", "<b>" * 900, None), (8, "http://long", "é\x00 & " * 300_000, None), (9, "http://f", "y" * 999, None), (10, "http://f", "y" * 999, None)]
    return rows, spark.createDataFrame(rows, HTML)


def test_archives_round_trip(spark):
    rows, pages = _pages(spark)
    found = warc.read(warc.write(pages.repartition(3), date="2024-01-01T00:00:00Z")).filter("record_type <> 'warcinfo'")
    leader = defaultdict(lambda: None)
    for p, _, h, _ in rows:
        if p is not None:
            leader[h or ""] = max(p, leader[h or ""] or p)
    want = []
    for p, u, h, _ in rows:
        data = (h or "").encode()
        to = leader[h or ""] if len(data) >= 1000 and leader[h or ""] is not None and leader[h or ""] != p else None
        want.append((p, u and u.replace("\r", "%0D").replace("\n", "%0A"), len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to, None))
    got = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.error) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    whole = {(r.page_id, r.url): (bytes(r.payload), r.error) for r in warc.resolved(found).collect()}
    assert whole == {(p, u and u.replace("\r", "%0D").replace("\n", "%0A")): ((h or "").encode(), None) for p, u, h, _ in rows}


def test_archives_roll_over_and_empty(spark):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("p"), F.sha2(F.col("id").cast("string"), 512)).alias("html"))
    files = warc.write(pages.coalesce(1), file_bytes=2000)
    assert files.count() > 3
    assert sorted(r.page_id for r in warc.pages_of(warc.read(files, payloads=False)).collect()) == list(range(40))
    assert warc.pages_of(warc.read(warc.write(pages.limit(0)))).count() == 0


def _archive():
    payloads = [b"first", b"second " * 400, b"third"]
    return [warc.page_record(i, f"u{i}", p, hashlib.sha1(p).hexdigest(), None, "d") for i, p in enumerate(payloads)]


def _read(data):
    return [(r.get("page_id"), r.get("error")) for r in warc.records(io.BytesIO(data))]


def test_damaged_archives():
    a, b, c = _archive()
    assert _read(a + b + c) == [(0, None), (1, None), (2, None)]
    # a byte of a member turned: the check sum or the stream breaks, the next record is read
    hurt = bytearray(b)
    hurt[len(b) // 2] ^= 0x55
    got = _read(a + bytes(hurt) + c)
    assert got[0] == (0, None) and got[-1] == (2, None) and any(e for _, e in got[1:-1])
    cut = _read(a + b[:-20])
    assert cut[0] == (0, None) and "ends within" in cut[-1][1]
    assert _read(b"") == []
    assert _read(b"not an archive at all")[0][1] is not None
    # several records in one member are read as well
    both = zlib.compressobj(6, zlib.DEFLATED, 31)
    joined = both.compress(zlib.decompress(a, 31) + zlib.decompress(c, 31)) + both.flush()
    assert _read(joined) == [(0, None), (2, None)]


@pytest.mark.parametrize("old, new, error", [(b"first", b"fir5t", "block digest"), (b"Content-Length: 7", b"Content-Length: 9", "line ends"), (b"WARC/1.1", b"WORC/1.1", "no record"), (b"WARC-Type: response", b"WARC-Type response", "colon")])
def test_wrong_records(old, new, error):
    a, _, c = _archive()
    plain = zlib.decompress(a, 31)
    if error == "line ends":
        n = plain.split(b"Content-Length: ")[1].split(b"\r\n")[0]
        old, new = b"Content-Length: " + n, b"Content-Length: " + str(int(n) - 2).encode()
    assert old in plain
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    got = _read(z.compress(plain.replace(old, new, 1)) + z.flush() + c)
    assert error in got[0][1] and got[-1] == (2, None)


def _negatives(rows, positives=5, negatives=5, low=80):
    used = []
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((i, label, [math.floor(256 * x) for x in v]))
    out, seen = [], set()
    for i, label, v in used:
        if i % 4 or (key := (i, label, tuple(v))) in seen:
            continue
        seen.add(key)
        score = [(-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in used if j != i]
        best = sorted((s, j) for s, j, other in score if other == label)[:positives]
        for s, p in best:
            hard = sorted((t, j) for t, j, other in score if other != label and low * -s <= 100 * -t <= 100 * -s)[:negatives]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j) in enumerate(hard)]
    return out


@pytest.mark.parametrize("scale", [1.0, 2.0**22])
def test_hard_negatives_equal_brute_force(spark, scale):
    r = random.Random(4)
    rows = [(i, r.randrange(3), [r.choice((0.0, 0.25, 0.5, r.random())) * scale for _ in range(4)], "x") for i in range(90)]
    rows += [(0, 1, rows[5][2], "x"), rows[8], rows[8], (91, None, [1.0] * 4, "x"), (None, 1, [1.0] * 4, "x"), (92, 1, None, "x"), (93, 1, [1.0, None, 1.0, 1.0], "x"), (94, 1, [float("nan")] * 4, "x"), (95, 2, [float("inf")] * 4, "x"), (96, 2, [1.0], "x"), (97, 0, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, score string")
    got = hard_negatives.mined(df.repartition(3), F.col("vec_id") % 4 == 0, shard=16, anchors=5)
    assert sorted(map(tuple, got.collect())) == sorted(_negatives(rows))
    assert got.count() > 50
    assert hard_negatives.mined(df.limit(0), F.col("vec_id") % 4 == 0).count() == 0


def test_lists_merge_in_any_cut():
    r = np.random.default_rng(3)
    scores, ids = r.integers(0, 6, (7, 60)).astype(float), r.permutation(60)
    ok = r.random((7, 60)) < 0.8
    want = [sorted((-scores[i, j], ids[j]) for j in range(60) if ok[i, j])[:5] for i in range(7)]
    for width in (1, 4, 13, 60):
        best = hard_negatives.Best(7, 5)
        for a in range(0, 60, width):
            best.merge(scores[:, a : a + width], ok[:, a : a + width], ids[a : a + width])
        assert [[(-s, i) for q, s, i in zip(best.row, best.score, best.id) if q == k] for k in range(7)] == want


def test_packed_arrays():
    arrays = [np.arange(3), np.array([[2**70, -1]], object), np.zeros((0, 4), np.int64), np.array([[1, 2], [3, 4]], "<i2")]
    back = vectors.unpacked(vectors.packed(arrays))
    assert [a.tolist() for a in back] == [a.tolist() for a in arrays]


def _trie(rows):
    import re

    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in own.items()}
    made = {c: tuple(own.get(c - int(math.fmod(c, 20)), [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:]) for c, v in own.items()}
    members, kids = defaultdict(list), defaultdict(set)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
            if d:
                kids[v[: d - 1]].add(v[:d])
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p)))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], ends(p)) for p, m in members.items()]


def _turns(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(-25, 70), 400, 403, 1007]:
        if c in (20, -20):
            continue
        for t in range(r.choice((1, 1, 2, 3, 5, 9))):
            rows.append((c, t, r.choice(("user", "user", None)), r.choice(("hi there", "hi there", "a\tb  c", "", None, f"w{r.randrange(3)}")), "x"))
    rows += [(c, t, "system", "the same prompt", "y") for c in range(2000, 2040) for t in range(-6, 0)]  # copies with a long common head
    rows += [(c, 7, "user", f"own {c % 7}", "y") for c in range(2000, 2040)]
    rows += [(5, None, "user", "null first", "z"), (5, 0, "assistant", "tie", "z"), (5, 0, "assistant", "tie", "z"), (None, 0, "user", "lost", "z"), (3001, None, None, None, "z")]
    rows += [(4000, t, "user", f"turn {t}", "z") for t in range(120)]  # longer than a part may be
    return rows


@pytest.mark.parametrize("seed, bucket, most", [(1, 100_000, 200_000), (2, 40, 30), (3, 15, 6)])
def test_trie_equals_brute_force(spark, seed, bucket, most):
    rows = _turns(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string")
    got = conversation_trie.trie(df.repartition(3), bucket, most)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(_trie([x[:4] for x in rows]), key=repr)


def test_empty_and_turnless_tries(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert conversation_trie.trie(spark.createDataFrame([], kind)).count() == 0
    # ids whose head comes from an absent conversation and whose own turns all go
    alone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(alone, 0, "user", "gone")]
    assert list(map(tuple, conversation_trie.trie(spark.createDataFrame(rows, kind)).collect())) == _trie(rows)
