"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps look-alike letters of other scripts and full-width forms to Latin ones, digits
and signs inside words to the letters they stand for, and writes i and l alike, since 1 stands for both.
Terms are learned from labelled training texts, near copies aside: whole words, and stems of three to
eight letters that go on (``stem*``), which toxic rows have far more often than clean ones. Their weight
is the log odds; of the terms in one word the heaviest counts, and a whole word's own weight goes first.
A general seed list has a prior weight; training evidence replaces it. A term within an exception phrase
doesn't count. The evidence, normalised by length, passes through a logistic curve fitted to the rows.

Length counts little: evidence is divided by 1 at 0 words, 1.1 at 500 and 1.56 at 20,000, since one abusive passage
makes a long text toxic as well, while chance hits grow with length.

Training reads at most ``MOST_ROWS`` labelled rows, the first by hash of doc_id (a documented bound; the
labels table may be larger), each with the least text of its doc_id; a doc_id with both labels is toxic. Terms
are all that these rows bear out. Everything else runs over all documents. The same rows in any order and
partitioning give the same lexicon and scores.

Cases: null and empty texts score as texts without a term; null labels teach nothing; repeated rows score
each; without toxic training rows the seed list stands; other columns are ignored, or kept by ``clean``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared

MOST_ROWS = 12_000
#: Terms that a task counts before it gives their counts out.
KEPT_TERMS = 300_000
THRESHOLD = 0.7
#: Seed terms and their prior weight: general insults, fixed values.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "bastard", "scumbag", "dumbass", "asshole", "bitch", "retard", "vermin")
PRIOR = 3.0
#: Phrases in which a term doesn't count, fixed values.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash day", "trash collection", "take out the trash", "taking out the trash",
    "clown fish", "class clown", "circus clown", "birthday clown", "rodeo clown", "sore loser", "pond scum", "soap scum",
    "not stupid", "no stupid question", "the idiot by dostoevsky", "dostoevsky s the idiot", "idiot proof",
)
#: log likelihood ratio and log odds that a learned term needs.
LEAST_RATIO, LEAST_ODDS = 11.0, 1.5
STEM = range(3, 9)
LENGTH_SHARE = 0.15
LENGTH_WORDS = 500
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("terms", pa.int64()), ("evidence", pa.float64())])

#: Look-alikes of Latin letters in Greek, Cyrillic and other scripts, fixed values.
_ALIKE = {
    "a": "аαɑ", "b": "ьвβ", "c": "сϲⅽ", "d": "ԁⅾ", "e": "еεё", "f": "ƒ", "g": "ɡ", "h": "һн", "i": "іιıⅰļӏ", "j": "јϳ", "k": "кκ", "l": "ⅼ",
    "m": "мⅿ", "n": "пη", "o": "оοօ", "p": "рρ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵνⅴ", "w": "ԝѡω", "x": "хχⅹ", "y": "уγү", "z": "ᴢ",
}
#: Digits and the letters they stand for, fixed values.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}


def _fold_table() -> dict[int, str]:
    out = {c: chr(c + 32) for c in range(65, 91)}
    for latin, others in _ALIKE.items():
        for o in others:
            for x in {o, o.upper()}:
                if len(x) == 1:
                    out.setdefault(ord(x), latin)
    for c in range(0xFF10, 0xFF5B):  # full-width digits and letters
        out[c] = chr(c - 0xFEE0).lower()
    for d, latin in _DIGITS.items():
        out[ord(d)] = latin
        out[ord(d) + 0xFEE0] = latin
    for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xAD, 0xFEFF):  # characters without width
        out[c] = ""
    return {k: "i" if v == "l" else v for k, v in out.items()} | {ord("l"): "i", ord("L"): "i"}


_TABLE = _fold_table()
#: For texts of Latin-1 alone a bytes table gives the same and is faster.
_LATIN1 = bytes(ord(x) if len(x := _TABLE.get(c, chr(c))) == 1 and ord(x) < 256 else c for c in range(256))
_SIGN_LETTERS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e"}
_SIGNS = re.compile(r"[@$](?=[^\W_])|(?<=[^\W_])[!|+€](?=[^\W_])")


def fold(text: str) -> str:
    if any(s in text for s in _SIGN_LETTERS):
        text = _SIGNS.sub(lambda m: _SIGN_LETTERS[m[0]], text)
    if "\xad" not in text:
        try:
            return text.encode("latin-1").translate(_LATIN1).decode("latin-1")
        except UnicodeEncodeError:
            pass
    return text.translate(_TABLE)


def _spaced(phrase: str) -> str:
    return " ".join(re.findall(r"\w+", fold(phrase)))


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 2.0
    bias: float = -4.0
    _matcher: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_matcher": None}

    def matcher(self):
        if self._matcher is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for e in self.exceptions:
                a.add_word(_spaced(e), (_spaced(e), None))
            for t in self.weights:  # a term that is an exception phrase as well stays a term
                t = t.rstrip("*")
                a.add_word(t, (t, (self.weights.get(t), self.weights.get(t + "*"))))
            if len(a):
                a.make_automaton()
            self._matcher = a
        return self._matcher

    def evidence(self, text: str) -> tuple[int, float]:
        """(terms found, their weight normalised by length)."""
        a = self.matcher()
        if not text or not len(a):
            return 0, 0.0
        text = fold(text)
        words: dict[int, tuple[bool, float, int]] = {}  # at a word's start: whole, weight, end
        spans = []
        for end, (term, w) in a.iter(text):
            first = end - len(term) + 1
            if first and text[first - 1].isalnum():
                continue
            whole = end + 1 == len(text) or not text[end + 1].isalnum()
            if w is None:
                if whole:
                    spans.append((first, end))
                continue
            w = w[0] if whole else w[1] if text[end + 1].isalpha() else None
            if w is not None and (first not in words or (whole, w) > words[first][:2]):
                words[first] = (whole, w, end)
        hits = [(f, e, w) for f, (_, w, e) in words.items() if not any(x <= f and e <= y for x, y in spans)]
        if not hits:
            return 0, 0.0
        n_words = text.count(" ") + text.count("\n") + 1
        total = sum(w for _, _, w in hits)
        return len(hits), total / (1 + LENGTH_SHARE * math.log1p(n_words / LENGTH_WORDS))

    def score(self, text: str) -> tuple[float, int, float]:
        n, e = self.evidence(text)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + self.slope * e)))), n, e


def _counts(batches):
    """Rows of this task's training texts that have a word or a stem: term, toxic rows, clean rows."""
    t: dict[str, list[int]] = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array([x[1] for x in t.values()], pa.int64()), pa.array([x[0] for x in t.values()], pa.int64())], names=["term", "t", "n"])

    for b in shared.slices(batches, "text"):
        for text, y in zip(shared.texts(b.column("text")), b.column("toxic").to_pylist()):
            terms = set()
            for w in set(re.findall(r"[^\W\d_]{3,}", fold(text))):
                terms.add(w)
                terms.update(w[:k] + "*" for k in STEM if k < len(w))
            for w in terms:
                t.setdefault(w, [0, 0])[y] += 1
            if len(t) > KEPT_TERMS:
                yield out()
                t.clear()
    yield out()


def _sketched(batches):
    """Three minima of each text's shingles, by which near copies are told."""
    from .near_dedup import signature
    from .shingles import shingle_set

    for b in shared.slices(batches, "text"):
        m = []
        for t in shared.texts(b.column("text")):
            s = shingle_set(t, 3)
            m.append(signature(s)[:3].astype(np.int64) if len(s) else np.zeros(3, np.int64))
        m = np.array(m)
        yield pa.RecordBatch.from_arrays([b.column("text"), b.column("toxic"), *(pa.array(m[:, i]) for i in range(3))], names=["text", "toxic", "m0", "m1", "m2"])


def _training(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """The labelled training texts: text, toxic."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    rows = rows.filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most ``most`` ids are broadcast, and each has one text
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, bias) of a logistic curve by damped Newton steps."""
    if not len(y) or y.min() == y.max():
        return 2.0, -4.0
    design, theta = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (y - p) - 0.05 * (theta - np.array([2.0, -4.0]))
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return max(0.5, float(theta[0])), float(theta[1])


def _true_stems(rows: DataFrame, stems: dict[str, int]) -> set[str]:
    """Stems that stand in several words, none of which has most of their rows, and that no longer stem replaces."""
    if not stems:
        return set()

    def run(batches):
        stem, word = [], []
        for b in batches:
            for t in shared.texts(b.column("text")):
                for w in set(re.findall(r"[^\W\d_]{3,}", fold(t))):
                    for k in STEM:
                        if k < len(w) and w[:k] + "*" in stems:
                            stem.append(w[:k] + "*")
                            word.append(w)
        yield pa.RecordBatch.from_arrays([pa.array(stem, pa.string()), pa.array(word, pa.string())], names=["stem", "word"])

    found = rows.filter("toxic = 1").mapInArrow(run, "stem string, word string").groupBy("stem", "word").count()
    spread = found.groupBy("stem").agg(F.max("count").alias("most"), F.count(F.lit(1)).alias("words")).collect()  # a row for each stem
    kept = {r.stem for r in spread if r.words >= 4 and 2 * r.most <= stems[r.stem]}
    return {s for s in kept if not any(o != s and o.startswith(s[:-1]) and stems[o] >= 0.9 * stems[s] for o in kept)}


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Lexicon:
    """Lexicon and curve from at most ``most_rows`` labelled rows."""
    rows = shared.in_arrow(_training(docs, labels, most_rows), _sketched, "text string, toxic int, m0 long, m1 long, m2 long")
    # one of near copies, of toxic and clean ones each: rows whose three minima all agree
    rows = rows.groupBy("m0", "m1", "m2", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select("x.text", "toxic")
    rows = shared.staged(rows, "toxic-training")
    totals = dict(tuple(r) for r in rows.groupBy("toxic").count().collect())
    toxic, clean_rows = totals.get(1, 0), totals.get(0, 0)
    weights = {fold(s): PRIOR for s in SEEDS}
    if toxic:
        found = shared.in_arrow(rows, _counts, "term string, t long, n long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        share = (F.col("n") + 0.5) / (clean_rows + 1)
        found = found.withColumn("odds", F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log(share))
        found = found.withColumn("ratio", F.col("t") * F.log(F.col("t") / (share * toxic)) - F.col("t") + share * toxic)
        seeds = list(weights)
        best = found.filter((F.col("t") > 0) & ((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") >= LEAST_ODDS) | F.col("term").isin(seeds)))
        chosen = {r.term: r for r in best.orderBy(F.desc("ratio"), "term").collect()}
        stems = _true_stems(rows, {t: r.t for t, r in chosen.items() if t.endswith("*")})
        weights |= {t: max(0.0, min(8.0, r.odds)) for t, r in chosen.items() if (not t.endswith("*") or t in stems) and (t not in weights or r.t + r.n >= 3)}
    lexicon = Lexicon({w: x for w, x in weights.items() if x > 0})

    def measure(batches):
        for b in shared.slices(batches, "text"):
            e = [lexicon.evidence(t)[1] for t in shared.texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.float64()), b.column("toxic")], names=["e", "toxic"])

    points = shared.in_arrow(rows, measure, "e double, toxic int").toPandas().sort_values(["e", "toxic"])  # most_rows at most; in order, so that sums don't hang on it
    lexicon.slope, lexicon.bias = _fit_curve(points.e.to_numpy(float), points.toxic.to_numpy(float))
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted, terms, evidence for every row."""

    def run(batches):
        for b in shared.slices(batches, "text"):
            rows = [lexicon.score(t) for t in shared.texts(b.column("text"))]
            s, n, e = zip(*rows)
            yield shared.batch_of(_SCORED, {"doc_id": b.column("doc_id"), "score": s, "terms": n, "evidence": e})

    out = shared.in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, terms long, evidence double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "terms", "evidence")


def clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents below the threshold, whole rows, without a shuffle."""

    def run(batches):
        for b in shared.slices(batches, "text"):
            yield b.filter(pa.array([lexicon.score(t)[0] < THRESHOLD for t in shared.texts(b.column("text"))], pa.bool_()))

    return shared.in_arrow(docs, run, docs.schema)
