"""Token ids of whole texts with a fixed public tokenizer."""

from __future__ import annotations

import zlib

import numpy as np

from . import shared

#: Texts end with this id.
END_ID = 2
#: Words kept in a worker's table before it starts anew.
KEPT_WORDS = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Places(dict):
    """Word to its place; a word not seen before gets the next place and waits in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


class _Apart(dict):
    """Whether a full stop behind a character is a piece of its own.

    The library itself tells: what a character is composed to or lower-cased to may end in a mark, and then
    the stop joins it.
    """

    def __init__(self, run):
        super().__init__()
        self.run = run

    def __missing__(self, c: str) -> bool:
        both, one, stop = self.run([c + ".", c, "."])
        self[c] = out = both == one + stop
        return out


class WordEncoder:
    """Ids of texts, equal to encoding each whole text.

    The tokenizer never joins characters across a blank or a line feed, lower-cases what it reads
    and parts letters from punctuation. So each stretch between blanks is encoded once by the
    library and then looked up; a full stop or comma at its end stands alone behind a letter or a
    digit that stays one. The table starts anew at ``KEPT_WORDS`` entries: memory is bounded
    for any vocabulary of the corpus.
    """

    def __init__(self, path: str | None = None):
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.apart = _Apart(self._run)
        self._reset()

    def _reset(self) -> None:
        self.at = _Places()
        self.length = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.odd = np.zeros(1 << 16, bool)  # a stop behind the word may join it
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = 0
        self.marks = (self.at["."], self.at[","])
        self._learn()

    def _run(self, part: list[str]) -> list[list[int]]:
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in run(part, add_special_tokens=False)]

    def _put(self, k: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.length[k] = n
        self.start[k] = self.used + np.cumsum(n) - n
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def _put_each(self, k: np.ndarray, group: list[str]) -> None:
        ids = self._run(group)
        self._put(k, np.array([x for w in ids for x in w], np.int32), np.array(list(map(len, ids)), np.int64))

    def _learn(self) -> None:
        """Encode the words that wait."""
        new, self.at.new = self.at.new, []
        first = len(self.at) - len(new)
        while len(self.at) > len(self.length):
            self.length, self.start, self.odd = (np.concatenate([x, np.zeros_like(x)]) for x in (self.length, self.start, self.odd))
        self.odd[first : len(self.at)] = [bool(w) and not (w[-1].isalnum() and (w[-1].isascii() or self.apart[w[-1]])) for w in new]
        plain = np.fromiter((w.isalpha() and w.islower() for w in new), bool, len(new))
        letters, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        for at in range(0, len(letters), 2_000):  # joined by blanks: each ends where an end-of-word piece stands
            part = letters[at : at + 2_000]
            group = [new[i] for i in part]
            ids = np.array(self._run([" ".join(group)])[0], np.int32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                self._put(first + part, ids, np.diff(ends, prepend=0))
            else:
                self._put_each(first + part, group)
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            group = [new[i] for i in part]
            self._put_each(first + part, group)

    @staticmethod
    def _lower(text: str) -> str:
        """Lower case where it can't change the ids: in ASCII and Latin-1 texts without special tokens."""
        if "<|" in text:
            return text
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return text.lower()

    @staticmethod
    def _parts(text: str, marks: bool) -> list[str]:
        text = text.replace("\n", " ")
        if marks:
            text = text.replace(". ", " . ").replace(", ", " , ")
            if text[-1:] in (".", ","):
                text = f"{text[:-1]} {text[-1]}"
        return text.split(" ")

    def _look_up(self, split: list[list[str]]) -> list[np.ndarray]:
        get = self.at.__getitem__
        found = [np.array(list(map(get, parts)), np.int64) for parts in split]
        if self.at.new:
            self._learn()
        return found

    def encode(self, texts: list[str], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, count of each text); ``end`` is appended to each text."""
        if len(self.at) > KEPT_WORDS:
            self._reset()
        texts = [self._lower(t) for t in texts]
        found = self._look_up([self._parts(t, True) for t in texts])
        stop, comma = self.marks
        for i, k in enumerate(found):
            if (self.odd[k[:-1]] & ((k[1:] == stop) | (k[1:] == comma))).any():
                found[i] = self._look_up([self._parts(texts[i], False)])[0]
        pieces, counts = [], np.zeros(len(texts), np.int64)
        for i, k in enumerate(found):
            n = self.length[k].astype(np.int64)
            total = int(n.sum())
            where = np.repeat(self.start[k] - (np.cumsum(n) - n), n) + np.arange(total)
            pieces.append(self.flat[where])
            if end is not None:
                pieces.append(np.array([end], np.int32))
            counts[i] = total + (end is not None)
        return (np.concatenate(pieces) if pieces else np.zeros(0, np.int32)), counts


def encoder(path: str | None = None) -> WordEncoder:
    """This worker's encoder for a tokenizer file."""
    path = path or default_path()
    return shared.kept(f"encoder {path}", lambda: WordEncoder(path))


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
