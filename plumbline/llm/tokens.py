"""Byte-level BPE over whole corpora, by merge rounds on flat arrays.

Text is cut into words by the tokenizer's public pattern. A worker encodes each distinct word once: the symbols of all new words lie in one
flat array, and every round finds in each word the adjacent pair of lowest rank, by binary search over the
sorted keys of all pairs, and merges all its places at once, until no word has a known pair.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_AT_ONCE = 3_000_000  # characters
SEGMENT = 500_000
WORDS_KEPT = 300_000
NONE = np.iinfo(np.int32).max


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if it is printable, else one from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes words of one vocabulary file; keeps a bounded number of words it has met."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex

        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.cut = regex.compile(r"(?<=\S) (?=\S)").search
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        self.first = np.zeros(256, np.int32)
        for letter, b in byte_letters().items():
            self.first[b] = vocab[letter]
        self.size = max(vocab.values()) + 1
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        left, right, whole = (np.array([vocab[x] for x in xs], np.int64) for xs in (*zip(*pairs), [a + b for a, b in pairs]))
        key = left * self.size + right
        order = np.argsort(key)
        self.keys, self.rank, self.whole = key[order], order.astype(np.int32), whole.astype(np.int32)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of ids of each."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(size.size), size)
        rank = np.full(sym.size, NONE, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        # Equal pairs of bytes are many at the start: each kind is looked up once.
        kinds, which = np.unique(sym[inner].astype(np.int64) * self.size + sym[inner + 1], return_inverse=True)
        rank[inner] = self.ranks(kinds // self.size, kinds % self.size)[which]
        done_sym, done_word = [], []
        while sym.size:
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, start)
            count = np.diff(np.r_[start, sym.size])
            going = least < NONE
            if not going.all():
                live = np.repeat(going, count)
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, least, count = sym[live], word[live], rank[live], least[going], count[going]
                if not sym.size:
                    break
            hit = np.flatnonzero(rank == np.repeat(least, count))
            # In a run of overlapping places (a a a) every second one, from the left, is merged.
            fresh = np.r_[True, (hit[1:] != hit[:-1] + 1)]
            if not fresh.all():
                lead = np.maximum.accumulate(np.where(fresh, np.arange(hit.size), 0))
                hit = hit[(np.arange(hit.size) - lead) % 2 == 0]
            sym[hit] = self.whole[rank[hit]]
            keep = np.ones(sym.size, bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at = moved[hit]
            stale = np.unique(np.r_[at, at[at > 0] - 1])
            rank[stale] = NONE
            stale = stale[stale < sym.size - 1]
            stale = stale[word[stale] == word[stale + 1]]
            rank[stale] = self.ranks(sym[stale], sym[stale + 1])
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(size.size, np.int32)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=size.size).astype(np.int32)

    def learn(self, words: list[str]) -> None:
        ids, count = self.merge(words)
        n, m = len(self.known), len(words)
        while self.used + ids.size > self.flat.size:
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while n + m > self.start.size:
            self.start, self.length = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.length, np.zeros_like(self.length)]
        self.flat[self.used : self.used + ids.size] = ids
        self.start[n : n + m] = self.used + np.cumsum(count) - count
        self.length[n : n + m] = count
        self.used += ids.size
        self.known.update(zip(words, range(n, n + m)))

    def split(self, text: str) -> list[str]:
        """Words of a text. A very long one is taken in segments that end before a lone space, where a word always begins."""
        if len(text) <= SEGMENT:
            return self.words(text)
        out, pos = [], 0
        while pos < len(text):
            cut = self.cut(text, pos + SEGMENT) if pos + SEGMENT < len(text) else None
            end = cut.start() if cut else len(text)
            out += self.words(text[pos:end])
            pos = end
        return out

    def encode(self, texts: list[str | None], ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other (if asked for), and the number of ids of each."""
        if len(self.known) > WORDS_KEPT:
            self.forget()
        words: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if text:
                words += self.split(text)
            ends[i + 1] = len(words)
        at = list(map(self.known.get, words))
        if None in at:
            self.learn(list(dict.fromkeys(w for w, i in zip(words, at) if i is None)))
            at = list(map(self.known.__getitem__, words))
        at = np.array(at, np.int64) if at else np.zeros(0, np.int64)
        size = self.length[at].astype(np.int64)
        total = np.r_[0, np.cumsum(size)]
        count = total[ends[1:]] - total[ends[:-1]]
        if not ids:
            return np.zeros(0, np.int32), count
        place = np.repeat(self.start[at] - total[:-1], size) + np.arange(total[-1])
        return self.flat[place], count


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about TEXT_AT_ONCE bytes each."""
    import pyarrow.compute as pc

    size = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
    start, base = 0, 0.0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(size, base + TEXT_AT_ONCE, "right")))
        yield start, stop
        start, base = stop, size[stop - 1]


def _mapper(path: str, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path)
        for batch in batches:
            for lo, hi in _pieces(batch.column(1)):
                piece = batch.slice(lo, hi - lo)
                flat, count = coder.encode(piece.column(1).to_pylist(), ids)
                got = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(flat)) if ids else pa.array(count)
                yield pa.RecordBatch.from_arrays([piece.column(0), got], names=["key", "got"])

    return run


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>): the token ids of each row's whole text, without special tokens; their strings are ordinary text.

    Null and empty texts have an empty list. Every row comes out once, repeated rows too. Runs where the rows are, without a shuffle.
    """
    kind = dict(docs.dtypes)[key]
    out = docs.select(key, text).mapInArrow(_mapper(path or default_path(), True), f"key {kind}, got array<int>")
    return out.select(F.col("key").alias(key), F.col("got").alias("ids"))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens long): as token_ids, only the number of ids."""
    kind = dict(docs.dtypes)[key]
    out = docs.select(key, text).mapInArrow(_mapper(path or default_path(), False), f"key {kind}, got long")
    return out.select(F.col("key").alias(key), F.col("got").alias("n_tokens"))
