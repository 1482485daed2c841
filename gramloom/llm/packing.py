"""Harmonic packing: token sequences of a fixed capacity from classes of pieces with reciprocal lengths.

A document's token ids are cut into pieces: whole sequences first, then, of the rest, the longest
capacity / k below it, until the last piece leaves little of its own share unused (``cuts``). A piece of
length t has class k = capacity // t (lengths up to 128 are rounded up to a multiple of 4 for that), and
a bin of class k holds k pieces, whatever they are, since none exceeds capacity / k.

Each task fills bins of each class on its own while it reads; a bin is a finished sequence once it has its
k pieces. What stays in open bins at a task's end, fewer than k pieces a class, goes on to a round with a
task per ``ROUND`` pieces, and so on; the last round, of one task, packs its rest by best fit. A round
passes on at most ``LEFT`` pieces per task, so their number falls by more than ten times a round.

Ids are computed once: word by word from a cache of bounded bytes that holds no word of over ``LONG`` characters,
where probes show that the tokenizer's pieces never reach over blanks; with other tokenizers, text by text. Defined results: null or empty text is the end token alone; rows
with the same id are packed as rows of their own; an empty table gives an empty result; extra columns are
ignored. Memory is bounded by the cache, the open bins and one long text.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Store, table, utf8

CAPACITY, END, ROUND = 4096, 2, 1 << 16
#: Bounds of the cache: words, their bytes with those of their ids, and the bytes of a word.
CACHE, CACHE_BYTES, LONG = 700_000, 48 << 20, 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def class_of(length: int, capacity: int = CAPACITY) -> int:
    return capacity // (-(-length // 4) * 4 if length <= 128 and capacity >= 128 else length)


#: The most pieces that the open bins of one task can hold.
LEFT = sum(k - 1 for k in {class_of(t) for t in range(1, CAPACITY + 1)})


@lru_cache(maxsize=None)
def cuts(rest: int, capacity: int = CAPACITY) -> tuple[int, ...]:
    """Lengths of the pieces of fewer than ``capacity`` tokens; a piece wastes 1/32 of itself or 8 tokens at most."""
    if not rest:
        return ()
    k = class_of(rest, capacity)
    if capacity / k - rest <= max(8, rest / 32):
        return (rest,)
    cut = capacity // (k + 1)
    return (cut, *cuts(rest - cut, capacity))


class Bins:
    """Open bins of every class of one task; ``put`` returns a bin's pieces once it is full."""

    def __init__(self, level: int, task: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.open, self.next = capacity, {}, level << 56 | task << 32

    def close(self, pieces: list[tuple]) -> list[tuple]:
        at, out = 0, []
        for p in pieces:
            out.append((*p, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def put(self, piece: tuple) -> list[tuple]:
        k = class_of(piece[2], self.capacity)
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        return self.close(self.open.pop(k)) if len(bin_) == k else []

    def rest(self) -> list[tuple]:
        return [p for k in sorted(self.open) for p in self.open[k]]

    def best_fit(self, pieces: list[tuple]) -> list[tuple]:
        """All of ``pieces``, longest first, each into the fullest sequence that has room."""
        room, bins = [], []  # room: sorted (free, number of the bin)
        for p in sorted(pieces, key=lambda p: (-p[2], str(p[0]), p[1])):
            i = bisect.bisect_left(room, (p[2], -1))
            if i == len(room):
                bins.append([])
                free, b = self.capacity, len(bins) - 1
            else:
                free, b = room.pop(i)
            bins[b].append(p)
            if free > p[2]:
                bisect.insort(room, (free - p[2], b))
        return [x for b in bins for x in self.close(b)]


#: A word of Latin letters, then ASCII punctuation. Such words are the same before and after Unicode
#: normalization, and the tokenizer parts letters from punctuation; so its model may be asked for either alone.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\[-`{-~]*)\Z")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Numbers(dict):
    """Numbers words as they are first asked for, and notes the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


class Words:
    """Token ids of texts by way of a bounded cache of words."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.marks: dict[str, list[int]] = {"": []}
        self.reset()
        # only a tokenizer that parts words as PLAIN has it, and lower-cases, may go by its model
        probe = ["Wor", "wor", "\u00c9t\u00e9", "a", "zz", "\u0100b", "WOR!?", "b.", "\u00e9''", "q<|", "x_,"]
        self.plain = self.tokenizer.model.__class__.__name__ == "BPE" and all(self._plain(w) == self._whole(w) for w in probe)
        # only a tokenizer that gives words the same ids wherever they stand may go word by word
        texts = ["a b", " a", "a ", "a  b", "Wor wor\nWor", "x,\ty.", "a\r\nb", "\u00e9 \u00e9", "the the", "don't 12 34"]
        self.parted = all(sum(map(self._whole, re.split("[ \n\t\r]", t)), []) == self._whole(t) for t in texts)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def reset(self) -> None:
        self.bytes, self.number, self.size, self.first, self.ids, self.used = 0, _Numbers(), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0

    def _plain(self, word: str) -> list[int] | None:
        m = PLAIN.match(word)
        if not m:
            return None
        core = m[1].lower()
        if not core.isascii():
            core = "".join(map(self.letters.__getitem__, core.encode()))
        marks = self.marks.get(m[2])
        if marks is None:
            if len(self.marks) > 10_000:
                self.marks = {"": []}
            marks = self.marks[m[2]] = [t.id for t in self.model.tokenize(m[2])]
        return [t.id for t in self.model.tokenize(core)] + marks

    def _learn(self) -> None:
        """Ids of the words that were numbered since the last time."""
        words, self.number.new = self.number.new, []
        found = [self._plain(w) for w in words] if self.plain else [None] * len(words)
        hard = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(hard, self.tokenizer.encode_batch_fast([words[i] for i in hard], add_special_tokens=False)):
            found[i] = x.ids
        n, total = len(self.number) - len(words), sum(map(len, found))
        while len(self.number) > len(self.size):
            self.size, self.first = np.resize(self.size, 2 * len(self.size)), np.resize(self.first, 2 * len(self.first))
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.bytes += 4 * total + 4 * sum(map(len, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.size[n : n + len(words)] = sizes
        self.first[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + total] = np.fromiter((i for x in found for i in x), np.uint32, total)
        self.used += total

    def encode(self, text: str) -> np.ndarray:
        """The ids of the whole text. Only ASCII blanks part words here; other white space stays within a word, for the tokenizer."""
        if not self.parted:
            return np.array(self._whole(text), np.uint32)
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        out, at = [], 0
        for k in [i for i, w in enumerate(words) if len(w) > LONG] if len(text) > LONG else []:
            out += self._parts(words, at, k)
            out.append(np.array(self._whole(words[k]), np.uint32))
            at = k + 1
        out += self._parts(words, at, len(words))
        return out[0] if len(out) == 1 else np.concatenate(out or [np.empty(0, np.uint32)])

    def _parts(self, words: list[str], start: int, end: int) -> list[np.ndarray]:
        return [self._some(words[k : min(k + 100_000, end)]) for k in range(start, end, 100_000)]

    def _some(self, words: list[str]) -> np.ndarray:
        if len(self.number) > CACHE or self.bytes > CACHE_BYTES:
            self.reset()
        which = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if self.number.new:
            self._learn()
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return np.empty(0, np.uint32)
        return self.ids[np.repeat(self.first[which] - ends + sizes, sizes) + np.arange(ends[-1])]


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    return Words(path)


def _batches(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * len(NAMES))], NAMES)


def _first_round(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, words, rows = Bins(1, TaskContext.get().partitionId(), capacity), _words(tokenizer), []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(words.encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                n, start = len(ids), 0
                for length in (*[capacity] * (n // capacity), *cuts(n % capacity, capacity)):
                    rows += bins.put((doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), n))
                    start += length
                if len(rows) > 10_000:
                    yield _batches(rows)
                    rows = []
        yield _batches(rows + [(*p, None, None) for p in bins.rest()])

    return docs.mapInArrow(pack, SCHEMA)


def _next_round(left: DataFrame, level: int, last: bool, capacity: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, rows = Bins(level, TaskContext.get().partitionId(), capacity), []
        for batch in batches:
            for p in zip(*(c.to_pylist() for c in batch.columns[:5])):
                rows += bins.put(p)
        yield _batches(rows + (bins.best_fit(bins.rest()) if last else [(*p, None, None) for p in bins.rest()]))

    return left.mapInArrow(pack, SCHEMA)


def pack(docs: DataFrame, store: Store, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places in sequences; see the module for the method.

    ``tokenizer`` is the path of a tokenizer file that every executor has.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    if capacity < 1:
        raise ValueError("capacity must be positive")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    done = pieces = store.keep(_first_round(texts, tokenizer, capacity), "round1")
    done, level = done.filter("sequence_id is not null"), 1
    left = pieces.filter("sequence_id is null")
    while n := left.count():
        level, tasks = level + 1, -(-n // ROUND)
        pieces = store.keep(_next_round(left.repartition(tasks), level, tasks == 1, capacity), f"round{level}")
        done, left = done.unionByName(pieces.filter("sequence_id is not null")), pieces.filter("sequence_id is null")
    return done


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of ``documents`` packed into sequences of at most 4096."""
    return pack(table(spark, sf_dir, "documents"), Store(spark, "packing"))
