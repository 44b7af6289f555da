"""Evaluation texts leaking into training texts.

Items and documents are cut into windows of the same number of words (for a stated passage length, that
length). Every window has a 64-bit SimHash over its weighted word shingles. Fingerprints that differ in
at most ``radius`` bits agree in at least one of ``radius + 1`` blocks, so looking up each block finds all
of them. Candidates are verified with the exact weighted-shingle similarity of the two windows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DROPPED = regex.compile(r"[\p{Mn}\p{Cf}]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class LeakParams:
    """``index_windows``: windows of items that are broadcast at a time; more items take more passes."""

    window: int = 9
    shingle: int = 5
    radius: int = 3
    min_sim: float = 0.8
    index_windows: int = 1_000_000
    chunk_words: int = 32_768


def words_of(text: str | None) -> list[str]:
    """NFKD, without marks and format characters, lower case; the longest runs of letters and digits."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(_DROPPED.sub("", unicodedata.normalize("NFKD", text)).lower())


_MEMO: dict[str, int] = {}


def _hashes(words: list[str]) -> np.ndarray:
    memo = _MEMO
    if len(memo) > 500_000:
        memo.clear()
    out = np.empty(len(words), np.uint64)
    for k, w in enumerate(words):
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh64_intdigest(w)
        out[k] = h
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(words: list[str], p: LeakParams) -> np.ndarray:
    """The SimHash of every window; a shingle weighs as many as it has characters."""
    n = len(words) - p.window + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h, size = _hashes(words), np.fromiter(map(len, words), np.int32, len(words))
    m = len(words) - p.shingle + 1
    combined, weight = np.zeros(m, np.uint64), np.zeros(m, np.int32)
    with np.errstate(over="ignore"):
        for k in range(p.shingle):
            combined = combined * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
            weight += size[k : k + m]
    bits = np.unpackbits(_mix(combined).astype("<u8").view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
    signed = np.where(bits, weight[:, None], -weight[:, None])
    total = np.zeros((m + 1, 64), np.int32)
    np.cumsum(signed, axis=0, out=total[1:])
    per = p.window - p.shingle + 1
    on = (total[per : per + n] - total[:n]) > 0
    return np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: list[str], b: list[str], shingle: int) -> float:
    """Exact weighted Jaccard similarity of two windows' shingles."""
    x, y = (Counter(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)) for w in (a, b))
    both = whole = 0
    for s in x.keys() | y.keys():
        weight = sum(map(len, s))
        both += weight * min(x[s], y[s])
        whole += weight * max(x[s], y[s])
    return both / whole if whole else 0.0


#: Candidate pairs of windows that are held at once.
CANDIDATE_PAIRS = 4_000_000


class _Index:
    """Multi-index over the distinct windows of a part of the items. It is built once and broadcast as arrays.

    A window that several items share stands in the index once; ``holders`` of it lists the items, once per place.
    """

    def __init__(self, items: list[tuple[int | None, list[str], np.ndarray]], p: LeakParams):
        self.ids, self.radius = [i for i, _, _ in items], p.radius
        found: dict[tuple[str, ...], int] = {}
        owner, window, prints = [], [], []
        for number, (_, words, marks) in enumerate(items):
            for at in range(len(marks)):
                text = tuple(words[at : at + p.window])
                k = found.setdefault(text, len(found))
                if k == len(prints):
                    prints.append(marks[at])
                owner.append(number)
                window.append(k)
        self.words = list(found)
        self.prints = np.array(prints, np.uint64)
        order = np.argsort(np.array(window, np.int64), kind="stable")
        self.owner = np.array(owner, np.int64)[order]
        self.first = np.searchsorted(np.array(window, np.int64)[order], np.arange(len(found) + 1))
        width = 64 // (p.radius + 1)
        self.blocks = []
        for k in range(p.radius + 1):
            bits = width if k < p.radius else 64 - width * p.radius
            shift, mask = np.uint64(k * width), np.uint64((1 << bits) - 1)
            value = (self.prints >> shift) & mask
            order = np.argsort(value, kind="stable")
            self.blocks.append((shift, mask, value[order], order))

    def holders(self, window: int) -> list[int]:
        return self.owner[self.first[window] : self.first[window + 1]].tolist()

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (document window, item window) whose fingerprints differ in at most ``radius`` bits."""
        found = [np.zeros((0, 2), np.int64)]
        for shift, mask, value, order in self.blocks:
            v = (prints >> shift) & mask
            a, b = np.searchsorted(value, v, side="left"), np.searchsorted(value, v, side="right")
            hit = np.flatnonzero(b > a)
            # a block that many windows share is looked through in pieces, so that few pairs are held
            piece = np.cumsum((b - a)[hit]) // CANDIDATE_PAIRS
            for part in np.split(hit, np.flatnonzero(np.diff(piece)) + 1):
                width = (b - a)[part]
                row = np.repeat(part, width)
                other = order[np.repeat(a[part], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)]
                near = np.bitwise_count(prints[row] ^ self.prints[other]) <= self.radius
                found.append(np.column_stack([row[near], other[near]]))
        both = np.unique(np.concatenate(found), axis=0)
        return both[:, 0], both[:, 1]


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, params: LeakParams = LeakParams()) -> DataFrame:
    """Documents that hold a window of an item: ``doc_id, item_id, windows, best_sim, exact_windows``.

    ``windows`` counts the pairs of windows with a similarity of at least ``min_sim``; ``exact_windows`` those
    whose words are the same. Whole texts are read. NULL, empty and shorter texts have no window.
    Rows that share an id count together; ids may be NULL. The index of the items is built once and broadcast in parts
    of at most ``index_windows`` windows, each part being one pass over the documents; documents are never collected.
    """
    p = params
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).filter("t is not null")
    schema = "doc_id long, item_id long, windows long, best_sim double, exact_windows long"

    def finder(sent):
        def compare(index: _Index, held: list[tuple[int, list[str]]], seen: dict[tuple[int, int], list]) -> None:
            """All windows of some pieces of texts at once; windows that would span two pieces are left out."""
            words = [w for _, piece in held for w in piece]
            prints = fingerprints(words, p)
            ends = np.cumsum([len(piece) for _, piece in held])
            own = np.repeat(np.arange(len(held)), [len(piece) for _, piece in held])[: len(prints)]
            whole = np.flatnonzero(np.arange(len(prints)) + p.window <= ends[own])
            mine, theirs = index.candidates(prints[whole])
            for at, other in zip(whole[mine].tolist(), theirs.tolist(), strict=True):
                a, b = words[at : at + p.window], list(index.words[other])
                same = a == b
                sim = 1.0 if same else similarity(a, b, p.shingle)
                if sim >= p.min_sim:
                    for number in index.holders(other):
                        s = seen.setdefault((held[own[at]][0], number), [0, 0.0, 0])
                        s[0] += 1
                        s[1] = max(s[1], sim)
                        s[2] += same

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                docs = batch.column(0).to_pylist()
                seen: dict[tuple[int, int], list] = {}
                held: list[tuple[int, list[str]]] = []
                size = 0
                for row, t in enumerate(batch.column(1)):
                    words = words_of(t.as_py())
                    for start in range(0, max(0, len(words) - p.window + 1), p.chunk_words):
                        held.append((row, words[start : start + p.chunk_words + p.window - 1]))
                        size += len(held[-1][1])
                        if size >= p.chunk_words:
                            compare(index, held, seen)
                            held, size = [], 0
                if held:
                    compare(index, held, seen)
                if seen:
                    found = [(docs[row], index.ids[k], *s) for (row, k), s in sorted(seen.items())]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)], ["doc_id", "item_id", "windows", "best_sim", "exact_windows"])

        return find

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words and fingerprints of the items, in the tasks."""
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            marks = [fingerprints(w, p).tobytes() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string())), pa.array(marks, pa.binary())], ["i", "t", "words", "marks"])

    def parts() -> Iterator[list]:
        held, windows = [], 0
        listed = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("t is not null")
        listed = listed.mapInArrow(cut, "i long, t string, words array<string>, marks binary").filter("length(marks) > 0").orderBy("i", "t").select("i", "words", "marks")
        for r in listed.toLocalIterator():
            marks = np.frombuffer(r.marks, np.uint64)
            if held and windows + len(marks) > p.index_windows:
                yield held
                held, windows = [], 0
            held.append((r.i, r.words, marks))
            windows += len(marks)
        if held:
            yield held

    total = None
    for held in parts():
        part = rows.mapInArrow(finder(spark.sparkContext.broadcast(_Index(held, p))), schema)
        total = part if total is None else total.unionByName(part)
    if total is None:
        return spark.createDataFrame([], schema)
    return total.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows"), F.max("best_sim").alias("best_sim"), F.sum("exact_windows").alias("exact_windows"))
