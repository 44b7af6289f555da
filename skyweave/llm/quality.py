"""Per-document text statistics, and the structure that a text resembles.

All statistics are JVM-side expressions over the whole text. A text's structure is judged by three distributions: that of
its words over every single common word, that of its characters over classes, and that of its lines over ended and open ones.
They are compared by Jensen-Shannon divergence with profiles: prose of each language, lists, tables and junk; the
nearest is assigned. The profiles begin as stated prototypes and are fitted to the corpus: all documents are assigned to their
nearest profile, and every profile becomes the mean of its documents, some rounds long. The rules play no part in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.session import materialise

# Separators of words, marks and signs by which texts are judged.
SEPARATORS = " \t\r\n "
SYMBOLS = "#$%&*+/<=>@\\^_|~{}[]•"
SENTENCE_ENDS = ".!?…;:"
WORD_EDGES = ".,;:!?…\"'()[]«»¿¡–—"

CLASSES = ("letters", "digits", "ends", "symbols", "other")
LINES = ("ended", "open")

# The prototypes that profiles begin with; shares of CLASSES and LINES, and of common words among all words.
PROTOTYPES = {
    "prose": ((0.80, 0.01, 0.015, 0.001, 0.174), (0.85, 0.15), 0.45),
    "list": ((0.77, 0.03, 0.002, 0.02, 0.178), (0.05, 0.95), 0.20),
    "table": ((0.50, 0.20, 0.01, 0.09, 0.20), (0.03, 0.97), 0.05),
    "junk": ((0.45, 0.30, 0.05, 0.14, 0.06), (0.30, 0.70), 0.02),
}


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 3
    min_word_length: float = 2.5
    max_word_length: float = 11.0
    max_symbols: float = 0.08
    min_lines: int = 3
    min_line_ends: float = 0.5
    min_common: float = 0.1
    fit_rounds: int = 3
    prototype_weight: float = 20.0


def _one_of(chars: str) -> str:
    return "".join("\\" + c if c in "\\[]^-&~#" else c for c in chars)


_SEP = "[" + _one_of(SEPARATORS) + "]"


def _count(text: Column, chars: str) -> Column:
    """Characters of ``text`` that match the class ``chars``."""
    return F.length(F.regexp_replace(text, f"[^{chars}]", "")).cast("long")


def text_statistics(df: DataFrame, key: str, text: str, common: DataFrame, lang: str = "lang", word: str = "word", params: QualityParams = QualityParams()) -> DataFrame:
    """``doc_id`` with word, character and line counts, shares, the rules that hold, and ``hits``, the common words of the text.

    A NULL or empty text has no words and no lines; a share of nothing is NULL. Rows keep their number
    and ids may be NULL or repeated. ``common`` holds common words by language; the list travels to the tasks as a set.
    """
    every = sorted(r.word for r in common.select(F.lower(F.col(word)).alias("word")).filter(F.col(lang).isNotNull()).filter("word is not null").distinct().collect())
    p = params

    t = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("raw"))
    t = t.withColumn("text", F.coalesce("raw", F.lit("")))
    t = t.withColumn("w", F.filter(F.split("text", _SEP + "+"), lambda x: x != ""))
    t = t.withColumn("bare", F.transform("w", lambda x: F.btrim(F.lower(x), F.lit(WORD_EDGES))))
    t = t.withColumn("lines_", F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{_one_of(SEPARATORS)}]")))
    t = t.withColumn("hits", F.filter("bare", lambda x: x.isin(every)) if every else F.array().cast("array<string>"))
    t = t.select(
        "doc_id",
        "hits",
        F.size("w").alias("words"),
        F.length(F.regexp_replace("text", _SEP, "")).alias("word_chars"),
        _count(F.col("text"), _one_of(SYMBOLS)).alias("symbols"),
        F.size("lines_").alias("lines"),
        F.size(F.filter("lines_", lambda x: x.rlike(f"[{_one_of(SENTENCE_ENDS)}]{_SEP}*\\z"))).alias("ended_lines"),
        F.size("hits").alias("common_words"),
        _count(F.col("text"), r"\p{L}\p{M}").alias("c_letters"),
        _count(F.col("text"), r"\p{N}").alias("c_digits"),
        _count(F.col("text"), _one_of(SENTENCE_ENDS)).alias("c_ends"),
        F.length("text").cast("long").alias("chars"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    t = t.select(
        "*",
        ratio("word_chars", "words").alias("mean_word_length"),
        ratio("symbols", "word_chars").alias("symbol_share"),
        ratio("ended_lines", "lines").alias("line_end_share"),
        ratio("common_words", "words").alias("common_share"),
        F.col("symbols").alias("c_symbols"),
        F.col("ended_lines").alias("l_ended"),
        (F.col("lines") - F.col("ended_lines")).alias("l_open"),
        F.greatest(F.col("chars") - F.col("c_letters") - F.col("c_digits") - F.col("c_ends") - F.col("symbols"), F.lit(0)).alias("c_other"),
    )
    holds = lambda c: F.coalesce(c, F.lit(False))
    return t.select(
        "*",
        (F.col("words") < p.min_words).alias("few_words"),
        holds((F.col("mean_word_length") < p.min_word_length) | (F.col("mean_word_length") > p.max_word_length)).alias("odd_word_length"),
        holds(F.col("symbol_share") > p.max_symbols).alias("many_symbols"),
        ((F.col("lines") >= p.min_lines) & holds(F.col("line_end_share") < p.min_line_ends)).alias("open_lines"),
        holds(F.col("common_share") < p.min_common).alias("few_common"),
    )


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of every row of ``p`` from every row of ``q``."""
    a, b = p[:, None, :], q[None, :, :]
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0.0).sum(2)
        return (part(a) + part(b)) / 2


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1.0)


@dataclass(frozen=True)
class Profiles:
    """``names``, and of each the distributions over words (the last place is for all other words), classes and lines."""

    names: list[str]
    vocabulary: list[str]
    words: np.ndarray
    classes: np.ndarray
    lines: np.ndarray

    @staticmethod
    def prototypes(listed: dict[str, list[str]]) -> Profiles:
        vocabulary = sorted({w for words in listed.values() for w in words})
        at = {w: k for k, w in enumerate(vocabulary)}
        kinds = [(f"prose:{lang}", "prose", words) for lang, words in sorted(listed.items())] or [("prose", "prose", [])]
        kinds += [(kind, kind, vocabulary) for kind in ("junk", "list", "table")]
        kinds.sort()
        shares = np.zeros((len(kinds), len(vocabulary) + 1))
        for row, (_, kind, words) in zip(shares, kinds, strict=True):
            known = PROTOTYPES[kind][2] if words else 0.0
            row[[at[w] for w in words]] = known / max(len(words), 1)
            row[-1] = 1.0 - known
        return Profiles([n for n, _, _ in kinds], vocabulary, shares, np.array([PROTOTYPES[k][0] for _, k, _ in kinds]), np.array([PROTOTYPES[k][1] for _, k, _ in kinds]))

    def mixed(self, means: dict[int, tuple[float, np.ndarray]], weight: float) -> Profiles:
        """Profiles after a round: the mean of their documents, in which the profile itself counts as ``weight`` documents."""
        whole = np.concatenate([self.words, self.classes, self.lines], axis=1)
        for k, (n, sums) in means.items():
            whole[k] = np.round((whole[k] * weight + sums) / (weight + n), 9)
        v, c = self.words.shape[1], self.classes.shape[1]
        return Profiles(self.names, self.vocabulary, whole[:, :v], whole[:, v : v + c], whole[:, v + c :])

    def word_divergence(self, doc: np.ndarray, word: np.ndarray, share: np.ndarray, docs: int) -> np.ndarray:
        """Divergence of sparse word shares (sorted by document) from every profile: words that a text lacks add half their share."""
        q = self.words[:, word].T
        p = share[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            met = p * np.log2(2 * p / (p + q)) + np.where(q > 0, q * np.log2(2 * q / (p + q)), 0.0) - q
        out = np.zeros((docs, len(self.names)))
        np.add.at(out, doc, met)
        return (out + 1.0) / 2


_C, _L = [f"c_{c}" for c in CLASSES], [f"l_{c}" for c in LINES]


def _read(batch: pa.RecordBatch, profiles: Profiles):
    """The three distributions of a batch of statistics, those of words as sparse (document, word, share), and the divergences."""
    counts = lambda columns: np.column_stack([np.asarray(batch.column(c).cast(pa.float64())) for c in columns])
    # one line of each kind is added, so that a single line says little
    c, lines = _shares(counts(_C)), _shares(counts(_L) + 1.0)
    hits = batch.column("hits")
    per = np.diff(np.asarray(hits.offsets)) if len(hits) else np.zeros(0, int)
    place = np.asarray(pc.index_in(hits.flatten(), value_set=pa.array(profiles.vocabulary, pa.string())).fill_null(len(profiles.vocabulary)))
    width = len(profiles.vocabulary) + 1
    total = np.maximum(np.asarray(batch.column("words").cast(pa.float64())), 1.0)
    code, n = np.unique(np.repeat(np.arange(len(per)), per) * width + place, return_counts=True)
    other = np.maximum(total - per, 0.0)
    rest = np.flatnonzero(other > 0)
    code, n = np.concatenate([code, rest * width + width - 1]), np.concatenate([n, other[rest]])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    doc, word = code // width, code % width
    share = n / total[doc]
    d = profiles.word_divergence(doc, word, share, len(per)) + divergence(c, profiles.classes) + divergence(lines, profiles.lines)
    return (doc, word, share), c, lines, np.round(d, 6)


def _summed(profiles: Profiles):
    """Per task, profile and place of its distributions: the sum over the documents that are nearest to the profile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = len(profiles.vocabulary) + 1
        sums = np.zeros((len(profiles.names), 1 + v + len(CLASSES) + len(LINES)))
        for batch in batches:
            if not batch.num_rows:
                continue
            (doc, word, share), c, lines, d = _read(batch, profiles)
            best = d.argmin(1)
            np.add.at(sums[:, 0], best, 1.0)
            np.add.at(sums, (best[doc], 1 + word), share)
            np.add.at(sums[:, 1 + v :], best, np.concatenate([c, lines], axis=1))
        kind, place = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(place), pa.array(sums[kind, place])], ["kind", "place", "total"])

    return run


def _judge(profiles: Profiles, kept: list[str]):
    """Adds the nearest profile to batches of statistics."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(profiles.names)
        for batch in batches:
            if not batch.num_rows:
                continue
            empty = np.asarray(batch.column("chars").cast(pa.int64())) == 0
            _, _, _, d = _read(batch, profiles)
            best = d.argmin(1)
            profile = np.where(empty, "junk", names[best])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(profile, pa.string()), pa.array(d[np.arange(len(d)), best], mask=empty)], [*kept, "profile", "divergence"])

    return judge


def fit_profiles(stats: DataFrame, common: DataFrame, lang: str = "lang", word: str = "word", params: QualityParams = QualityParams()) -> Profiles:
    """Profiles fitted to all texts of written statistics. One sum per profile and place of its distributions comes to the driver."""
    listed: dict[str, list[str]] = {}
    for r in sorted(common.select(F.col(lang).alias("lang"), F.lower(F.col(word)).alias("word")).filter("lang is not null and word is not null").distinct().collect()):
        listed.setdefault(r.lang, []).append(r.word)
    profiles = Profiles.prototypes(listed)
    width = len(profiles.vocabulary) + 1 + len(CLASSES) + len(LINES)
    used = stats.filter("chars > 0").select("hits", "words", *_C, *_L)
    for _ in range(params.fit_rounds):
        sums = used.mapInArrow(_summed(profiles), "kind long, place long, total double").groupBy("kind", "place").agg(F.sum("total").alias("total")).collect()
        means: dict[int, tuple[float, np.ndarray]] = {}
        for kind in sorted({r.kind for r in sums}):
            row = np.zeros(width + 1)
            for r in sums:
                if r.kind == kind:
                    row[r.place] = r.total
            means[kind] = (row[0], row[1:])
        profiles = profiles.mixed(means, params.prototype_weight)
    return profiles


def quality(df: DataFrame, key: str, text: str, common: DataFrame, lang: str = "lang", word: str = "word", params: QualityParams = QualityParams()) -> DataFrame:
    """:func:`text_statistics` with ``not_prose``, ``profile`` and ``divergence``.

    ``not_prose``: at least one rule holds. ``profile``: the nearest of prose:<language>, list, table and junk,
    smaller name first at equal divergence; texts without characters are junk with divergence NULL. The two are found
    independently and may differ: the rules are thresholds, the profile is the nearest shape. Without common words
    there is one prose profile, named prose.
    """
    stats = text_statistics(df, key, text, common, lang, word, params)
    any_rule = F.col("few_words") | F.col("odd_word_length") | F.col("many_symbols") | F.col("open_lines") | F.col("few_common")
    # the texts are read once; what is written is numbers and the common words of each text
    stats = materialise(stats.withColumn("not_prose", any_rule), "quality")
    profiles = fit_profiles(stats, common, lang, word, params)
    kept = ["doc_id", "words", "mean_word_length", "symbol_share", "lines", "line_end_share", "common_share", "few_words", "odd_word_length", "many_symbols", "open_lines", "few_common", "not_prose"]
    kinds = dict(stats.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", profile string, divergence double"
    return stats.select(*kept, "chars", "hits", *_C, *_L).mapInArrow(_judge(profiles, kept), schema)
