"""The most similar vectors of every vector, by additive quantisation.

A vector is the sum of one word from each of several codebooks; all codebooks hold full-dimensional words
and each is trained on what the ones before it left over. Vectors are encoded by a beam search over the
codebooks; the norm of the decoded sum is stored. The first codebook also splits the index into cells.
A query looks into the cells of its nearest first words, scores their rows by adding up table entries
(query . word), divides by the stored norm, and reranks the best of them with exact double-precision
cosines.

Codebooks are trained on a bounded sample (``train_rows``); every row is encoded and indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.operators.keyed import latest, lookup_join
from skyweave.session import materialise


@dataclass(frozen=True)
class IndexParams:
    """``cells`` None: one cell for about ``cell_rows`` rows, at least 8.

    Up to ``max_first`` cells the words of the first codebook are the cells. For more, a cell is a pair of the first two words, and
    both codebooks grow with the square root of the cells: a cell keeps about ``cell_rows`` rows, and a query finds its
    cells among two short lists. The sample that codebooks are trained on has ``train_rows`` rows, or
    ``cell_train_rows`` per word of the first codebook if that is more: at most ``max_first * cell_train_rows`` until the cells
    exceed ``max_first`` squared.
    """

    dim: int
    cells: int | None = None
    cell_rows: int = 300
    max_first: int = 16_384
    books: int = 6
    words: int = 64
    beam: int = 4
    probes: int = 16
    rerank: int = 64
    train_rows: int = 32_768
    cell_train_rows: int = 8
    train_rounds: int = 8
    block_rows: int = 4096
    seed: int = 7


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distance to every word, without the constant |x|^2."""
    return (words**2).sum(1)[None, :] - 2.0 * (x @ words.T)


def _slices(rows: int, words: int, most: int) -> Iterator[slice]:
    """Slices of at most ``most`` rows whose distances to all words take at most 64 MB."""
    step = max(64, min(most, (1 << 24) // max(words, 1)))
    return (slice(i, i + step) for i in range(0, rows, step))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        owner = np.concatenate([_nearest(x[i], centres).argmin(1) for i in _slices(len(x), k, 8192)])
        total = np.zeros_like(centres)
        np.add.at(total, owner, x)
        size = np.bincount(owner, minlength=k)
        filled = size > 0
        centres[filled] = total[filled] / size[filled, None]
        if not filled.all():
            centres[~filled] = x[rng.choice(len(x), int((~filled).sum()))]
    return centres


@dataclass(frozen=True)
class Codebooks:
    """``coarse`` is the first codebook; ``books`` are those of the residuals. ``levels`` of them (1 or 2) name the cells."""

    coarse: np.ndarray
    books: list[np.ndarray]
    levels: int = 1

    def cell(self, codes: np.ndarray) -> np.ndarray:
        first = codes[:, 0].astype(np.int64)
        return first if self.levels == 1 else first * len(self.books[0]) + codes[:, 1]

    def word_sums(self, cell: int) -> np.ndarray:
        """The part of a vector that its cell says."""
        if self.levels == 1:
            return self.coarse[cell]
        return self.coarse[cell // len(self.books[0])] + self.books[0][cell % len(self.books[0])]

    def nearest_cells(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The cells whose words are nearest to every vector.

        Of two levels, the nearest first words are taken, twice the root of ``probes`` of them, with all second words each.
        """
        if self.levels == 1:
            d = _nearest(x, self.coarse)
            width = min(probes, d.shape[1])
            return np.argpartition(d, width - 1, axis=1)[:, :width] if width < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(x), 1))
        codes, residual = self.start(x, 2 * int(np.ceil(np.sqrt(probes))))
        codes, _ = self.extend(codes, residual, self.books[0], probes)
        return codes[:, :, 0].astype(np.int64) * len(self.books[0]) + codes[:, :, 1]

    def start(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest first words of every vector, and what they leave over."""
        d = _nearest(x, self.coarse)
        width = min(beam, len(self.coarse))
        first = np.argpartition(d, width - 1, axis=1)[:, :width] if width < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(x), 1))
        return first[:, :, None].astype(np.int32), x[:, None, :] - self.coarse[first]

    @staticmethod
    def extend(codes: np.ndarray, residual: np.ndarray, book: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best partial sums of every vector with one more word."""
        n = len(codes)
        norm = (residual**2).sum(2)
        cost = norm[:, :, None] + ((book**2).sum(1)[None, None, :] - 2.0 * np.einsum("nbd,kd->nbk", residual, book, optimize=True))
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(flat.shape[1]), (n, 1))
        parent, word = best // len(book), best % len(book)
        row = np.arange(n)[:, None]
        return np.concatenate([codes[row, parent], word[:, :, None].astype(np.int32)], axis=2), residual[row, parent] - book[word]

    def encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        """Codes by beam search: after each codebook the ``beam`` best partial sums of a vector go on."""
        codes, residual = self.start(x, beam)
        for book in self.books:
            codes, residual = self.extend(codes, residual, book, beam)
        return codes[np.arange(len(x)), (residual**2).sum(2).argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = self.coarse[codes[:, 0]].copy()
        for m, book in enumerate(self.books):
            out += book[codes[:, m + 1]]
        return out


def shape(cells: int, p: IndexParams) -> tuple[int, int]:
    """Words of the first codebook, and levels of the cells."""
    return (cells, 1) if cells <= p.max_first else (int(np.ceil(np.sqrt(cells))), 2)


def train(sample: np.ndarray, cells: int, p: IndexParams) -> Codebooks:
    """Codebooks from unit vectors, each trained on the residuals of the ones before it."""
    rng = np.random.default_rng(p.seed)
    x = sample.astype(np.float32)
    first, levels = shape(cells, p)
    coarse = _kmeans(x, first, p.train_rounds, rng)
    made = Codebooks(coarse, [])
    # the beams of the sample are carried from codebook to codebook
    beams = [made.start(x[i], p.beam) for i in _slices(len(x), len(coarse), 4096)]
    books: list[np.ndarray] = []
    for m in range(p.books):
        left = np.concatenate([r[np.arange(len(r)), (r**2).sum(2).argmin(1)] for _, r in beams])
        books = [*books, _kmeans(left, first if m == 0 and levels == 2 else p.words, p.train_rounds, rng)]
        if len(books) < p.books:
            beams = [made.extend(codes, residual, books[-1], p.beam) for codes, residual in beams]
    return Codebooks(coarse, books, levels)


def _matrix(column: pa.Array, dim: int, kind: str = "<f4") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x**2).sum(1))[:, None]


def valid_vectors(df: DataFrame, key: str, vector: str, dim: int, at: str | None = None) -> DataFrame:
    """``id, vec``: the vectors of ``dim`` finite values, not all zero, packed as little-endian float32.

    Of several rows with one key the latest by ``at`` counts (without ``at`` the keys must be distinct or
    the rows equal). Rows without a key are left out. Whole vectors are checked, in the tasks.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), *([F.col(at).alias("at")] if at else [])).filter("id is not null")
    rows = latest(rows, ["id"], "at") if at else rows.dropDuplicates(["id"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            lengths = np.diff(np.asarray(vectors.offsets)) if len(vectors) else np.zeros(0, int)
            right = (lengths == dim) & ~np.asarray(vectors.is_null())
            if not right.any():
                continue
            chosen = vectors.filter(pa.array(right))
            x = np.asarray(chosen.flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
            with np.errstate(over="ignore"):
                x = x.astype("<f4")
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(right)).filter(pa.array(good)), _binary(x[good])], ["id", "vec"])

    return rows.select("id", "v").mapInArrow(pack, "id long, vec binary")


def _fit(vectors: DataFrame, rows: int, p: IndexParams) -> Codebooks:
    cells = p.cells or max(8, rows // p.cell_rows)
    most = max(p.train_rows, p.cell_train_rows * shape(cells, p)[0])
    share = min(1.0, most / max(rows, 1))
    sampled = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) <= F.lit(int(share * 1_000_003))) if share < 1 else vectors
    taken = sampled.orderBy(F.xxhash64("id")).limit(most).select("vec").toArrow()
    x = _unit(_matrix(taken.column("vec").combine_chunks(), p.dim))
    return train(x, cells, p)


def _search_block(p: IndexParams, model: Broadcast, top: int):
    names = ["query", "id", "sim"]

    def search(key: tuple, db: pa.Table, queries: pa.Table) -> pa.Table:
        if not db.num_rows or not queries.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        c: Codebooks = model.value
        said = c.word_sums(key[0].as_py())
        rest = list(enumerate(c.books))[c.levels - 1 :]  # the words that the cell does not name
        ids = np.asarray(db.column("id"))
        codes = _matrix(db.column("codes").combine_chunks(), len(c.books) + 1, "<i4")
        norms = np.asarray(db.column("norm"))
        x = _unit(_matrix(db.column("vec").combine_chunks(), p.dim))
        asked = np.asarray(queries.column("id"))
        q = _unit(_matrix(queries.column("vec").combine_chunks(), p.dim))
        keep = min(max(p.rerank, top), len(ids))
        found: list[list[np.ndarray]] = [[], [], []]
        for i in range(0, len(asked), 512):
            part = q[i : i + 512]
            small = part.astype(np.float32)
            score = np.repeat((small @ said)[:, None], len(ids), axis=1)
            for m, book in rest:
                score += np.take(small @ book.T, codes[:, m + 1], axis=1)
            score /= norms[None, :]
            best = np.argpartition(-score, keep - 1, axis=1)[:, :keep] if keep < len(ids) else np.tile(np.arange(len(ids)), (len(part), 1))
            sim = np.round(np.einsum("qd,qkd->qk", part, x[best]), 6)
            order = np.lexsort((ids[best], -sim), axis=1)[:, :top]
            found[0].append(np.repeat(asked[i : i + 512], order.shape[1]))
            found[1].append(np.take_along_axis(ids[best], order, 1).ravel())
            found[2].append(np.take_along_axis(sim, order, 1).ravel())
        return pa.table(dict(zip(names, [np.concatenate(f) for f in found], strict=True)))

    return search


def most_similar(df: DataFrame, key: str, vector: str, k: int, params: IndexParams, *, at: str | None = None, min_sim: float | None = None, queries: str | None = None) -> DataFrame:
    """The ``k`` most similar others of every vector: ``id, other, sim, rank``.

    ``sim`` is the cosine in double precision rounded to 6 decimals; equal ones go by smaller id. Which
    rows are compared is up to the index (see :class:`IndexParams` for the trade between recall and work);
    every similarity returned is exact. ``queries`` is a SQL condition on ``id`` that picks the rows which
    ask (default: all); all rows answer. ``min_sim`` leaves out less similar ones after ranking.

    Equal vectors are searched once: the k+1 smallest ids of each distinct vector stand in the index, which
    is all that any top-k list can hold. Vectors of another length, with a value missing or not finite, or
    all zero, take no part; see :func:`valid_vectors`. Fewer than two valid vectors give an empty result.
    """
    spark = df.sparkSession
    vectors = materialise(valid_vectors(df, key, vector, params.dim, at), "vectors-valid")
    rows = vectors.count()
    if rows < 2:
        return spark.createDataFrame([], "id long, other long, sim double, rank int")
    same = Window.partitionBy("vec").orderBy("id")
    index = vectors.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k + 1).withColumn("rep", F.first("id").over(same))
    index = materialise(index, "vectors-index")
    fitted = _fit(vectors, rows, params)
    fitted = Codebooks(fitted.coarse.astype(np.float32), [b.astype(np.float32) for b in fitted.books], fitted.levels)
    model = spark.sparkContext.broadcast(fitted)  # its words grow with the square root of the rows, once there are many

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Codebooks = model.value
        for batch in batches:
            for i in _slices(batch.num_rows, len(c.coarse), 1024):
                part = batch.slice(i.start, i.stop - i.start)
                x = _unit(_matrix(part.column(1), params.dim)).astype(np.float32)
                codes = c.encode(x, params.beam)
                norm = np.sqrt((c.decode(codes) ** 2).sum(1)).clip(1e-6)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(c.cell(codes)), _binary(codes.astype("<i4")), pa.array(norm.astype(np.float32))],
                    ["id", "vec", "cell", "codes", "norm"],
                )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Codebooks = model.value
        for batch in batches:
            for i in _slices(batch.num_rows, len(c.coarse) if c.levels == 1 else 2 * params.probes * len(c.books[0]), 1024):
                part = batch.slice(i.start, i.stop - i.start)
                near = c.nearest_cells(_unit(_matrix(part.column(1), params.dim)).astype(np.float32), params.probes)
                rep = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rep), part.column(1).take(rep), pa.array(near.ravel().astype(np.int64))], ["id", "vec", "cell"])

    asking = index.filter("copy = 1") if queries is None else index.filter("copy = 1").join(
        vectors.filter(queries).join(index.select("vec", "rep"), "vec").select(F.col("rep").alias("id")).distinct(), "id", "left_semi"
    )
    coded = materialise(index.select("id", "vec").mapInArrow(encode, "id long, vec binary, cell long, codes binary, norm float"), "vectors-coded")
    asked = asking.select("id", "vec").mapInArrow(probe, "id long, vec binary, cell long")
    # a cell of many rows is cut into blocks; every block is searched by all queries of the cell
    held = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(params.block_rows)).cast("int").alias("db_blocks"))
    wanted = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * params.block_rows)).cast("int").alias("q_blocks"))
    # one row per cell that is asked for, met by a shuffle as cells grow with the rows
    sizes = materialise(held.join(wanted, "cell"), "vectors-cells")
    db_side = coded.join(sizes, "cell").withColumn("db", F.pmod(F.xxhash64("id"), F.col("db_blocks")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
    q_side = asked.join(sizes, "cell").withColumn("qb", F.pmod(F.xxhash64("id"), F.col("q_blocks")).cast("int")).withColumn("db", F.explode(F.sequence(F.lit(0), F.col("db_blocks") - 1)))
    found = (
        db_side.select("cell", "db", "qb", "id", "vec", "codes", "norm")
        .groupBy("cell", "db", "qb")
        .cogroup(q_side.select("cell", "db", "qb", "id", "vec").groupBy("cell", "db", "qb"))
        .applyInArrow(_search_block(params, model, k + 1), "query long, id long, sim double")
    )
    best = Window.partitionBy("query").orderBy(F.col("sim").desc(), "id")
    lists = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select(F.col("query").alias("rep"), F.col("id").alias("other"), "sim")
    lists = materialise(lists, "vectors-lists")
    members = index.select("id", "rep")
    extra = vectors.join(index.select("id"), "id", "left_anti")
    extra = lookup_join(extra, index.filter("copy = 1").select("vec", "rep"), "vec", "inner").select("id", "rep")
    members = members.unionByName(extra)
    if queries is not None:
        members = members.filter(queries)
    gathered = lists.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("o"), F.col("other").alias("other")))).alias("near"))  # k+1 entries
    out = lookup_join(members, gathered, "rep", "inner")
    others = F.slice(F.filter("near", lambda e: e["other"] != F.col("id")), 1, k)
    out = out.select("id", F.posexplode(others).alias("p", "e")).select("id", F.col("e.other").alias("other"), (-F.col("e.o")).alias("sim"), (F.col("p") + 1).alias("rank"))
    return out if min_sim is None else out.filter(F.col("sim") >= min_sim)


def brute_force(vectors: DataFrame, k: int, dim: int, queries: str) -> DataFrame:
    """Exact lists of the rows that meet ``queries``, in blocks against all rows; for measuring recall.

    ``vectors`` is what :func:`valid_vectors` returns. The queries are sent to the tasks in blocks of
    2,000; each task scores its own rows and returns k per query.
    """
    spark = vectors.sparkSession
    asked = vectors.filter(queries).orderBy("id")
    total = None
    pieces = asked.withColumn("piece", F.floor((F.row_number().over(Window.orderBy("id")) - 1) / 2000))
    for piece in range((asked.count() + 1999) // 2000):
        block = pieces.filter(F.col("piece") == piece).select("id", "vec").toArrow()
        sent = spark.sparkContext.broadcast((np.asarray(block.column("id")), _unit(_matrix(block.column("vec").combine_chunks(), dim))))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, q = sent.value
            for batch in batches:
                ids = np.asarray(batch.column(0))
                sim = np.round(q @ _unit(_matrix(batch.column(1), dim)).T, 6)
                sim[qid[:, None] == ids[None, :]] = -2
                order = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :k]
                got = np.take_along_axis(sim, order, 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, order.shape[1])), pa.array(ids[order].ravel()), pa.array(got.ravel())], ["id", "other", "sim"])

        part = vectors.mapInArrow(score, "id long, other long, sim double").filter("sim > -2")
        total = part if total is None else total.unionByName(part)
    if total is None:
        return spark.createDataFrame([], "id long, other long, sim double, rank int")
    w = Window.partitionBy("id").orderBy(F.col("sim").desc(), "other")
    return total.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
