"""Top N items within every group, by merging sorted runs with a loser tree.

1. Every partition of the input is sorted by (group, score, ties): one *run*. A run keeps at most N rows
   of a group, whatever the group's size, so a group with a third of all rows leaves N rows per run.
2. The runs are stored in the shared folder with a bucket number per group.
3. Every bucket merges its runs with a tournament tree of losers. After N outputs of a group each run
   is advanced to its next group instead of being read through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.session import materialise, shuffle_width

#: Rows of cut runs that one bucket holds on average; a merging task holds one bucket at a time.
BUCKET_ROWS = 200_000


class LoserTree:
    """Tournament over the heads of sorted runs; every inner node keeps the loser of its match.

    ``keys[r]`` is the sorted sequence of keys of run r. ``None`` marks a run that is used up.
    """

    def __init__(self, keys: Sequence[Sequence]):
        self.keys = keys
        self.at = [0] * len(keys)
        self.width = 1
        while self.width < len(keys):
            self.width *= 2
        self.head = [k[0] if len(k) else None for k in keys] + [None] * (self.width - len(keys))
        self.losers = [0] * self.width
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.width:
            return node - self.width
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (b, a) if self._beats(b, a) else (a, b)
        self.losers[node] = lost
        return won

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or x < y)

    def advance(self, to: int) -> None:
        """Move the winner's run to position ``to`` and replay its matches up to the root."""
        run = self.winner
        keys, head = self.keys[run], self.head
        self.at[run] = to
        mine = head[run] = keys[to] if to < len(keys) else None
        node = (run + self.width) // 2
        losers = self.losers
        while node:
            other = losers[node]
            theirs = head[other]
            if theirs is not None and (mine is None or theirs < mine):
                losers[node] = run
                run, mine = other, theirs
            node //= 2
        self.winner = run


def _changes(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before it; NULL equals NULL."""
    if len(column) < 2:
        return np.zeros(0, bool)
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    different = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(different, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _cutter(n: int):
    """Keeps the first n rows of every group of a sorted run, batch by batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0)
            starts = np.concatenate([[True], _changes(group)])
            first = np.flatnonzero(starts)
            place = np.arange(batch.num_rows) - np.repeat(first, np.diff(np.append(first, batch.num_rows)))
            goes_on = last is not None and group[0].as_py() == last[0]
            if goes_on:
                end = first[1] if len(first) > 1 else batch.num_rows
                place[:end] += seen
            last, seen = (group[-1].as_py(),), int(place[-1]) + 1
            yield batch.filter(pa.array(place < n))

    return cut


class _Keys:
    """The sort keys of one run of a bucket, made when they are asked for: after N outputs of a group the rest of it needs none."""

    def __init__(self, columns: list[list], first: int, end: int):
        self.columns, self.first, self.end = columns, first, end

    def __len__(self) -> int:
        return self.end - self.first

    def __getitem__(self, k: int) -> tuple:
        return tuple([c[self.first + k] for c in self.columns])


def _orderable(columns: list[pa.ChunkedArray], descending: int) -> list[list]:
    """Lists whose rows compare as the run is sorted: group NULL first, score descending with missing last, ties ascending with NULL last.

    Scores keep their type: whole numbers and decimals are negated exactly.
    """
    parts: list[list] = []
    for k, column in enumerate(columns):
        values = column.to_pylist()
        if column.null_count:
            known = next((v for v in values if v is not None), 0)
            parts.append([(v is None) != (k < descending) for v in values])
            values = [known if v is None else v for v in values]
        parts.append([-v for v in values] if k == descending else values)
    return parts


def _merger(n: int, ties: int):
    """Merges the runs of each bucket; the rows come sorted by (bucket, run, group, score, ties)."""

    def one_bucket(table: pa.Table) -> pa.RecordBatch | None:
        table = table.combine_chunks()
        run = np.asarray(table.column("run"))
        bounds = np.flatnonzero(np.diff(run)) + 1
        bounds = [0, *bounds.tolist(), table.num_rows]
        group = table.column("g").combine_chunks()
        group = group.chunk(0) if isinstance(group, pa.ChunkedArray) else group
        changed = np.concatenate([[True], _changes(group)])
        changed[bounds[:-1]] = True
        # the row at which the next group of the same run begins
        starts = np.append(np.flatnonzero(changed), table.num_rows)
        following = np.repeat(starts[1:], np.diff(starts)).tolist()
        keys = _orderable([table.column(c) for c in ("g", "s", *[f"t{i}" for i in range(ties)])], descending=1)
        ids = _group_numbers(group)
        tree = LoserTree([_Keys(keys, a, b) for a, b in zip(bounds, bounds[1:], strict=False)])
        taken, ranks = [], []
        current, given = -1, 0
        while tree.head[tree.winner] is not None:
            run = tree.winner
            row = bounds[run] + tree.at[run]
            if ids[row] != current:
                current, given = ids[row], 0
            if given < n:
                given += 1
                taken.append(row)
                ranks.append(given)
                tree.advance(tree.at[run] + 1)
            else:
                tree.advance(following[row] - bounds[run])
        out = table.select(["g", "s", *[f"t{i}" for i in range(ties)]]).take(pa.array(taken, pa.int64()))
        return out.append_column("rank", pa.array(ranks, pa.int32())).combine_chunks()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bucket = None

        def close():
            if held:
                yield from one_bucket(pa.Table.from_batches(held)).to_batches()

        for batch in batches:
            while batch.num_rows:
                mine = batch.column(0)[0].as_py()
                if bucket is not None and mine != bucket:
                    yield from close()
                    held = []
                bucket = mine
                upto = int(np.searchsorted(np.asarray(batch.column(0)), mine, side="right"))
                held.append(batch.slice(0, upto))
                batch = batch.slice(upto)
        yield from close()

    return merge


def _group_numbers(group: pa.Array) -> list[int]:
    """A number for every distinct group of a bucket (NULL has its own)."""
    return pc.fill_null(group.dictionary_encode().indices, -2).to_pylist()


def top_n_per_group(df: DataFrame, group: str, score: str, ties: Sequence[str], n: int, *, buckets: int | None = None, keep_missing: bool = True) -> DataFrame:
    """The ``n`` rows with the highest ``score`` of every ``group``.

    Returns ``group, score, *ties, rank`` (rank from 1), with the names and types of the input; other
    columns of ``df``, whatever their names, are left out.

    * equal scores: smaller values of ``ties`` first, NULL last; rows equal in everything are both kept;
    * a missing score (NULL or NaN) ranks last, or is left out with ``keep_missing=False``;
    * scores are numbers of any type and are compared in it: neighbours above 2^53 and decimals stay apart;
    * NULL is a group of its own; an empty input gives an empty result.

    ``buckets`` is the number of groups' buckets; by default it follows the rows of the cut runs, BUCKET_ROWS each, and
    is at least the session's shuffle partitions. A task merges one bucket at a time, so its memory does not grow
    with the input; a single group has at most N rows per run.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    spark = df.sparkSession
    kind = df.schema[score].dataType
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"{score} is not a number")
    names = [f"t{i}" for i in range(len(ties))]
    rows = df.select(F.col(group).alias("g"), F.col(score).alias("s"), *[F.col(c).alias(x) for c, x in zip(ties, names, strict=True)])
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        rows = rows.withColumn("s", F.when(~F.isnan("s"), F.col("s")))
    if not keep_missing:
        rows = rows.filter(F.col("s").isNotNull())
    order = [F.col("g").asc_nulls_first(), F.col("s").desc_nulls_last(), *[F.col(x).asc_nulls_last() for x in names]]
    runs = rows.sortWithinPartitions(*order).mapInArrow(_cutter(n), rows.schema)
    runs = materialise(runs.select(F.xxhash64("g").alias("bucket"), F.spark_partition_id().alias("run"), "*"), "topn-runs")
    buckets = buckets or max(shuffle_width(spark), -(-runs.count() // BUCKET_ROWS))
    merged_schema = T.StructType([*rows.schema.fields, T.StructField("rank", T.IntegerType())])
    merged = (
        runs.withColumn("bucket", F.pmod("bucket", F.lit(buckets)).cast("int"))
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", "run", *order)
        .mapInArrow(_merger(n, len(ties)), merged_schema)
    )
    return merged.select(F.col("g").alias(group), F.col("s").alias(score), *[F.col(x).alias(c) for c, x in zip(ties, names, strict=True)], "rank")
