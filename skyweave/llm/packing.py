"""Filling fixed-capacity containers with a grouping genetic algorithm on islands.

The items are dealt by hash to shards of bounded size. Every shard is evolved on several islands; an
individual is a set of whole bins. Crossover injects well-filled bins of one parent into the other, removes
the bins that then hold an item twice, and puts their displaced items back by best fit, largest first. Between
epochs every island sends its elite to the next island of its shard, in a shuffle. The best individual of a shard wins; its
poorly filled bins are opened and their items packed once more together with those of the other shards.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.session import materialise

# Fixed value: the split pattern of the byte-level vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

@dataclass(frozen=True)
class GeneticParams:
    shard_items: int = 1500
    islands: int = 3
    population: int = 6
    epochs: int = 3
    generations: int = 6
    inject: float = 0.3
    reopen_below: float = 0.98
    seed: int = 11


_ENCODINGS: dict[tuple[str, str], object] = {}


def _encoding(file: str, pattern: str):
    """The tokenizer of a vocabulary file, read once per worker process."""
    import tiktoken

    key = (file, pattern)
    if key not in _ENCODINGS:
        with open(file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _ENCODINGS[key] = tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def token_counts(df: DataFrame, key: str, text: str, *, tokenizer: str = TOKENIZER, pattern: str = SPLIT_PATTERN) -> DataFrame:
    """``id, size``: tokens of every whole text in a public byte-level vocabulary; NULL has 0 tokens.

    Spark ships the vocabulary file, whatever its size, to the executors.
    """
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = tokenizer.rpartition("/")[2]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(SparkFiles.get(name), pattern)
        for batch in batches:
            sizes = [0 if not t else len(encoding.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["id", "size"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(count, "id long, size long")


class _Bins:
    """Open bins ordered by free space."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.free: list[tuple[int, int]] = []

    def adopt(self, items: list[int], load: int) -> None:
        bisect.insort(self.free, (self.capacity - load, len(self.items)))
        self.items.append(items)

    def best_fit(self, item: int, size: int) -> None:
        k = bisect.bisect_left(self.free, (size, -1))
        if k == len(self.free):
            self.adopt([item], size)
            return
        room, number = self.free.pop(k)
        self.items[number].append(item)
        bisect.insort(self.free, (room - size, number))

    def assignment(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int32)
        for number, items in enumerate(self.items):
            out[items] = number
        return out


def _pack(order, sizes: list[int], capacity: int) -> np.ndarray:
    bins = _Bins(capacity)
    for item in order:
        bins.best_fit(int(item), sizes[item])
    return bins.assignment(len(sizes))


def _loads(assigned: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(assigned, weights=sizes)


def fitness(assigned: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins: fewer and fuller bins are better."""
    return float(np.mean((_loads(assigned, sizes) / capacity) ** 2)) if len(assigned) else 1.0


def cross(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, share: float, rng: np.random.Generator) -> np.ndarray:
    """A child of ``a`` that takes whole bins from ``b``, the better filled the more likely."""
    loads = _loads(b, sizes)
    want = max(1, int(share * len(loads)))
    ranked = np.argsort(-loads + rng.random(len(loads)) * capacity * 0.1, kind="stable")
    injected = rng.choice(ranked[: max(want, (2 * len(ranked)) // 3)], want, replace=False)
    taken = np.isin(b, injected)
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[taken]] = True
    # one poorly filled bin of the first parent is opened as well, so that no child is a mere copy
    broken[int(np.argmin(_loads(a, sizes) + capacity * broken))] = True
    displaced = np.flatnonzero(broken[a] & ~taken)
    return _refill([(b, injected), (a, np.flatnonzero(~broken))], displaced, sizes, capacity)


def _exchange(items: list[int], room: int, waiting: list[tuple[int, int]], sizes: list[int]) -> int:
    """Swap one or two items of a bin for a larger waiting one that still fits; returns the room that is left.

    ``waiting`` holds (size, item) in order. The bin gets fuller, and what waits gets smaller and easier to place.
    """
    for out in [(k,) for k in range(len(items))] + [(j, k) for k in range(len(items)) for j in range(k)]:
        if not room or not waiting:
            break
        if out[-1] >= len(items):
            continue
        given = sum(sizes[items[k]] for k in out)
        at = bisect.bisect_right(waiting, (given + room, 1 << 62)) - 1
        if at >= 0 and waiting[at][0] > given:
            size, item = waiting.pop(at)
            room -= size - given
            for k in sorted(out, reverse=True):
                bisect.insort(waiting, (sizes[items[k]], items[k]))
                del items[k]
            items.append(item)
    return room


#: A bin of more items is not searched for exchanges: its room is filled by single items.
EXCHANGE_ITEMS = 12


def _refill(kept: list[tuple[np.ndarray, np.ndarray]], displaced: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    bins = _Bins(capacity)
    listed = sizes.tolist()
    waiting = sorted((listed[k], k) for k in displaced.tolist())
    for assigned, numbers in kept:
        wanted = np.isin(assigned, numbers)
        members = np.flatnonzero(wanted)
        members = members[np.argsort(assigned[members], kind="stable")]
        for group in np.split(members, np.flatnonzero(np.diff(assigned[members])) + 1) if len(members) else []:
            items = group.tolist()
            room = capacity - sum(listed[k] for k in items)
            if room and waiting and len(items) <= EXCHANGE_ITEMS:
                room = _exchange(items, room, waiting, listed)
            bins.adopt(items, capacity - room)
    for size, item in reversed(waiting):
        bins.best_fit(item, size)
    return bins.assignment(len(sizes))


def evolve(sizes: np.ndarray, people: list[np.ndarray], capacity: int, p: GeneticParams, seed: tuple[int, ...]) -> list[np.ndarray]:
    """Some generations on one island; the best individual comes first. Starts a population if there is none."""
    rng = np.random.default_rng(seed)
    listed = sizes.tolist()
    if not people:
        people = [_pack(np.argsort(-sizes, kind="stable"), listed, capacity)]
        while len(people) < p.population:
            people.append(_pack(np.argsort(-sizes * (0.6 + 0.8 * rng.random(len(sizes))), kind="stable"), listed, capacity))
    fewest = max(1, -(-int(sizes.sum()) // capacity))
    score = lambda x: fitness(x, sizes, capacity)
    scored = sorted(((score(x), k, x) for k, x in enumerate(people)), key=lambda s: (-s[0], s[1]))
    for _ in range(p.generations):
        if int(scored[0][2].max(initial=0)) + 1 <= fewest:
            break
        children = []
        for k in range(max(1, p.population // 2)):
            i, j = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
            child = cross(scored[i][2], scored[j][2], sizes, capacity, p.inject, rng)
            children.append((score(child), len(scored) + k, child))
        scored = sorted(scored + children, key=lambda s: (-s[0], s[1]))[: p.population]
    return [x for _, _, x in scored]


def _evolver(capacity: int, p: GeneticParams, epoch: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            people_out, elites, scores = [], [], []
            for shard, island, raw, people, migrant in zip(rows["shard"], rows["island"], rows["sizes"], rows["people"], rows["migrant"], strict=True):
                sizes = np.asarray(raw, np.int64)
                held = [np.frombuffer(x, np.int32) for x in people or []]
                if migrant is not None and held:
                    held = [*held[:-1], np.frombuffer(migrant, np.int32)] if len(held) > 1 else held
                found = evolve(sizes, held, capacity, p, (p.seed, level, epoch, shard, island))
                people_out.append([x.astype(np.int32).tobytes() for x in found])
                elites.append(people_out[-1][0])
                scores.append(fitness(found[0], sizes, capacity))
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("island"), batch.column("items"), batch.column("sizes"), pa.array(people_out, pa.list_(pa.binary())), pa.array(elites, pa.binary()), pa.array(scores, pa.float64())],
                ["shard", "island", "items", "sizes", "people", "elite", "score"],
            )

    return run


_ITEM = "id bigint, part int, parts int, whole bigint, copy bigint"
_STATE = f"shard int, island int, items array<struct<{_ITEM.replace(' ', ':').replace(',:', ', ')}>>, sizes array<bigint>, people array<binary>, elite binary, score double"
_NAMES = [c.split()[0] for c in _ITEM.split(", ")]


def _evolve_shards(items: DataFrame, shards: int, capacity: int, p: GeneticParams, level: int) -> DataFrame:
    """The columns of _ITEM with ``size, shard, bin``: the best individual of every shard."""
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("id", "whole", "copy", "part", F.lit(level)), F.lit(shards)).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct(*_NAMES, "size")))
    state = dealt.groupBy("shard").agg(listed.alias("l")).select(
        "shard",
        F.transform("l", lambda e: F.struct(*[e[c].alias(c) for c in _NAMES])).alias("items"),
        F.transform("l", lambda e: e["size"]).alias("sizes"),
        F.explode(F.sequence(F.lit(0), F.lit(p.islands - 1))).alias("island"),
    )
    state = state.select("shard", "island", "items", "sizes", F.lit(None).cast("array<binary>").alias("people"), F.lit(None).cast("binary").alias("migrant"))
    ring = Window.partitionBy("shard").orderBy("island")
    for epoch in range(p.epochs):
        # the islands of a shard are spread over the tasks
        state = state.repartition(F.col("shard"), F.col("island")).mapInArrow(_evolver(capacity, p, epoch, level), _STATE)
        migrant = F.coalesce(F.lag("elite").over(ring), F.last("elite").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        if epoch < p.epochs - 1:
            state = state.withColumn("migrant", migrant).select("shard", "island", "items", "sizes", "people", "migrant")
    best = state.groupBy("shard").agg(F.max_by(F.struct("items", "sizes", "elite"), F.struct("score", -F.col("island"))).alias("b")).select("shard", "b.*")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1)
            items, sizes = found.flatten(), batch.column(2)
            per = np.diff(np.asarray(found.offsets))
            bins = np.concatenate([np.frombuffer(x, np.int32) for x in batch.column(3).to_pylist()]) if len(found) else np.zeros(0, np.int32)
            columns = [items.field(items.type.get_field_index(c)) for c in _NAMES]
            yield pa.RecordBatch.from_arrays([*columns, sizes.flatten(), pa.array(np.repeat(np.asarray(batch.column(0)), per)), pa.array(bins)], [*_NAMES, "size", "shard", "bin"])

    return best.mapInArrow(unfold, f"{_ITEM}, size long, shard int, bin int")


def pack_items(items: DataFrame, key: str, size: str, capacity: int, params: GeneticParams = GeneticParams()) -> DataFrame:
    """The container of every item: ``id, whole, copy, part, parts, size, container``; ``whole`` is the item's size and ``size`` that of the part.

    No container holds more than ``capacity``. An item is split only if it alone is larger: into full containers of its own
    and a rest, numbered by ``part``, which is packed with the other items. ``parts`` is their number.
    Every row is an item: rows that share a key and a size, or have no key, are told apart by ``copy`` (0 for the first). A size
    that is NULL or negative counts as 0 and still gets a container. Empty input gives an empty result.
    ``container`` is unique over all containers.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    whole = items.select(F.col(key).cast("long").alias("id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("whole"))
    # equal rows are counted before they meet, so a key with many rows is no large group
    whole = whole.groupBy("id", "whole").agg(F.count(F.lit(1)).alias("n")).select("id", "whole", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    parts = F.greatest(F.ceil(F.col("whole") / F.lit(capacity)), F.lit(1)).cast("int")
    pieces = whole.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pieces = pieces.withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("part") * F.lit(capacity).cast("long")))
    pieces = materialise(pieces, "packing-items")
    full = pieces.filter((F.col("parts") > 1) & (F.col("size") == capacity))
    loose = pieces.filter((F.col("parts") == 1) | (F.col("size") < capacity))
    n = loose.count()
    p = params
    shards = max(1, -(-n // p.shard_items))
    first = materialise(_evolve_shards(loose, shards, capacity, p, 0), "packing-first")
    out = ["id", "whole", "copy", "part", "parts", "size"]
    name = lambda df, level: df.select(*out, F.concat_ws("-", F.lit(level), "shard", "bin").alias("container"))
    packed = name(first, "a")
    if shards > 1:
        loads = first.groupBy("shard", "bin").agg(F.sum("size").alias("load"))
        poor = loads.filter(F.col("load") < p.reopen_below * capacity)
        again = materialise(first.join(poor.select("shard", "bin"), ["shard", "bin"], "left_semi"), "packing-again")
        m = again.count()
        if m:
            second = materialise(_evolve_shards(again, max(1, -(-m // p.shard_items)), capacity, p, 1), "packing-second")
            kept = first.join(poor.select("shard", "bin"), ["shard", "bin"], "left_anti")
            packed = name(kept, "a").unionByName(name(second, "b"))
    return packed.unionByName(full.select(*out, F.concat_ws("-", F.lit("f"), F.coalesce(F.col("id").cast("string"), F.lit("none")), "whole", "copy", "part").alias("container")))


def pack_texts(df: DataFrame, key: str, text: str, capacity: int = 1024, *, tokenizer: str = TOKENIZER, params: GeneticParams = GeneticParams()) -> DataFrame:
    """:func:`pack_items` for whole texts, measured in tokens; a NULL or empty text has size 0."""
    return pack_items(token_counts(df, key, text, tokenizer=tokenizer), "id", "size", capacity, params)
