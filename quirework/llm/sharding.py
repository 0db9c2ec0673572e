"""Sharding by Karmarkar-Karp differencing: near equal bytes, equal texts together.

Differencing keeps partial partitions - the groups seen so far dealt to k subsets - and again and again
combines the two whose subsets differ most, heaviest subset with lightest.  Any order of combining gives a
partition, so it runs as a tree: small groups are differenced in cells of bounded size where they lie, each
cell giving k near equal *chips*; cells beyond ``supers`` are combined by the same rule; and the chips are
differenced once more on the driver together with everything that could upset the balance:

* groups above 1 / (64 k) of all bytes, and groups with very many copies (at most 64 k + 2000 of them),
* a hash-chosen set of about ``singles`` groups, whose single sizes fill the last gaps.

So the driver sees at most 64 k + 2000 + ~singles + k * supers weights, whatever the input.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

KEY = ["h", "size", "crc"]


def difference(partials: list[tuple[list[int], list]], k: int) -> tuple[list[int], list[list]]:
    """Combine partial partitions into one: (sums, items of each subset).

    A partial partition is (sums, items), up to k of each; items are whatever the caller deals out.
    """
    heap = []
    for n, (sums, items) in enumerate(partials):
        order = sorted(range(len(sums)), key=sums.__getitem__)
        pad = k - len(sums)
        s = [0] * pad + [sums[i] for i in order]
        t = [None] * pad + [items[i] for i in order]
        heap.append((s[0] - s[-1], n, s, t))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        d, _, b, y = heapq.heappop(heap)
        s = [p + q for p, q in zip(a, reversed(b), strict=True)]
        t = [p if q is None else q if p is None else (p, q) for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(k), key=s.__getitem__)
        s, t = [s[i] for i in order], [t[i] for i in order]
        heapq.heappush(heap, (s[0] - s[-1], n, s, t))
        n += 1
    if not heap:
        return [0] * k, [[] for _ in range(k)]
    return heap[0][2], [_flat(x) for x in heap[0][3]]


class Item:
    """A leaf of the combining tree."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value


def _flat(tree) -> list:
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += x
        elif x is not None:
            out.append(x.value)
    return out


def deal(weights: list[int], k: int) -> list[int]:
    """Subset of each weight (for weights that fit one process)."""
    _, subsets = difference([([w], [Item(i)]) for i, w in enumerate(weights)], k)
    place = [0] * len(weights)
    for j, s in enumerate(subsets):
        for i in s:
            place[i] = j
    return place


def _each_cell(batches, column: int):
    """Tables of the runs of equal values in ``column``, one after another, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        own = b.column(column).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
        for a, z in zip(edges, edges[1:], strict=False):
            if held and held[-1].column(column)[0].as_py() != own[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(df: DataFrame, cell: str, cells: int) -> DataFrame:
    """Rows by cell, many cells in a partition where there are more than the session's shuffle partitions, each cell's rows together."""
    parts = max(1, min(cells, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return df.repartitionById(parts, F.pmod(F.col(cell), F.lit(parts)).cast("int")).sortWithinPartitions(cell)


def _cells(small: DataFrame, k: int, cells: int) -> DataFrame:
    """h, size, crc, weight, cell, part: each cell's groups differenced into k parts; a task holds one cell at a time."""

    def run(batches):
        for t in _each_cell(batches, 4):
            part = np.array(deal(t.column("weight").to_pylist(), k), np.int32)
            yield from t.append_column("part", pa.array(part)).combine_chunks().to_batches(20_000)

    src = small.withColumn("cell", F.pmod(F.xxhash64(*KEY), F.lit(cells)).cast("int")).select(*KEY, "weight", "cell")
    return _dealt(src, "cell", cells).mapInArrow(run, "h long, size long, crc long, weight long, cell int, part int")


def _combined(chips: DataFrame, k: int, supers: int) -> DataFrame:
    """cell, part, super, joint: cells of one super-cell combined by differencing, super-cell after super-cell."""

    def run(batches):
        for t in _each_cell(batches, 3):
            by: dict[int, dict[int, int]] = {}
            for c, p, w in zip(*(t.column(n).to_pylist() for n in ("cell", "part", "weight")), strict=True):
                by.setdefault(c, {})[p] = w
            _, subsets = difference([(list(x.values()), [Item((c, p)) for p in x]) for c, x in sorted(by.items())], k)
            rows = [(c, p, c % supers, j) for j, s in enumerate(subsets) for c, p in s]
            for a in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in zip(*rows[a : a + 20_000], strict=True)], names=["cell", "part", "super", "joint"])

    src = chips.select("cell", "part", "weight", F.pmod("cell", F.lit(supers)).cast("int").alias("super"))
    return _dealt(src, "super", supers).mapInArrow(run, "cell int, part int, super int, joint int")


def shard(docs: DataFrame, k: int = 16, cell_groups: int = 20_000, singles: int = 20_000, supers: int = 1024, spread: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text).

    size: UTF-8 bytes + 1; a null text has size 1, crc 0 and is a group of its own beside the empty text.
    Rows with equal texts, repeated rows too, share a shard; slots number a shard's rows from 0 without
    gaps.  An empty table gives none.  ``spread``: ranges of rows per shard that are numbered apart, so
    that no task numbers a whole shard.
    """
    spark = docs.sparkSession
    raw = F.col("text").cast("binary")
    size = common.text_bytes() + 1
    base = common.saved(docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).alias("crc"), F.xxhash64("text", F.col("text").isNull()).alias("h")), "rows")
    groups = common.saved(base.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.col("size") * F.col("n")), "groups")
    all_ = groups.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    if not all_.g:
        return _numbered(base.withColumn("shard", F.lit(0)), spread)
    heavy = (F.col("weight") * 64 * k >= all_.w) | (F.col("n") >= max(100, all_.n // 2000))
    chosen = F.pmod(F.xxhash64("h", F.lit(7)), F.lit(1 << 30)) < int(min(1.0, singles / all_.g) * (1 << 30))
    alone = groups.withColumn("alone", heavy | chosen)
    items = alone.where("alone").select(*KEY, "weight").collect()  # bounded, see above
    cells = max(1, -(-(all_.g - len(items)) // cell_groups))
    parts = common.saved(_cells(alone.where("NOT alone"), k, cells), "cells")
    chips = parts.groupBy("cell", "part").agg(F.sum("weight").alias("weight"))
    if cells > supers:
        joint = common.saved(_combined(chips, k, supers), "joint")
        chips = chips.join(joint, ["cell", "part"]).groupBy(F.col("super").alias("cell"), F.col("joint").alias("part")).agg(F.sum("weight").alias("weight"))
        parts = parts.join(joint, ["cell", "part"]).select(*KEY, F.col("super").alias("cell"), F.col("joint").alias("part"))
    chip = chips.collect()  # at most k * supers
    place = deal([r.weight for r in items] + [r.weight for r in chip], k)
    own = spark.createDataFrame([(r.h, r.size, r.crc, s) for r, s in zip(items, place, strict=False)], "h long, size long, crc long, shard int")
    of_chip = spark.createDataFrame([(r.cell, r.part, s) for r, s in zip(chip, place[len(items) :], strict=True)], "cell int, part int, shard int")
    rest = parts.join(F.broadcast(of_chip), ["cell", "part"]).select(*KEY, "shard")
    marked = base.join(F.broadcast(own), KEY, "left")  # takes every group with many rows out of the next join
    rows = marked.where("shard IS NOT NULL").unionByName(marked.where("shard IS NULL").drop("shard").join(rest, KEY))
    return _numbered(common.saved(rows.select("doc_id", *KEY, "shard"), "sharded"), spread)


def _numbered(rows: DataFrame, spread: int) -> DataFrame:
    cut = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int"))
    counts = cut.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("shard", "piece", F.coalesce(before, F.lit(0)).alias("first"))  # shards x spread rows
    within = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("doc_id", "size", "crc", "h")) - 1
    return (
        cut.withColumn("at", within)
        .join(F.broadcast(first), ["shard", "piece"])
        .select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.documents(spark, sf_dir).select("doc_id", "text"))
