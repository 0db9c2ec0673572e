"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, tree merging.

Vectors are packed into block rows (ids + one small-integer matrix).  Query blocks are dealt into groups of
bounded size and candidate blocks into shards; every group meets every shard through an equi-join, so neither
side is broadcast or collected, and a task holds one group and one tile of ``rows x queries`` scores at a time.
A task keeps the best k of a query block over its tiles; lists of different shards are merged in two
levels, so that no group holds more than about the square root of the number of shards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = "dim int, block long, ids binary, bits int, matrix binary"
#: Sums of products below this are exact in float64.
EXACT = 1 << 53


def _scaled(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as int64, or as Python integers where int64 is too small."""
    x = np.floor(values.astype(np.float64) * scale)
    return x.astype(np.int64) if not len(x) or np.abs(x).max() < 2.0**62 else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def pack(vectors: DataFrame, key: str, value: str, scale: float, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one dimension; null, non-finite and null-holding vectors and null keys are left out."""
    v = F.col(value)
    ok = v.isNotNull() & F.col(key).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    src = vectors.where(ok).select(F.col(key).cast("long").alias("key"), F.col(value).cast("array<double>").alias("value"))

    def block(dim: int, ids: list, mats: list, n: int) -> dict:
        m = np.concatenate(mats) if mats else np.zeros((0, dim), np.int64)
        big = int(max((abs(int(x)) for x in (m.min(), m.max())), default=0)) if m.size else 0
        bits = 16 if big < 1 << 15 else 32 if big < 1 << 31 else 64 if big < 1 << 62 else 0
        raw = m.astype(f"<i{bits // 8}").tobytes() if bits else "\n".join(map(str, m.ravel())).encode()
        return {"dim": dim, "block": n, "ids": np.array(ids, "<i8").tobytes(), "bits": bits, "matrix": raw}

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}
        schema = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("bits", pa.int32()), ("matrix", pa.binary())])
        for b in batches:
            ids, col = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            lens = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(lens)])
            for dim in np.unique(lens).tolist():
                mine = np.flatnonzero(lens == dim)
                m = _scaled(np.stack([flat[at[i] : at[i] + dim] for i in mine]) if dim else np.zeros((len(mine), 0)), scale)
                have_ids, have = held.setdefault(dim, ([], []))
                have_ids.extend(ids[mine].tolist())
                have.append(m)
                if len(have_ids) >= rows:
                    whole = np.concatenate(have)
                    for a in range(0, len(have_ids), rows):
                        yield pa.RecordBatch.from_pylist([block(dim, have_ids[a : a + rows], [whole[a : a + rows]], (part << 32) + n)], schema=schema)
                        n += 1
                    held[dim] = ([], [])
        for dim, (have_ids, have) in held.items():
            if have_ids:
                yield pa.RecordBatch.from_pylist([block(dim, have_ids, have, (part << 32) + n)], schema=schema)
                n += 1

    return src.mapInArrow(run, BLOCK)


def _matrix(raw: bytes, bits: int, dim: int, n: int) -> np.ndarray:
    if bits:
        return np.frombuffer(raw, f"<i{bits // 8}").reshape(n, dim)
    return np.array([int(x) for x in raw.split(b"\n") if x], object).reshape(n, dim)


def _product(q: np.ndarray, c: np.ndarray, dim: int) -> np.ndarray:
    """Exact q x c.T as int64; products beyond int64 are held at its ends."""
    top = lambda m: max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0))))
    bound = top(q) * top(c) * max(dim, 1)
    if bound < EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    s = q.astype(object) @ c.astype(object).T
    return np.clip(s, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query row the k highest scores, ties to smaller ids, without candidates that carry the query's own id."""
    out = []
    n = scores.shape[1]
    # a query's own id takes no part, however often the block holds it: so many scores more bound the k best
    take = min(n, k + int(np.unique(ids, return_counts=True)[1].max(initial=1)))
    cuts = np.partition(scores, n - take, axis=1)[:, n - take] if n > take else np.full(len(scores), np.iinfo(np.int64).min)
    rows, cols = np.nonzero(scores >= cuts[:, None])
    fine = ids[cols] != own[rows]
    rows, cols = rows[fine], cols[fine]
    s = scores[rows, cols]
    order = np.lexsort((ids[cols], -s.astype(object) if s.size and s.min() == np.iinfo(np.int64).min else -s, rows))
    rows, cols, s = rows[order], cols[order], s[order]
    edges = np.searchsorted(rows, np.arange(len(scores) + 1))
    for i in range(len(scores)):
        a, b = edges[i], min(edges[i + 1], edges[i] + k)
        out.append((s[a:b], ids[cols[a:b]]))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", value: str = "embedding", scale: float = 256.0, rows: int = 2048, query_rows: int = 512, shards: int | None = None, group_bytes: int = 64 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products for each query row.

    A candidate with the query's own key takes no part.  Vectors that are null, hold null or non-finite
    components, or have no key, take no part on either side; vectors of another dimension than the query's
    take no part for it.  Repeated candidate rows count each; a repeated query key is answered from all its
    vectors, the k best overall.  Fewer than k candidates give fewer rows; empty tables give none.  Sums beyond 64
    bits, which ``score`` cannot hold, count as its largest or smallest value.

    The work is a grid of query groups x shards of candidates.  A group holds about ``group_bytes`` of query blocks
    (the hash side of a task, which does not spill), however many queries there are; by default there are as many
    shards as make the grid's cells the session's shuffle partitions.  Beside its group a task holds one tile of
    scores (rows x query_rows x 8 bytes) and one Arrow batch of blocks.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    asked = common.saved(pack(queries, key, value, scale, query_rows), "queries")
    size = asked.agg(F.sum(F.octet_length("matrix") + F.octet_length("ids"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    shards = shards or max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // groups))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cand = pack(vectors, key, value, scale, rows).withColumn("shard", F.pmod(F.xxhash64("block", "dim"), F.lit(shards)).cast("int")).withColumn("group", every(groups))
    q = asked.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("bits").alias("q_bits"), F.col("matrix").alias("q_matrix"), F.pmod(F.xxhash64("block", "dim", F.lit(5)), F.lit(groups)).cast("int").alias("group"), every(shards).alias("shard"))
    tiles = q.hint("shuffle_hash").join(cand, ["shard", "group", "dim"]).select("dim", "shard", "q_block", "q_ids", "q_bits", "q_matrix", "ids", "bits", "matrix")
    out = pa.schema([("shard", pa.int32()), ("query_id", pa.int64()), ("top", pa.list_(pa.struct([("neg", pa.int64()), ("vec_id", pa.int64())])))])

    def run(batches):
        held: dict[tuple, dict] = {}  # best of the query blocks of this task so far
        waiting = 0

        def flush():
            rows_ = [{"shard": s, "query_id": i, "top": [{"neg": -x, "vec_id": v} for x, v in zip(sc.tolist(), vs.tolist(), strict=True)]} for (s, _), h in held.items() for i, (sc, vs) in zip(h["own"].tolist(), h["top"], strict=True) if len(sc)]
            for a in range(0, len(rows_), 2000):
                yield pa.RecordBatch.from_pylist(rows_[a : a + 2000], schema=out)
            held.clear()

        for b in batches:
            for r in b.to_pylist():
                own, ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                scores = np.maximum(_product(_matrix(r["q_matrix"], r["q_bits"], r["dim"], len(own)), _matrix(r["matrix"], r["bits"], r["dim"], len(ids)), r["dim"]), -(2**63) + 1)
                got = best(scores, ids, own, k)
                h = held.setdefault((r["shard"], r["q_block"]), {"own": own, "top": None})
                if h["top"] is None:
                    h["top"] = got
                    waiting += len(own)
                else:
                    h["top"] = [_merge(x, y, k) for x, y in zip(h["top"], got, strict=True)]
                if waiting > 20_000:  # bounded: lists go on to the merging levels
                    yield from flush()
                    waiting = 0
        yield from flush()

    lists = tiles.mapInArrow(run, "shard int, query_id long, top array<struct<neg long, vec_id long>>")
    fan = max(2, math.isqrt(shards))
    merged = lambda: F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top")
    level1 = lists.groupBy("query_id", F.pmod("shard", F.lit(fan)).alias("branch")).agg(merged())
    level2 = level1.groupBy("query_id").agg(merged())
    return level2.select("query_id", F.posexplode("top").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.neg")).alias("score"))


def _merge(x: tuple, y: tuple, k: int) -> tuple:
    s, i = np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])
    order = np.lexsort((i, -s))[:k]
    return s[order], i[order]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(v, v.where("vec_id % 50 = 0"), k=5)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
