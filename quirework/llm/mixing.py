"""Mixing sources to target weights by Poisson replication, in SQL functions alone.

A source's rate is how often its documents should be repeated on average so that its share of the output's
bytes is its target share.  Every document draws its own count: a uniform number from a hash of seed and
doc_id, put through the inverse of the Poisson distribution with that rate.  So the draw needs no state, is
the same on every run, and two documents are drawn independently.  Counts are exploded into copies, and
copies are ordered by a second hash, which is a global shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED, TEMPERATURE, MAX_RATE = "mix", 0.5, 8.0
#: Sources up to this number go to every executor (some hundred bytes each); beyond, the join is salted.
FEW_SOURCES = 20_000
SALTS = 64


def hashed(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts joined by colons, as a long."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def own_id() -> Column:
    """What a row draws by: its doc_id, or without one its text, so that rows without an id neither draw alike nor lie together."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE, max_rate: float = MAX_RATE, source: str = "source", text: str = "text") -> DataFrame:
    """source, rate: mean repetitions.  Output bytes aim at ``epochs`` times the input's.

    Targets: ``weights`` by source (sources it does not name get none, names of absent sources do not count), or by default each source's bytes to
    the power ``temperature``, in proportion.  There no rate is above ``max_rate``, so that a tiny source is not
    repeated without end; what a source at the cap leaves goes to the others in their proportions, until none is
    above it.  That is part of the target, not a cut of rows.  Given weights are met without a cap.
    """
    by = docs.groupBy(F.col(source).alias("source")).agg(F.sum(common.text_bytes(text) + 1).alias("bytes"))
    if weights is None:
        goal = by.withColumn("goal", F.round(F.pow(F.col("bytes").cast("double"), F.lit(temperature)), 6))
    else:
        named = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else F.create_map().cast("map<string,double>")
        goal = by.withColumn("goal", F.round(F.coalesce(F.try_element_at(named, F.col("source")), F.lit(0.0)), 6))
    goal = common.saved(goal, "goals")  # one row a source
    level = _level(goal, epochs, math.inf if weights is not None else max_rate)
    rate = F.lit(level) * F.col("goal") / F.col("bytes")
    if weights is None:
        rate = F.least(F.lit(max_rate), rate)
    return goal.select("source", F.coalesce(F.round(rate, 9), F.lit(0.0)).alias("rate"))


def _level(goal: DataFrame, epochs: float, cap: float) -> float:
    """What goal / bytes is multiplied by, so that rates held at ``cap`` give ``epochs`` times the bytes; each round sees three sums."""
    level, before = 0.0, -1
    for _ in range(1000):
        full = F.lit(level) * F.col("goal") / F.col("bytes") >= F.lit(cap)
        r = goal.agg(F.sum("bytes").alias("all"), F.coalesce(F.sum(F.when(full, F.col("bytes"))), F.lit(0)).alias("held"), F.sum(F.when(~full, F.col("goal"))).alias("goal")).first()
        if r.held == before or not r.goal:
            break
        before = r.held
        level = max(0.0, (epochs * r["all"] - (cap * r.held if r.held else 0.0)) / r.goal)
    return level


def distribution(rate: Column, most: int) -> Column:
    """Cumulative Poisson probabilities of 0 .. most as array<double>."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.concat(a["all"], F.array(a["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda a: a["all"])


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE, max_rate: float = MAX_RATE, seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default) + ``copy`` (from 1) + ``shuffle_key``, one row a copy, not yet ordered.

    Null sources are a source of their own.  Null doc_ids draw by their texts.  Repeated rows draw alike and are
    repeated alike.  Empty texts weigh one byte.  An empty table gives an empty one.  Columns of ``docs`` called
    ``copy`` or ``shuffle_key`` stay under that name with underscores.
    """
    out = _copies(docs, weights, epochs, temperature, max_rate, seed, carry or docs.columns)
    own = [F.col("_row")[c].alias(common.unused(c, [*docs.columns, "copy", "shuffle_key"]) if c.lower() in ("copy", "shuffle_key") else c) for c in carry or docs.columns]
    return out.select(*own, "copy", "shuffle_key")


def _copies(docs: DataFrame, weights, epochs: float, temperature: float, max_rate: float, seed: str, carry: list[str]) -> DataFrame:
    """_row struct of ``carry``, copy, shuffle_key: the columns of ``docs`` cannot clash with what is added."""
    table = common.saved(rates(docs, weights, epochs, temperature, max_rate), "rates")
    most = math.ceil(max_rate + 12 * math.sqrt(max_rate) + 30)
    # a rate above max_rate is the sum of draws with equal rates below it
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(max_rate))).cast("int")
    cdf = table.select(F.col("source").alias("_source"), draws.alias("_draws"), distribution(F.col("rate") / draws, most).alias("_cdf"))
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), own_id().alias("_id"), F.col("source").alias("_of"))
    if table.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        met = src.join(F.broadcast(cdf), F.col("_of").eqNullSafe(F.col("_source")))
    else:
        salted = cdf.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = src.withColumn("_own", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(salted, F.col("_of").eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_salt")))
    uniform = lambda *own: hashed(F.lit(seed), F.col("_id"), *own) / F.lit(float(1 << 52))
    further = F.expr("if(_draws > 1, sequence(1, _draws - 1), array())")
    us = F.concat(F.array(uniform()), F.transform(further, lambda i: uniform(F.lit("draw"), i)))
    count = F.expr("aggregate(_us, 0, (n, u) -> n + size(filter(_cdf, c -> u >= c)))")
    drawn = met.withColumn("_us", us).withColumn("_n", count).where("_n > 0")
    copies = drawn.select("_row", "_id", F.explode(F.expr("sequence(1, _n)")).alias("copy"))
    return copies.select("_row", "copy", hashed(F.lit(f"{seed}-order"), F.col("_id"), F.col("copy")).alias("shuffle_key"))


def shuffled(copies: DataFrame) -> DataFrame:
    """Copies in global order of their hash: ranges of an even hash are known, so no sample is taken."""
    parts = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.col("shuffle_key") / F.lit(float(1 << 52)) * parts).cast("int")
    return copies.repartitionById(parts, place).sortWithinPartitions("shuffle_key", "copy")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE, max_rate: float = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mixed corpus: ``docs``' own columns, one row a copy, in shuffled order."""
    return shuffled(_copies(docs, weights, epochs, temperature, max_rate, seed, docs.columns)).select("_row.*")


def mixed_corpus(docs: DataFrame) -> DataFrame:
    """The copies with all columns, texts included, in shuffled order, written to the shared folder."""
    return common.saved(shuffled(replicate(docs)), "mixed")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index, in shuffled order, of the mixed corpus that has been written whole (the SQL has these four columns)."""
    return shuffled(mixed_corpus(common.documents(spark, sf_dir)).select("doc_id", "source", "copy", "shuffle_key"))


MOST = math.ceil(MAX_RATE + 12 * math.sqrt(MAX_RATE) + 30)
_ID = "coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))"
OP7_SQL = f"""
WITH RECURSIVE b AS (SELECT source, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source),
g AS (SELECT *, round(pow(CAST(bytes AS DOUBLE), {TEMPERATURE}), 6) AS goal FROM b),
l AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS level
      UNION ALL SELECT k + 1, coalesce(greatest(0.0, (CAST(sum(bytes) AS DOUBLE) - {MAX_RATE}::DOUBLE * coalesce(sum(bytes) FILTER (WHERE level * goal / bytes >= {MAX_RATE}), 0)) / sum(goal) FILTER (WHERE level * goal / bytes < {MAX_RATE})), any_value(level)) FROM g, l WHERE k < 30 GROUP BY k),
r AS (SELECT source, round(least({MAX_RATE}::DOUBLE, level * goal / bytes), 9) AS rate FROM g, l WHERE k = 30),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
      UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM c WHERE k < {MOST}),
u AS (SELECT {_ID} AS own, doc_id, source, CAST(('0x' || substr(md5('{SEED}:' || {_ID}), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT own, doc_id, u.source AS source, count(*) FILTER (WHERE u >= c) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY ALL),
x AS (SELECT own, doc_id, source, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM n)
SELECT doc_id, source, copy, CAST(('0x' || substr(md5('{SEED}-order:' || own || ':' || copy), 1, 13)) AS BIGINT) AS shuffle_key FROM x
"""
