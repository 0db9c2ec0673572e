"""Interaction records: sequence numbers, statistics, statements, signed export."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def with_seq(new: DataFrame, old: DataFrame, order: list[str]) -> DataFrame:
    """New rows numbered on from the highest seq.  One batch of appended rows; order by (seq, id) when reading.

    Rows are dealt out in ranges of ``order`` and written with their place in the range (``spark.checkpoint.dir``);
    a range's first number is the sum of the counts before it, so only counts meet in one task.
    """
    ranges = new.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranges.select(F.struct(*[F.col(f"`{c}`") for c in new.columns]).alias("_row"), F.monotonically_increasing_id().alias("_at")).checkpoint()
    placed = placed.select("_row", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_first"))
    top = old.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_top"))
    seq = (F.col("_top") + F.col("_first") + F.col("_place") + 1).alias("seq")
    return placed.join(F.broadcast(first), "_range").crossJoin(F.broadcast(top)).select(*[F.col("_row")[c].alias(c) for c in new.columns if c != "seq"], seq)


def stats(interactions: DataFrame) -> DataFrame:
    n = interactions.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("answered").cast("int")), F.lit(0)).alias("answered"), F.avg("latency_s").alias("m"))
    return n.select("n", "answered", (F.col("n") - F.col("answered")).alias("abstained"), F.bround(F.nullif("m", F.lit(0.0)), 2).alias("mean_latency"))


def refusals(interactions: DataFrame, limit: int) -> DataFrame:
    return interactions.where("NOT answered").orderBy(F.desc("seq")).limit(limit)


def statements(interactions: DataFrame, base: str = "https://example.org/xapi") -> DataFrame:
    """seq, statement_json: one xAPI-shaped statement per interaction."""
    verb = F.when(F.col("answered"), "answered").otherwise("asked")
    body = F.struct(
        F.struct(F.col("actor").alias("name")).alias("actor"),
        F.struct(F.concat(F.lit(f"{base}/verbs/"), verb).alias("id")).alias("verb"),
        F.struct(tx.limited("question", "name").alias("name")).alias("object"),
        F.struct(tx.limited("answer_text", "response").alias("response"), F.col("answered").alias("success")).alias("result"),
    )
    return interactions.select("seq", F.to_json(body).alias("statement_json"))


def append(interactions: DataFrame, path: str, batch: int) -> None:
    """Write a batch of numbered interactions, each with its statement beside it, to ``path``: one folder and one commit a batch.

    A batch that is written again, after a failure or twice at once, takes its own place; no interaction is without its statement.
    """
    both = interactions.join(statements(interactions), "seq")
    both.write.mode("overwrite").parquet(f"{path}/batch={int(batch)}")


def appended(spark, path: str) -> DataFrame:
    """All interactions with statement_json and their batch."""
    return spark.read.parquet(path)


def mark_exported(exported: DataFrame, path: str, export: int) -> None:
    """Note the ``seq`` of what an export holds; notes are only ever added."""
    exported.select("seq").distinct().write.mode("overwrite").parquet(f"{path}/export={int(export)}")


def pending(interactions: DataFrame, marks: DataFrame) -> DataFrame:
    """What no export holds yet."""
    return interactions.join(marks.select("seq").distinct(), "seq", "left_anti")


def signed_bundle(rows: list[dict], key: bytes) -> dict:
    """Canonical JSON of the rows in seq order with its HMAC-SHA256.  Driver-side: a bundle is one document."""
    body = json.dumps(sorted(rows, key=lambda r: (r["seq"], r.get("id", 0))), sort_keys=True, separators=(",", ":"), default=str)
    return {"payload": body, "sha256": hashlib.sha256(body.encode()).hexdigest(), "hmac": hmac.new(key, body.encode(), hashlib.sha256).hexdigest()}


def verified(bundle: dict, key: bytes) -> bool:
    return hmac.compare_digest(bundle["hmac"], hmac.new(key, bundle["payload"].encode(), hashlib.sha256).hexdigest())


def missing_publications(named: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows of ``named`` (…, pub) that no loaded publication equals or is a prefix of, in either direction.

    Every prefix of a name, itself and the empty one too, is a key: a loaded name meets the prefixes of what was
    named, and a name meets the prefixes of what is loaded.  Names are short, and both joins are equi-joins.
    """
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.length(c)), lambda n: F.left(F.col(c), n)))
    asked, have = named.select("pub").distinct(), loaded.select(F.col("pub").alias("_have")).distinct()
    longer = asked.select("pub", prefixes("pub").alias("_have")).join(have, "_have", "left_semi").select("pub")
    shorter = asked.join(have.select(prefixes("_have").alias("pub")), "pub", "left_semi")
    return named.join(longer.unionByName(shorter), "pub", "left_anti").select(*named.columns)


def canonical(df: DataFrame, columns: list[str], name: str = "canonical") -> DataFrame:
    """``df`` + one JSON text of the columns in the order of their names, without blanks, nulls kept."""
    return df.withColumn(name, F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def gap_report(gaps: DataFrame, first: int = 12) -> DataFrame:
    """kind, n, first_ids, missing of the classified refusals (id, kind, missing array): counts, the first ids, all publications asked for.

    Only ``first`` ids a kind are gathered; the publications are distinct before they are.
    """
    w = Window.partitionBy("kind").orderBy("id")
    head = gaps.select("kind", "id", F.row_number().over(w).alias("_r")).where(F.col("_r") <= first).groupBy("kind").agg(F.array_sort(F.collect_list("id")).alias("first_ids"))
    wanted = gaps.select("kind", F.explode("missing").alias("pub")).distinct().groupBy("kind").agg(F.array_sort(F.collect_list("pub")).alias("missing"))
    n = gaps.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return n.join(head, "kind").join(wanted, "kind", "left").select("kind", "n", "first_ids", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def telemetry(samples: DataFrame, by: str, value: str, order: str, most_drift: float = 100.0) -> DataFrame:
    """Highest and mean value of each series, how far its last is from its first, and whether that is steady."""
    g = samples.groupBy(by).agg(F.max(value).alias("top"), F.avg(value).alias("m"), (F.max_by(value, order) - F.min_by(value, order)).alias("d"))
    return g.select(by, F.round("top", 6).alias("top"), F.round("m", 6).alias("mean"), F.round("d", 6).alias("drift"), (F.col("d") < most_drift).alias("steady"))
