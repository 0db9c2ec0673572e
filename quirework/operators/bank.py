"""The item bank: making items, checking them, the review queue, and the track that learners follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths
from ..functions import text as tx
from . import learning as lr
from .references import apparatus

#: Least cosine of a key point with some sentence of its source.
GROUNDED = 0.62


def section_chunks(sections: DataFrame, chunks: DataFrame, n: int, least_chars: int) -> DataFrame:
    """Each section's ``n`` longest chunks of at least ``least_chars`` (ties: smaller id) and their place; a null chapter equals a null chapter."""
    s, c = sections.select("pub_id", "chapter", "section").alias("s"), chunks.where(F.col("n_chars") >= least_chars).alias("c")
    met = c.join(s, [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ("pub_id", "chapter", "section")], "left_semi")
    w = Window.partitionBy("pub_id", "chapter", "section").orderBy(F.desc("n_chars"), "id")
    return met.withColumn("ordinal", F.row_number().over(w) - 1).where(F.col("ordinal") < n)


def generate(picked: DataFrame, generator: Callable[[Column], Column]) -> DataFrame:
    """item_id, pub_id, chapter, section, ordinal, question, key_points, source_chunk_id, source_text of the chunks from :func:`section_chunks`.

    ``generator`` gives a model's raw text for a source; what does not parse, or is null because the call failed, is left
    out alone.  A run that goes on leaves finished sections out of ``picked`` (learning.undone), and an item's id stays
    what its source makes it.
    """
    made = picked.withColumn("_i", tx.item_json(generator(F.col("text")))).where(F.col("_i").isNotNull())
    key = tx.item_id("pub_id", "chapter", "text", "ordinal").alias("item_id")
    return made.select(key, "pub_id", "chapter", "section", "ordinal", F.col("_i.question").alias("question"), F.col("_i.key_points").alias("key_points"), F.col("id").alias("source_chunk_id"), F.col("text").alias("source_text"))


def track_of(items: DataFrame) -> DataFrame:
    """pub_id, chapter, section, item_ids (in the section's order), place: sections in a publication's order, those without a chapter first, then by first chunk."""
    g = items.groupBy("pub_id", "chapter", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "item_id"))), lambda x: x["item_id"]).alias("item_ids"), F.min("source_chunk_id").alias("_first"))
    w = Window.partitionBy("pub_id").orderBy(F.col("chapter").asc_nulls_first(), "_first", F.col("section").asc_nulls_first())
    return g.withColumn("place", F.row_number().over(w)).drop("_first")


def servable_track(track: DataFrame, servable: DataFrame, section: str | None = None, pub: str | None = None) -> DataFrame:
    """pub_id, section, item_id, pos of a track's items that may be served, of one section or publication if asked; sections without any are gone."""
    own = track if section is None else track.where(F.col("section") == section)
    own = own if pub is None else own.where(F.col("pub_id") == pub)
    return own.select("pub_id", "section", F.posexplode("item_ids").alias("pos", "item_id")).join(servable.select("item_id").distinct(), "item_id", "left_semi")


def ungrounded(points: DataFrame, sentences: DataFrame, least: float = GROUNDED) -> DataFrame:
    """item_id, point_no, best, code: the highest cosine of each key point with its source's sentences, and what follows.

    ``points``: item_id, point_no, vec; ``sentences``: item_id, sent_no, vec.  UNGROUNDED_KEY_POINT under ``least`` (0 without a
    sentence), PRECHECK_FAILED for every point of an item of which some vector is missing, as then nothing was compared.
    """
    broken = points.where("vec IS NULL").select("item_id").unionByName(sentences.where("vec IS NULL").select("item_id")).distinct().withColumn("_broken", F.lit(True))
    pairs = points.join(sentences.select("item_id", F.col("vec").alias("_sv")), "item_id", "left")
    best = pairs.groupBy("item_id", "point_no").agg(F.coalesce(F.max(maths.cosine(F.col("vec"), F.col("_sv"))), F.lit(0.0)).alias("b"))
    judged = best.join(broken, "item_id", "left")
    code = F.when(F.col("_broken"), "PRECHECK_FAILED").when(F.col("b") < least, "UNGROUNDED_KEY_POINT")
    return judged.select("item_id", "point_no", F.when(F.col("_broken").isNull(), maths.round_exact(F.col("b"), 2)).alias("best"), code.alias("code"))


def precheck(items: DataFrame, grounding: DataFrame) -> DataFrame:
    """item_id, flags: codes and details of an item's own shape and of its grounding (rows of :func:`ungrounded`), in that order."""
    shape = F.transform(lr.shape_flags(F.col("question"), F.col("key_points")), lambda c: F.struct(c.alias("code"), F.lit("").alias("detail")))
    source = F.when(apparatus("source_text").isNotNull(), F.array(F.struct(F.lit("SOURCE_NOT_TEACHABLE").alias("code"), apparatus("source_text").alias("detail"))))
    none = F.array().cast("array<struct<code:string,detail:string>>")
    weak = grounding.where("code IS NOT NULL").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("point_no", "code", F.coalesce(F.col("best").cast("string"), F.lit("")).alias("detail")))).alias("_g"))
    # one failure stands for the item, not for each of its points
    once = F.when(F.exists("_g", lambda x: x["code"] == "PRECHECK_FAILED"), F.slice("_g", 1, 1)).otherwise(F.col("_g"))
    found = F.coalesce(F.transform(once, lambda x: F.struct(x["code"].alias("code"), x["detail"].alias("detail"))), none)
    return items.join(weak, "item_id", "left").select("item_id", F.concat(shape, F.coalesce(source, none), found).alias("flags"))


def queue(reviews: DataFrame, items: DataFrame, limit: int = 200) -> DataFrame:
    """Pending items of the bank, the most suspicious first."""
    n = F.greatest(F.coalesce(F.size("flags"), F.lit(0)), F.lit(0))
    met = reviews.where("status = 'pending'").join(items.select("item_id", "question"), "item_id")
    return met.select("item_id", "question", F.coalesce(lr.severity(F.col("flags")), F.lit(0)).alias("severity"), n.alias("n_flags")).orderBy(F.desc("severity"), F.desc("n_flags"), "item_id").limit(limit)


def bulk_approve(reviews: DataFrame, items: DataFrame, reviewer: str = "bulk:unflagged") -> DataFrame:
    """item_id, status, reviewer, checked of pending items of the bank: approved where checks ran and found nothing; never checked is not checked clean."""
    met = reviews.where("status = 'pending'").join(items.select("item_id"), "item_id", "left_semi")
    d = lr.bulk_decision(F.col("flags"))
    return met.select("item_id", F.when(d == "approve", "approved").otherwise("pending").alias("status"), F.when(d == "approve", F.lit(reviewer)).alias("reviewer"), (d != "unchecked").alias("checked"))


def with_edits(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Items with the reviewer's question where it is not empty, and key points where the list is not empty."""
    e = reviews.select("item_id", F.nullif("edited_question", F.lit("")).alias("_q"), F.when(F.size("edited_points") > 0, F.col("edited_points")).alias("_p"))
    met = items.join(e, "item_id", "left")
    return met.withColumn("question", F.coalesce("_q", "question")).withColumn("key_points", F.coalesce("_p", "key_points")).drop("_q", "_p")


def gate_answers(answers: DataFrame, supports: DataFrame, least: float) -> DataFrame:
    """query_id, min_support, refuse of every answer; one without a factual sentence has support 1 and is not refused."""
    low = supports.groupBy("query_id").agg(F.min("support").alias("_m"))
    m = F.coalesce("_m", F.lit(1.0))
    return answers.select("query_id").distinct().join(low, "query_id", "left").select("query_id", m.alias("min_support"), (m < least).alias("refuse"))
