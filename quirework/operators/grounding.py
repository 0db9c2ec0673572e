"""Grounding of answer sentences in retrieved chunks, given their vectors, and what follows for the answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maths


def supports(sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, sent_no, support (4 places; 0 without chunks), best (first chunk with the highest cosine).

    ``sentences``: query_id, sent_no, vec; ``chunks``: query_id, chunk_no, vec.  A query retrieves a handful of
    chunks, so the join on query_id is small per key.
    """
    pairs = sentences.join(chunks.select("query_id", "chunk_no", F.col("vec").alias("_cv")), "query_id", "left")
    sim = F.when(F.col("_cv").isNotNull(), F.struct(maths.cosine(F.col("vec"), F.col("_cv")).alias("s"), (-F.col("chunk_no")).alias("back")))
    g = pairs.groupBy("query_id", "sent_no").agg(F.max(sim).alias("b"))
    return g.select("query_id", "sent_no", F.bround(F.coalesce("b.s", F.lit(0.0)), 4).alias("support"), (-F.col("b.back")).alias("best"))


def actions(supported: DataFrame, threshold: float | None, strip: bool = False) -> DataFrame:
    """query_id, n, unsupported, min_support, action: ungrounded_answer if nothing holds, strip or mark if some do not, else null."""
    low = F.lit(False) if threshold is None else F.col("support") < threshold
    g = supported.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(low).alias("unsupported"), F.min("support").alias("min_support"))
    what = F.when((F.col("unsupported") == F.col("n")) & (F.col("n") > 0), "ungrounded_answer").when(F.col("unsupported") > 0, "strip" if strip else "mark")
    return g.withColumn("action", what)


def rewritten(sentences: DataFrame, threshold: float, strip: bool = False, mark: str = " [UNSUPPORTED]") -> DataFrame:
    """query_id, answer: sentences (query_id, sent_no, sentence, support) put together, weak ones left out or marked."""
    weak = F.col("support") < threshold
    said = F.when(~weak, F.col("sentence")).when(F.lit(not strip), F.concat("sentence", F.lit(mark)))
    parts = F.filter(F.array_sort(F.collect_list(F.struct("sent_no", said.alias("s")))), lambda x: x["s"].isNotNull())
    return sentences.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), " ").alias("answer"))
