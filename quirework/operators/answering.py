"""Questions to answers: the score gate, the prompt, an injected generator, cite-or-refuse, what was cited."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Gates
from ..functions import text as tx
from . import gates


def assembled(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, question, n_chunks, top_score, best_bm25, sources (citation, text in rank order) of every question, with or without hits.

    ``hits``: query_id, rank, rerank_score, bm25_score (null: no lexical hit), citation, text - a handful a question.
    """
    g = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max_by("rerank_score", -F.col("rank")).alias("top_score"), F.min("bm25_score").alias("best_bm25"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "citation", "text"))), lambda x: F.struct(x["citation"], x["text"])).alias("sources"),
    )
    none = F.array().cast("array<struct<citation:string,text:string>>")
    met = questions.join(g, "query_id", "left")
    return met.select("query_id", "question", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "top_score", "best_bm25", F.coalesce("sources", none).alias("sources"))


def answer(assembled_: DataFrame, generator: Callable[[Column, Column], Column], limits: Gates = Gates()) -> DataFrame:
    """query_id, top_score, reason, answer, cited: reason is null where the answer stands, which is null where it does not.

    ``generator(prompt, sources)`` is asked only for questions that pass the score gate; a call that fails gives null and
    the reason ``model_unavailable``.  cited: the citations of the markers that name one of the sources.
    """
    gate = gates.score_gate(F.col("n_chunks"), F.col("top_score"), limits.score, F.col("best_bm25"), limits.rescue)
    asked = assembled_.withColumn("_gate", gate).withColumn("_prompt", F.when(F.col("_gate").isNull(), gates.prompt(F.col("question"), F.col("sources"))))
    said = asked.withColumn("_said", F.when(F.col("_prompt").isNotNull(), generator(F.col("_prompt"), F.col("sources"))))
    kept = gates.cite_or_refuse(F.col("_said"), F.col("n_chunks"), limits.refusal_sentinel, limits.factual_chars)
    reason = F.coalesce("_gate", F.when(F.col("_said").isNull(), "model_unavailable"), kept)
    used = F.transform(gates.citations(F.col("_said"), F.col("n_chunks")), lambda m: F.get(F.col("sources"), m - 1)["citation"])
    judged = said.withColumn("reason", reason)
    stands = F.col("reason").isNull()
    return judged.select("query_id", "top_score", "reason", F.when(stands, F.col("_said")).alias("answer"), F.when(stands, F.array_distinct(used)).alias("cited"))


def extractive(prompt: Column, sources: Column) -> Column:
    """Stand-in for a generator: the best source's first sentence with its marker; a source under 40 characters answers nothing."""
    first = F.get(sources, 0)["text"]
    return F.when(F.length(first) < 40, "NOT_IN_SOURCES").otherwise(F.concat(F.get(tx.sentences(first), 0), F.lit(" [1]")))
