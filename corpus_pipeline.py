"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input.

Quality rules, language ID and near-dedup remove documents; mixing repeats them towards even sources; the
last stage gives token ids.  A table with further columns keeps them, whatever they are called, up to the last
stage.  Every stage takes whole texts of any length, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.llm import common, langid, mixing, pieces, quality, simhash


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  Null texts and those of under 50 words go; repeated rows share a verdict; other nulls do not matter."""
    return quality.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from this stage's own rows.  Texts without a letter and null texts go; rows without a lang or doc_id teach nothing and are judged like any other; repeated rows share a verdict."""
    return langid.keep_languages(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the smallest (doc_id, text hash).  Of rows equal in both one stays; null texts are a group, and rows without a doc_id stand behind all others."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies towards even sources, in hash order, with the input's columns alone.  Null sources are one source; rows without a doc_id draw by their texts; repeated rows are repeated alike."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and whether the ids decode to the text; copies and repeated rows stay; a null text has no ids, as an empty one."""
    return pieces.encode_checked(docs, keep=["doc_id", "lang", "source"])


STAGES = [("quality", rules), ("language", language), ("near_dedup", dedup), ("mixing", mixture), ("encoding", tokens)]

#: Language ID, SimHash and piece encoding have no SQL form; the tests hold the pipeline against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  A stage's tables go as soon as its result is written; the last input stays until the result has been read."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        began = common.mark()
        new = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.sweep(spark, began, keep=(f"pipeline-{name}-",))
        if name != STAGES[0][0]:
            common.forget(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
