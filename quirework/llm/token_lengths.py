"""Token counts as an exact histogram of encoded lengths, answered by suffix sums.

Documents are encoded once; what is left is one row for each length that occurs.  With the number of
documents and tokens at or above each length, totals, quantiles and totals truncated at any context limit
are lookups.  Suffix sums run in blocks of lengths: sums of blocks first, then sums inside each block, so no
task sees the whole histogram.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytebpe, common

BLOCK = 256


def lengths(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text") -> DataFrame:
    """n_tokens of every row's whole text; null and empty texts have 0.  Repeated rows count each; an empty table gives none."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        enc = bytebpe.encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(x) // enc.width for x in enc.encode_all(b.column(0).to_pylist())], pa.int64())], names=["n_tokens"])

    return docs.select(text).mapInArrow(run, "n_tokens long")


def histogram(lens: DataFrame) -> DataFrame:
    """n_tokens, n_docs, docs_at_least, tokens_at_least, docs_total, tokens_total, truncated_tokens, share_up_to.

    truncated_tokens: all documents' tokens if each is cut after n_tokens; share_up_to: share of documents
    not longer, so the q-quantile is the least n_tokens with share_up_to >= q.  Empty input: no rows.
    """
    hist = common.saved(lens.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "histogram")
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tok", F.col("n_tokens") * F.col("n_docs"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tok").alias("t"))
    later = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    total = Window.partitionBy().orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"), F.sum("d").over(total).alias("docs_total"), F.sum("t").over(total).alias("tokens_total"))
    here = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = hist.join(blocks, "block").select("n_tokens", "n_docs", (F.sum("n_docs").over(here) + F.col("d_after")).alias("docs_at_least"), (F.sum("tok").over(here) + F.col("t_after")).alias("tokens_at_least"), "docs_total", "tokens_total")
    longer = F.col("docs_at_least") - F.col("n_docs")
    shorter = F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("n_docs")
    return out.withColumn("truncated_tokens", shorter + F.col("n_tokens") * longer).withColumn("share_up_to", F.round(1 - longer / F.col("docs_total"), 9))


def truncated_total(hist: DataFrame, limit: int) -> int:
    """All documents' tokens if each is cut after ``limit``, from one row of the histogram."""
    row = hist.where(F.col("n_tokens") > limit).orderBy("n_tokens").first()
    if row is None:
        row = hist.first()
        return row.tokens_total if row else 0
    return row.tokens_total - row.tokens_at_least + limit * row.docs_at_least


def quantile(hist: DataFrame, q: float) -> int | None:
    """Least length that at least a share ``q`` of the documents does not exceed."""
    row = hist.where(F.col("share_up_to") >= q).orderBy("n_tokens").first()
    return row.n_tokens if row else None


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lengths(common.documents(spark, sf_dir)))
