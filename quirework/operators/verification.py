"""Citation checks: do interior word runs of a paragraph stand on the page that its citation names?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def probes(text: Column, n: int = 3, span: int = 6) -> Column:
    """Up to ``n`` runs of ``span`` words away from the edges, letters and digits only; a short text is one run with its blanks."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")

    def runs(w: Column) -> Column:
        size = F.size(w)
        step = F.greatest(F.lit(1), F.floor((size - span) / max(1, n)).cast("int"))
        start = lambda i: F.least(size - span, 2 + i * step)
        long_ = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_join(F.slice(w, start(i) + 1, span), ""))
        return F.when(size == 0, F.array().cast("array<string>")).when(size < 2 * span, F.array(F.array_join(w, " "))).otherwise(long_)

    return F.element_at(F.transform(F.array(words), runs), 1)


def check(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """id, n_probes, hits, page, verdict for each of ``chunks`` (id, doc, label, text).

    ``pages``: doc, page, label (printed number), text.  A page and the one after it are searched as one stream;
    of several pages with the label the first with most hits counts.  PASS: all probes; PARTIAL: some; FAIL:
    none; NO_PAGE: nothing bears the label.
    """
    own = tx.compact(F.coalesce("text", F.lit("")))
    after = F.lead("_own").over(Window.partitionBy("doc").orderBy("page"))
    stream = pages.select("doc", "page", "label", own.alias("_own")).select("doc", "page", "label", F.concat("_own", F.coalesce(after, F.lit(""))).alias("_stream"))
    asked = chunks.select("id", "doc", "label", probes(F.coalesce("text", F.lit(""))).alias("_p"))
    both = asked.join(stream, ["doc", "label"], "left")
    hits = F.size(F.filter("_p", lambda p: F.contains(F.col("_stream"), p)))
    best = F.max(F.when(F.col("page").isNotNull(), F.struct(hits.alias("hits"), (-F.col("page")).alias("back"))))
    g = both.groupBy("id").agg(F.max(F.size("_p")).alias("n_probes"), best.alias("b"))
    h = F.coalesce(F.col("b.hits"), F.lit(0))
    verdict = F.when(F.col("b").isNull(), "NO_PAGE").when(h == F.col("n_probes"), "PASS").when(h > 0, "PARTIAL").otherwise("FAIL")
    return g.select("id", "n_probes", h.alias("hits"), (-F.col("b.back")).alias("page"), verdict.alias("verdict"))


def tally(checked: DataFrame) -> DataFrame:
    """verdict, n, pct of all."""
    g = checked.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("_all")))).select("verdict", "n", F.bround(100.0 * F.col("n") / F.col("_all"), 1).alias("pct"))
