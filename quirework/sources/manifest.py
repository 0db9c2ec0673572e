"""The corpus manifest: where documents come from, what their screening says, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host(url: Column, patterns: list[tuple[str, str]], unknown: str = "unknown") -> Column:
    """Name of the first pattern that the address contains."""
    return F.coalesce(*[F.when(F.contains(url, F.lit(part)), F.lit(name)) for part, name in patterns], F.lit(unknown))


def screening_flag(blocking: Column, restricted: Column, statement: Column, unread_pages: Column) -> Column:
    """What blocks comes first, then a statement that is wanting, then pages nobody could read."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(blocking > 0) | yes(restricted), "BLOCKED").when(~yes(statement), "REVIEW").when(yes(unread_pages > 0), "CLEAR (with blind spots)").otherwise("CLEAR")


def totals(documents: DataFrame) -> DataFrame:
    """One row over (cleared, pages): documents, blocked, cleared, pages."""
    cleared = F.coalesce("cleared", F.lit(False))
    return documents.agg(F.count(F.lit(1)).alias("documents"), F.count_if(~cleared).alias("blocked"), F.count_if(cleared).alias("cleared"), F.coalesce(F.sum("pages"), F.lit(0)).cast("long").alias("pages"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows in the order of a hash of seed and key: the same ones on every run, however the rows lie."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def joined(sources: DataFrame, files: DataFrame, screening: DataFrame) -> DataFrame:
    """Listed sources whose file exists (file, …), with what screening found under the same name, if it ran."""
    return sources.join(files.select("file").distinct(), "file", "left_semi").join(screening, "file", "left")


def cleared_documents(manifest: DataFrame, part: str | None = None) -> DataFrame:
    """Documents cleared for ingestion, of publications whose id holds ``part`` in any case.  An empty result is an error where documents are wanted: :func:`required`."""
    own = manifest.where(F.coalesce("cleared", F.lit(False)))
    return own if part is None else own.where(F.contains(F.lower("pub_id"), F.lit(part.lower())))


def required(df: DataFrame, what: str) -> DataFrame:
    """``df``, or ValueError if it has no row."""
    if df.limit(1).count() == 0:
        raise ValueError(f"no {what}")
    return df


def blind_spots(pages: DataFrame) -> DataFrame:
    """doc, pages: the numbers of pages (doc, page, text, has_image) that show an image and give no text."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return pages.where(blank & F.coalesce("has_image", F.lit(False))).groupBy("doc").agg(F.array_sort(F.collect_list("page")).alias("pages"))


def provenance(old: DataFrame, new: dict[str, str]) -> DataFrame:
    """key, value rows of an index's provenance with ``new`` put in or in place of old values."""
    from .tables import upsert

    rows = old.sparkSession.createDataFrame(sorted(new.items()), "key string, value string")
    return upsert(old, rows, ["key"])
