"""Readers and sinks: Parquet tables, JSON lines, JSON documents, HTML blocks, binary files, keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped, broken ones go to ``_corrupt``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(df: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old_if_null: list[str] = ()) -> DataFrame:
    """Rows of ``old`` replaced by ``new`` on ``keys``; columns in ``keep_old_if_null`` keep the old value where the new one is null."""
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = o.join(n, on, "full_outer")

    def pick(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
        new_value = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_old_if_null else F.col(f"n.{c}")
        return F.when(F.col("n._new"), new_value).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*[pick(c) for c in old.columns])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def html_blocks(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, block_no, tag, text): headings, paragraphs, list items and boxes of a page, in order."""
    clean = F.regexp_replace(F.col(html), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    found = F.expr(r"regexp_extract_all(_c, '(?is)<(?:h[1-6]|p|li|footer|title)\\b[^>]*>.*?</(?:h[1-6]|p|li|footer|title)>', 0)")
    rows = pages.select(key, clean.alias("_c")).select(key, F.posexplode(found).alias("block_no", "_b"))
    text = F.trim(F.regexp_replace(F.regexp_replace("_b", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return rows.select(key, "block_no", F.lower(F.regexp_extract("_b", r"^<(\w+)", 1)).alias("tag"), text.alias("text"))


def markdown_table(rows: list[dict], columns: list[str], missing: str = "\u2014") -> str:
    """A report's rows as a Markdown table; values that are missing or null are a dash.  Driver-side: reports are small."""
    shown = lambda v: missing if v is None or v == "" else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [columns, ["---"] * len(columns), *[[shown(r.get(c)) for c in columns] for r in rows]]
    return "\n".join("| " + " | ".join(cells) + " |" for cells in lines)
