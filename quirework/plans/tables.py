"""The supplied tables in the roles of the engine's own, in Spark and, as views of the same name, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths
from ..sources import tables as src


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as chunks.  id: doc_id, then 28 bits for the line, more than a text of 2 GB can have lines with a word on them."""
    docs = src.table(spark, d, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return docs.select((F.shiftleft("doc_id", 28) + F.col("pos") + 1).alias("id"), F.col("source").alias("pub_id"), F.col("lang").alias("section"), F.col("doc_id").alias("chapter"), "pos", "text", F.length("text").alias("n_chars"))


CHUNKS = """chunks AS (SELECT doc_id * 268435456 + i AS id, source AS pub_id, lang AS section, doc_id AS chapter, CAST(i - 1 AS INTEGER) AS pos, t AS text, CAST(length(t) AS INTEGER) AS n_chars
  FROM (SELECT doc_id, source, lang, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)))"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    e = src.table(spark, d, "events")
    verdict = F.when(F.col("event_type").isin("purchase", "signup"), "correct").when(F.col("event_type") == "error", "incorrect").otherwise("partial")
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    score = maths.verdict_score(verdict)
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("learner"), F.get_json_object("props", "$.k").cast("int").alias("item_id"), verdict.alias("verdict"), score.alias("score"), (1 + F.col("event_id") % 4).cast("int").alias("confidence"), at.alias("at"))


ATTEMPTS = """attempts AS (SELECT seq, learner, item_id, verdict, CASE verdict WHEN 'correct' THEN 1.0 WHEN 'incorrect' THEN 0.0 ELSE 0.5 END::DOUBLE AS score, confidence, at_s FROM (
  SELECT event_id AS seq, user_id AS learner, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item_id,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'correct' WHEN event_type = 'error' THEN 'incorrect' ELSE 'partial' END AS verdict,
  CAST(1 + event_id % 4 AS INTEGER) AS confidence, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM events))"""


def items(spark: SparkSession, d: str) -> DataFrame:
    k = attempts(spark, d).select("item_id").distinct()
    return k.select("item_id", F.col("item_id").alias("pos"), F.concat(F.lit("p"), F.col("item_id") % 3).alias("pub_id"), F.concat(F.lit("s"), F.col("item_id") % 10).alias("section"), F.concat(F.lit("question "), F.col("item_id")).alias("question"))


ITEMS = "items AS (SELECT DISTINCT item_id, item_id AS pos, 'p' || (item_id % 3) AS pub_id, 's' || (item_id % 10) AS section, 'question ' || item_id AS question FROM attempts)"


def reviews(spark: SparkSession, d: str) -> DataFrame:
    j = src.table(spark, d, "documents").select("doc_id", "source").join(src.table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "approved").otherwise("rejected")
    flags = F.when(F.col("toxic").isNull(), F.lit(None).cast("array<string>")).when(F.col("toxic") == 0, F.array().cast("array<string>")).when(F.col("quality") == 0, F.array(F.lit("UNGROUNDED_KEY_POINT"), F.lit("SHAPE"))).otherwise(F.array(F.lit("SHAPE")))
    return j.select(F.col("doc_id").alias("item_id"), status.alias("status"), flags.alias("flags"), F.when(F.col("quality") == 1, F.concat(F.lit("edited "), F.col("source"))).otherwise("").alias("edited_question"))


REVIEWS = """reviews AS (SELECT doc_id AS item_id, CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS status,
  CASE WHEN toxic IS NULL THEN NULL WHEN toxic = 0 THEN [] WHEN quality = 0 THEN ['UNGROUNDED_KEY_POINT', 'SHAPE'] ELSE ['SHAPE'] END AS flags,
  CASE WHEN quality = 1 THEN 'edited ' || source ELSE '' END AS edited_question FROM documents LEFT JOIN labels USING (doc_id))"""


def records(spark: SparkSession, d: str) -> DataFrame:
    j = src.table(spark, d, "documents").select("doc_id", "source", "n_chars").join(src.table(spark, d, "labels"), "doc_id")
    return j.select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "in").otherwise("out").alias("kind"), F.col("source").alias("pub_id"), (F.col("doc_id") % 4 == 0).alias("expects"),
        F.when(F.col("doc_id") % 11 != 0, F.round(F.col("n_chars") % 1000 / 100.0 - 5, 3)).alias("top_score"), (F.col("n_chars") % 101 / 100.0).alias("min_support"),
        (F.col("n_chars") % 3).alias("n_claims"), (F.col("doc_id") % 17 == 0).alias("declined"), F.when(F.col("doc_id") % 29 == 0, "timeout").alias("error"), (F.col("n_chars") / 1000.0).alias("latency"),
    )


RECORDS = """records AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'in' ELSE 'out' END AS kind, source AS pub_id, doc_id % 4 = 0 AS expects,
  CASE WHEN doc_id % 11 <> 0 THEN round(n_chars % 1000 / 100.0::DOUBLE - 5, 3) END AS top_score, n_chars % 101 / 100.0::DOUBLE AS min_support,
  n_chars % 3 AS n_claims, doc_id % 17 = 0 AS declined, CASE WHEN doc_id % 29 = 0 THEN 'timeout' END AS error, n_chars / 1000.0::DOUBLE AS latency FROM documents JOIN labels USING (doc_id))"""


def interactions(spark: SparkSession, d: str) -> DataFrame:
    e = src.table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("question"), (F.col("event_type") != "error").alias("answered"), F.col("value").alias("latency_s"), F.col("props").alias("answer_text"))


INTERACTIONS = "interactions AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS actor, event_type AS question, event_type <> 'error' AS answered, value AS latency_s, props AS answer_text FROM events)"


def answers(spark: SparkSession, d: str) -> DataFrame:
    c = src.table(spark, d, "conversations").where("role = 'assistant'")
    mark = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" ["), F.col("turn") % 5, F.lit("]")))
    return c.select("conv_id", F.col("turn").cast("long").alias("turn"), mark.alias("answer"), (F.col("turn") % 4).cast("int").alias("n_chunks"))


ANSWERS = "answers AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN turn % 3 = 0 THEN text ELSE text || ' [' || (turn % 5) || ']' END AS answer, CAST(turn % 4 AS INTEGER) AS n_chunks FROM conversations WHERE role = 'assistant')"


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return src.html_blocks(src.table(spark, d, "pages"))


BLOCKS = r"""blocks AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS block_no, lower(regexp_extract(b, '^<(\w+)', 1)) AS tag, trim(regexp_replace(regexp_replace(b, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text
  FROM (SELECT page_id, unnest(l) AS b, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?is)<(?:h[1-6]|p|li|footer|title)\b[^>]*>.*?</(?:h[1-6]|p|li|footer|title)>') AS l FROM pages)))"""
