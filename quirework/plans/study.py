"""Named queries of the item bank, the manifest, the records' sinks and small text forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS, Gates, Search
from ..functions import maths
from ..functions import text as tx
from ..operators import answering, bank
from ..operators import evaluation as ev
from ..operators import grounding as gr
from ..operators import language
from ..operators import layout as lay
from ..operators import learning as lr
from ..operators import records as rec
from ..operators import references as ref
from ..sources import manifest as mf
from ..sources import shared
from ..sources import tables as src
from ..streaming import schedule
from . import tables as tb
from .catalog import _BM25, _OVER, _SUPPORT, SQL, _ct, _reranked, _reranked_sql, _supports, _with, query
from .further import _ENDNOTE

# -- items: generation, checks, review, track

_KEYED = "kc AS (SELECT id, pub_id, CASE WHEN chapter % 3 > 0 THEN chapter END AS chapter, CASE WHEN pos % 5 < 4 THEN section || (pos % 2) END AS section, pos, text, n_chars FROM chunks)"
_PICKED = """pk AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pub_id, chapter, section ORDER BY n_chars DESC, id) - 1 AS INTEGER) AS ordinal FROM kc WHERE n_chars >= 60 AND section IS NOT NULL AND pub_id <> 'src1') WHERE ordinal < 3)"""
_MADE = """mi AS (SELECT regexp_replace(pub_id, '[^A-Za-z0-9]', '', 'g') || '-c' || coalesce(chapter, 0) || '-' || substr(sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 10) || '-' || ordinal AS item_id,
  pub_id, chapter, section, ordinal, 'What is said of ' || md5(text) || '?' AS question, [length(text) || ' characters', 'by ' || pub_id] AS key_points, id AS source_chunk_id FROM pk WHERE n_chars % 7 > 0),
trk AS (SELECT *, CAST(row_number() OVER (PARTITION BY pub_id ORDER BY chapter NULLS FIRST, first, section NULLS FIRST) AS INTEGER) AS place FROM (SELECT pub_id, chapter, section, list(item_id ORDER BY ordinal, item_id) AS item_ids, min(source_chunk_id) AS first FROM mi GROUP BY ALL))"""


def _keyed(spark, d) -> DataFrame:
    c = tb.chunks(spark, d)
    section = F.when(F.col("pos") % 5 < 4, F.concat("section", (F.col("pos") % 2).cast("string")))
    return c.withColumn("chapter", F.when(F.col("chapter") % 3 > 0, F.col("chapter"))).withColumn("section", section)


def _picked(spark, d) -> DataFrame:
    """The longest chunks of each section that a resumed run has still to do: those of ``src1`` are done."""
    c = _keyed(spark, d)
    sections = c.where("section IS NOT NULL").select("pub_id", "chapter", "section").distinct()
    return bank.section_chunks(lr.undone(sections, sections.where("pub_id = 'src1'")), c, 3, 60)


def _stand_in(text):
    """A generator whose call fails for a text in seven, and which talks around its JSON."""
    said = F.concat(F.lit('Here: {"question": "What is said of '), F.md5(text), F.lit('?", "key_points": ["'), F.length(text).cast("string"), F.lit(' characters", " by '), F.col("pub_id"), F.lit('", ""]} done'))
    return F.when(F.length(text) % 7 > 0, said)


@query(_with(tb.CHUNKS, _KEYED, _PICKED) + "SELECT pub_id, chapter, section, id, ordinal FROM pk")
def section_chunks(spark, d):
    return _picked(spark, d).select("pub_id", "chapter", "section", "id", "ordinal")


@query(_with(tb.CHUNKS, _KEYED, _PICKED, _MADE) + "SELECT * FROM mi")
def generated_items(spark, d):
    return bank.generate(_picked(spark, d), _stand_in).drop("source_text")


@query(_with(tb.CHUNKS, _KEYED, _PICKED, _MADE) + "SELECT pub_id, chapter, section, item_ids, place FROM trk")
def generated_track(spark, d):
    return bank.track_of(bank.generate(_picked(spark, d), _stand_in))


@query(_with(tb.CHUNKS, _KEYED, _PICKED, _MADE) + "SELECT DISTINCT pub_id, section, item_id, CAST(pos - 1 AS INTEGER) AS pos FROM (SELECT pub_id, section, unnest(item_ids) AS item_id, generate_subscripts(item_ids, 1) AS pos, chapter FROM trk) WHERE pub_id = 'src2' AND item_id IN (SELECT item_id FROM mi WHERE source_chunk_id % 2 = 0)")
def practice_pool(spark, d):
    items = bank.generate(_picked(spark, d), _stand_in)
    return bank.servable_track(bank.track_of(items), items.where("source_chunk_id % 2 = 0"), pub="src2").select("pub_id", "section", "item_id", "pos").distinct()


_GROUNDS = """gp AS (SELECT vec_id // 10 AS item_id, vec_id % 10 AS no, CASE WHEN vec_id % 97 > 0 THEN CAST(embedding AS DOUBLE[]) END AS v FROM embeddings),
gb AS (SELECT DISTINCT item_id FROM gp WHERE v IS NULL),
gg AS (SELECT item_id, point_no, CASE WHEN item_id NOT IN (SELECT item_id FROM gb) THEN CAST(format('{:.2f}', b) AS DOUBLE) END AS best, CASE WHEN item_id IN (SELECT item_id FROM gb) THEN 'PRECHECK_FAILED' WHEN b < 0.62 THEN 'UNGROUNDED_KEY_POINT' END AS code
  FROM (SELECT p.item_id AS item_id, p.no AS point_no, coalesce(max(CASE WHEN p.v IS NOT NULL AND s.v IS NOT NULL THEN list_cosine_similarity(p.v, s.v) END), 0) AS b FROM gp p LEFT JOIN gp s ON s.item_id = p.item_id AND s.no >= 3 WHERE p.no < 3 GROUP BY ALL))"""


def _grounds(spark, d) -> DataFrame:
    """Vectors in tens: three key points and their source's sentences; some vectors never came back."""
    e = src.table(spark, d, "embeddings").select(F.expr("vec_id div 10").alias("item_id"), (F.col("vec_id") % 10).alias("no"), F.when(F.col("vec_id") % 97 > 0, F.col("embedding")).alias("vec"))
    return bank.ungrounded(e.where("no < 3").withColumnRenamed("no", "point_no"), e.where("no >= 3").withColumnRenamed("no", "sent_no"))


@query(_with(_GROUNDS) + "SELECT item_id, point_no, best, code FROM gg")
def ungrounded_points(spark, d):
    return _grounds(spark, d)


_APPARATUS = rf"coalesce(nullif(regexp_extract(s, '(?i){ref.LATIN}'), ''), nullif(regexp_extract(s, '(?i){ref.SOURCES}'), ''), nullif(regexp_extract(s, '{ref.IMPRINT}'), ''), nullif(regexp_extract(s, '(?:^|[^\w-])({_ENDNOTE})', 1), ''))"


@query(_with(_GROUNDS) + f""", it AS (SELECT doc_id, text AS q, CASE WHEN doc_id % 6 = 0 THEN '7. Ibid., p. 1-6. ' || text ELSE text END AS s FROM documents),
wk AS (SELECT item_id, CASE WHEN bool_or(code = 'PRECHECK_FAILED') THEN ['PRECHECK_FAILED:'] ELSE list(code || ':' || coalesce(CAST(best AS VARCHAR), '') ORDER BY point_no) END AS g FROM gg WHERE code IS NOT NULL GROUP BY 1)
SELECT doc_id AS item_id, list_concat(['SHAPE:'], list_concat(CASE WHEN len({_ct('q')}) > 0 THEN ['ANSWER_LEAKED:'] ELSE [] END, list_concat(CASE WHEN {_APPARATUS} IS NOT NULL THEN ['SOURCE_NOT_TEACHABLE:' || {_APPARATUS}] ELSE [] END, coalesce(g, [])))) AS flags FROM it LEFT JOIN wk ON item_id = doc_id""")
def prechecked_items(spark, d):
    """Whole texts as questions that give their own key point away; flags with details, grounding among them."""
    docs = src.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("question"), F.array("lang", "text").alias("key_points"), F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("7. Ibid., p. 1-6. "), "text")).otherwise(F.col("text")).alias("source_text"))
    flags = bank.precheck(docs, _grounds(spark, d))
    return flags.select("item_id", F.transform("flags", lambda x: F.concat(x["code"], F.lit(":"), x["detail"])).alias("flags"))


_SEV = "CAST(CASE WHEN list_contains(flags, 'UNGROUNDED_KEY_POINT') THEN 2 WHEN len(flags) > 0 THEN 1 ELSE 0 END AS INTEGER)"
_BANK = "bk AS (SELECT item_id, question FROM items)"


@query(_with(tb.ATTEMPTS, tb.ITEMS, tb.REVIEWS) + f"SELECT item_id, question, {_SEV} AS severity, CAST(coalesce(len(flags), 0) AS INTEGER) AS n_flags FROM reviews JOIN items USING (item_id) WHERE status = 'pending' ORDER BY severity DESC, n_flags DESC, item_id LIMIT 200")
def review_queue(spark, d):
    return bank.queue(tb.reviews(spark, d), tb.items(spark, d))


@query(_with(tb.ATTEMPTS, tb.ITEMS, tb.REVIEWS) + "SELECT item_id, CASE WHEN len(flags) = 0 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN len(flags) = 0 THEN 'bulk:unflagged' END AS reviewer, flags IS NOT NULL AS checked FROM (SELECT item_id, 'pending' AS status, CASE WHEN item_id % 4 = 0 THEN [] ELSE flags END AS flags FROM reviews) r WHERE item_id IN (SELECT item_id FROM items)")
def bulk_unflagged(spark, d):
    r = tb.reviews(spark, d).withColumn("status", F.lit("pending")).withColumn("flags", F.when(F.col("item_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("flags")))
    return bank.bulk_approve(r, tb.items(spark, d))


@query(_with(tb.ATTEMPTS, tb.ITEMS, tb.REVIEWS) + "SELECT item_id, coalesce(nullif(edited_question, ''), question) AS question, CASE WHEN r.item_id % 2 = 0 THEN ['one', 'two'] ELSE ['own'] END AS key_points FROM items LEFT JOIN reviews r USING (item_id)")
def edited_items(spark, d):
    points = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("one"), F.lit("two"))).otherwise(F.array().cast("array<string>"))
    items = tb.items(spark, d).select("item_id", "question", F.array(F.lit("own")).alias("key_points"))
    return bank.with_edits(items, tb.reviews(spark, d).withColumn("edited_points", points))


@query(_with(_SUPPORT) + "SELECT query_id, coalesce(min(support), 1.0) AS min_support, coalesce(min(support), 1.0) < 0.3 AS refuse FROM (SELECT DISTINCT vec_id // 10 AS query_id FROM embeddings) LEFT JOIN (SELECT * FROM sup WHERE query_id % 4 > 0) USING (query_id) GROUP BY 1")
def gated_answers(spark, d):
    answers = src.table(spark, d, "embeddings").select(F.expr("vec_id div 10").alias("query_id"))
    return bank.gate_answers(answers, _supports(spark, d).where("query_id % 4 > 0"), 0.3)


# -- layout

_SEQ = "sq AS (SELECT chapter AS doc, pos // 10 AS chapter, CASE WHEN n_chars % 3 > 0 THEN 's' || (n_chars % 2) END AS section, pos FROM chunks)"


@query(_with(tb.CHUNKS, _SEQ) + "SELECT doc, chapter, pos, CAST(sum(c) OVER (PARTITION BY doc, chapter ORDER BY pos) AS BIGINT) AS section_seq FROM (SELECT *, CASE WHEN section IS DISTINCT FROM lag(section) OVER (PARTITION BY doc, chapter ORDER BY pos) THEN 1 ELSE 0 END AS c FROM sq)")
def section_counter(spark, d):
    c = tb.chunks(spark, d).select(F.col("chapter").alias("doc"), F.expr("pos div 10").alias("chapter"), F.when(F.col("n_chars") % 3 > 0, F.concat(F.lit("s"), (F.col("n_chars") % 2).cast("string"))).alias("section"), "pos")
    return lay.section_counter(c, True).select("doc", "chapter", "pos", "section_seq")


@query(_with(tb.CHUNKS) + r"SELECT chapter AS doc, CAST(pos % 4 - 1 AS INTEGER) AS start, CAST(1 + pos % 2 AS INTEGER) AS level, trim(regexp_replace('  ' || text || '  end ', '\s+', ' ', 'g')) AS title FROM chunks WHERE pos % 4 >= 1")
def outline_entries(spark, d):
    c = tb.chunks(spark, d)
    return lay.clean_outline(c.select(F.col("chapter").alias("doc"), (F.col("pos") % 4).cast("int").alias("page"), (1 + F.col("pos") % 2).cast("int").alias("level"), F.concat(F.lit("  "), "text", F.lit("  end ")).alias("title")))


@query(_with(tb.CHUNKS) + """SELECT pub_id, count(*) AS chunks, CAST(format('{:.1f}', 100 * avg(CASE WHEN pos % 3 > 0 THEN 1 ELSE 0 END)) AS DOUBLE) AS pct_with_page, CAST(format('{:.1f}', 100 * avg(CASE WHEN n_chars % 4 > 0 THEN 1 ELSE 0 END)) AS DOUBLE) AS pct_with_section,
CAST(format('{:.1f}', 100 * avg(CASE WHEN n_chars >= 80 THEN 1 ELSE 0 END)) AS DOUBLE) AS pct_spanning, CAST(floor(median(n_chars)) AS INTEGER) AS median_chars, list_sort(list(DISTINCT id) FILTER (WHERE n_chars < 4))[1:8] AS unmatched FROM chunks GROUP BY 1""")
def chunk_report(spark, d):
    c = tb.chunks(spark, d)
    return lay.chunk_report(c.select("pub_id", "n_chars", (F.col("pos") % 3 > 0).alias("has_page"), (F.col("n_chars") % 4 > 0).alias("has_section"), (F.col("n_chars") >= 80).alias("spans"), F.when(F.col("n_chars") < 4, F.col("id")).alias("unmatched")))


# -- manifest

_FILES = "sl AS (SELECT page_id, 'f' || (page_id % 40) || '.pdf' AS file, url FROM pages), sc AS (SELECT 'f' || doc_id || '.pdf' AS file, toxic AS blocking, quality AS statement FROM labels WHERE doc_id < 40)"


@query(_with(_FILES) + "SELECT page_id, file, url, blocking, statement FROM sl LEFT JOIN sc USING (file) WHERE file IN (SELECT 'f' || (doc_id % 33) || '.pdf' FROM documents)")
def manifest_sources(spark, d):
    name = lambda k: F.concat(F.lit("f"), k.cast("string"), F.lit(".pdf")).alias("file")
    sources = src.table(spark, d, "pages").select("page_id", name(F.col("page_id") % 40), "url")
    files = src.table(spark, d, "documents").select(name(F.col("doc_id") % 33))
    found = src.table(spark, d, "labels").where("doc_id < 40").select(name(F.col("doc_id")), F.col("toxic").alias("blocking"), F.col("quality").alias("statement"))
    return mf.joined(sources, files, found).select("page_id", "file", "url", "blocking", "statement")


@query("SELECT doc_id, source AS pub_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND contains(lower(source), 'src1')")
def cleared_documents(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", F.col("source").alias("pub_id")).join(src.table(spark, d, "labels"), "doc_id", "left")
    return mf.cleared_documents(docs.withColumn("cleared", F.col("quality") == 1), "SRC1").select("doc_id", "pub_id")


@query(_with(tb.CHUNKS) + "SELECT chapter AS doc, list(CAST(pos AS INTEGER) ORDER BY pos) AS pages FROM chunks WHERE n_chars % 5 = 0 AND pos % 3 = 0 GROUP BY 1")
def blind_spot_pages(spark, d):
    c = tb.chunks(spark, d)
    return mf.blind_spots(c.select(F.col("chapter").alias("doc"), F.col("pos").alias("page"), F.when(F.col("n_chars") % 5 > 0, F.concat(F.lit("x"), "text")).otherwise(" ").alias("text"), (F.col("pos") % 3 == 0).alias("has_image")))


@query("SELECT DISTINCT 'source' || (doc_id % 5) AS key, CASE WHEN doc_id % 5 = 2 THEN 'new' ELSE 'old' END AS value FROM documents UNION ALL SELECT 'built_by', 'quirework'")
def index_provenance(spark, d):
    old = src.table(spark, d, "documents").select(F.concat(F.lit("source"), (F.col("doc_id") % 5).cast("string")).alias("key"), F.lit("old").alias("value")).distinct()
    return mf.provenance(old, {"source2": "new", "built_by": "quirework"})


# -- records

def _written(spark, d) -> DataFrame:
    """All events in two batches of which one came twice."""
    path = f"{shared.folder(spark)}/quirework/interactions-{uuid.uuid4().hex}"
    rows = tb.interactions(spark, d)
    for batch in (0, 1, 1):
        rec.append(rows.where(F.col("seq") % 2 == batch), path, batch)
    return rec.appended(spark, path)


@query(SQL["xapi_statements"])
def appended_statements(spark, d):
    return _written(spark, d).select("seq", "statement_json")


@query("SELECT event_id AS seq FROM events WHERE event_id % 3 > 0")
def pending_exports(spark, d):
    path = f"{shared.folder(spark)}/quirework/exports-{uuid.uuid4().hex}"
    rows = tb.interactions(spark, d)
    for part in (0, 3):
        rec.mark_exported(rows.where(F.col("seq") % 6 == part), path, part)
    return rec.pending(rows, spark.read.parquet(path)).select("seq")


@query("SELECT event_id AS seq, event_type AS question FROM events ORDER BY event_id DESC LIMIT 20")
def recent_interactions(spark, d):
    return tb.interactions(spark, d).orderBy(F.desc("seq")).limit(20).select("seq", "question")


@query("SELECT event_id, ts > TIMESTAMP '2020-01-01' AS trusted FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN TIMESTAMP '1970-01-01 00:05:00' ELSE ts END AS ts FROM events)")
def clock_checks(spark, d):
    at = F.when(F.col("event_id") % 10 == 0, F.lit("1970-01-01 00:05:00").cast("timestamp_ntz")).otherwise(F.col("ts").cast("timestamp_ntz"))
    return src.table(spark, d, "events").select("event_id", maths.clock_trusted(at).alias("trusted"))


@query("SELECT CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS start, event_type, arg_max(value, epoch(ts)) AS value, CAST(floor(max(epoch(ts))) AS BIGINT) AS at FROM events GROUP BY ALL")
def latest_samples(spark, d):
    e = src.table(spark, d, "events").withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)))"))
    s = schedule.latest_samples(e, "event_type", "ts")
    return s.select(F.col("window.start").cast("long").alias("start"), "event_type", "value", F.col("at").cast("long").alias("at"))


# -- small forms

@query("SELECT doc_id, CASE WHEN n_chars IS NULL OR n_chars % 9 = 0 THEN 'n/a' ELSE format('{:.1f}%', 100.0::DOUBLE * (doc_id % 7) / (n_chars % 9)) END AS share FROM documents")
def percent_texts(spark, d):
    return src.table(spark, d, "documents").select("doc_id", maths.percent_text(F.col("doc_id") % 7, F.col("n_chars") % 9).alias("share"))


@query("SELECT event_id, strftime(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS text FROM events")
def epoch_texts(spark, d):
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return src.table(spark, d, "events").select("event_id", maths.epoch_text(seconds).alias("text"))


@query("""SELECT conv_id, turn, CASE WHEN k = 0 THEN 'SUPPORTED' WHEN k = 3 THEN 'CONTRADICTED' ELSE 'NOT_SUPPORTED' END AS label FROM (SELECT conv_id, turn, turn % 5 AS k FROM conversations)""")
def support_labels(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in ("It is supported.", "not supported", "Unsupported", "This contradicts it; supported elsewhere", "maybe")]), (F.col("turn") % 5 + 1).cast("int"))
    return src.table(spark, d, "conversations").select("conv_id", "turn", tx.support_label(said).alias("label"))


@query(_with(tb.CHUNKS) + r""", hy AS (SELECT chapter AS doc, pos, CASE WHEN pos % 3 = 0 THEN text || 'wo-' WHEN pos % 3 = 1 THEN 'rd ' || text ELSE text || '--' END AS l FROM chunks),
jn AS (SELECT doc, pos, l, lead(l) OVER (PARTITION BY doc ORDER BY pos) AS nxt FROM hy)
SELECT doc, md5(string_agg(CASE WHEN nxt IS NULL THEN l WHEN regexp_matches(l, '(^|[^-])-$') AND regexp_matches(nxt, '^\p{Ll}') THEN left(l, length(l) - 1) WHEN l = '' THEN '' ELSE l || ' ' END, '' ORDER BY pos)) AS digest FROM jn GROUP BY 1""")
def dehyphenated(spark, d):
    """Lines of each document joined; a word parted at a line's end comes together."""
    p = F.col("pos") % 3
    line = F.when(p == 0, F.concat("text", F.lit("wo-"))).when(p == 1, F.concat(F.lit("rd "), "text")).otherwise(F.concat("text", F.lit("--")))
    lines = tb.chunks(spark, d).groupBy(F.col("chapter").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("ls"))
    return lines.select("doc", F.md5(tx.dehyphenated(F.transform("ls", lambda x: x["l"]))).alias("digest"))


@query(_with(tb.RECORDS) + "SELECT id, kind, top_score FROM records")
def tagged_records(spark, d):
    """In- and out-of-corpus questions in one bag, each with its kind."""
    r = tb.records(spark, d)
    part = lambda k: r.where(F.col("kind") == k).select("id", "top_score")
    return ev.bag(part("in"), part("out")).select("id", "kind", "top_score")


_PROBED = "pb AS (SELECT id, kind, kind = 'out' AND expects AS expects, declined AS abstained, value FROM records LEFT JOIN (SELECT doc_id AS id, max(strlen(l) / 10.0::DOUBLE) AS value FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS l FROM documents WHERE doc_id % 3 > 0) GROUP BY 1) USING (id) WHERE error IS NULL)"


@query(_with(tb.RECORDS, _PROBED) + "SELECT * FROM pb")
def rescue_probes(spark, d):
    """Questions that were decided, with the best of several signals where there is one."""
    r = tb.records(spark, d)
    words = src.table(spark, d, "documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("id"), F.explode(F.split("text", " ")).alias("l"))
    signals = words.select("id", (F.octet_length("l") / 10.0).alias("bm25"))
    return ev.probes(r.select("id", "kind", "expects"), r.where("error IS NULL").select("id", F.col("declined").alias("abstained")), signals)


@query("SELECT conv_id, turn FROM conversations WHERE turn % 3 = 0 AND role = 'user'")
def scored_questions(spark, d):
    labels = F.when(F.col("role") == "user", F.array("role")).otherwise(F.when(F.col("turn") % 2 == 0, F.array().cast("array<string>")))
    q = src.table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 3 == 0).alias("score_retrieval"), labels.alias("labels"))
    return ev.scored_questions(q.withColumn("query_id", F.lit(0)))[0].select("conv_id", "turn")


@query("SELECT conv_id, turn, 'event: ' || role || chr(10) || 'data: ' || replace(text, chr(10), chr(10) || 'data: ') || chr(10) || chr(10) AS frame FROM conversations")
def event_frames(spark, d):
    return src.table(spark, d, "conversations").select("conv_id", "turn", tx.event_frame("role", "text").alias("frame"))


@query("SELECT doc_id, " + ", ".join(f"length(left(text, {n})) AS {k}" for k, n in LIMITS.items()) + " FROM documents")
def text_limits(spark, d):
    """How much of each whole text every limit keeps."""
    return src.table(spark, d, "documents").select("doc_id", *[F.length(tx.limited("text", k)).cast("long").alias(k) for k in LIMITS])


@query()
def heading_matches(spark, d):
    """Whole headings of all pages against a contents list (no SQL form: Ratcliff-Obershelp ratios)."""
    h = tb.blocks(spark, d).where("tag IN ('h1', 'h2', 'title')").select("page_id", "block_no", F.col("text").alias("heading"))
    return language.match_headings(h, ["La eau", "The end", "Der die das", "Contents"])


@query(_with(_SUPPORT) + "SELECT query_id, string_agg(CASE WHEN support < 0.5 THEN 'sentence ' || sent_no || ' [UNSUPPORTED]' ELSE 'sentence ' || sent_no END, ' ' ORDER BY sent_no) AS answer FROM sup GROUP BY 1")
def marked_answers(spark, d):
    s = _supports(spark, d).withColumn("sentence", F.concat(F.lit("sentence "), F.col("sent_no").cast("string")))
    return gr.rewritten(s, 0.5)


# -- questions to answers

_ANSWERED = f"""top AS (SELECT query_id, count(*) AS n, arg_min(rerank_score, rank) AS top_score, arg_min(source, rank) AS citation, arg_min(text, rank) AS body FROM rr JOIN documents USING (doc_id) WHERE rank <= 8 GROUP BY 1),
aa AS (SELECT item_id AS query_id, top_score, citation, CASE WHEN n IS NULL THEN 'no_results' WHEN top_score IS NULL OR top_score < 0.5 THEN 'low_retrieval_score' END AS gate,
  CASE WHEN length(body) < 40 THEN 'NOT_IN_SOURCES' ELSE string_split(regexp_replace(trim(body), '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))[1] || ' [1]' END AS said FROM benchmark LEFT JOIN top ON query_id = item_id)"""


@query(f"WITH {_BM25}, {_OVER}, {_reranked_sql(8)}, {_ANSWERED} SELECT query_id, top_score, r AS reason, CASE WHEN r IS NULL THEN said END AS answer, CASE WHEN r IS NULL THEN [citation] END AS cited FROM (SELECT *, coalesce(gate, CASE WHEN contains(said, 'NOT_IN_SOURCES') THEN 'model_declined' END) AS r FROM aa)")
def answered_questions(spark, d):
    """Every question through retrieval, scoring, the gates and a stand-in generator."""
    q = src.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    docs = src.table(spark, d, "documents").select("doc_id", F.col("source").alias("citation"), "text")
    best = _reranked(spark, d, Search().final_k).select("query_id", "doc_id", "rank", "rerank_score", F.col("first_score").alias("bm25_score"))
    hits = docs.join(shared.saved(best, "reranked"), "doc_id")
    return answering.answer(answering.assembled(q, hits), answering.extractive, Gates(score=0.5))
