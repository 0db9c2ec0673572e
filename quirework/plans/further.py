"""Further named queries: references, page structure, manifest, review work, tuning, event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import gates
from ..operators import layout as lay
from ..operators import learning as lr
from ..operators import records as rec
from ..operators import references as ref
from ..sources import manifest as mf
from ..sources import tables as src
from ..streaming import windows as win
from . import tables as tb
from .catalog import _BM25, _FUSED, _LINES, _OVER, SQL, _best, _lines, _with, query, threshold_grid

# -- references and page structure

_NOTED = """noted AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '7. Ibid., p. 1-6. ' || text WHEN 1 THEN text || ' as op.  cit. says' WHEN 2 THEN 'Principal sources used: ' || text
  WHEN 3 THEN '(Washington, D.C.: Press, April 1992) ' || text WHEN 4 THEN '6. War, pp. 4-21 and p. 30. 18. Tempo ' || text ELSE text END AS text FROM documents)"""


def _noted(spark, d):
    n, t = F.col("doc_id") % 6, F.col("text")
    put = lambda a: F.concat(F.lit(a), t)
    text = F.when(n == 0, put("7. Ibid., p. 1-6. ")).when(n == 1, F.concat(t, F.lit(" as op.  cit. says"))).when(n == 2, put("Principal sources used: ")).when(n == 3, put("(Washington, D.C.: Press, April 1992) ")).when(n == 4, put("6. War, pp. 4-21 and p. 30. 18. Tempo ")).otherwise(t)
    return src.table(spark, d, "documents").select("doc_id", text.alias("text"))



_ENDNOTE = ref.ENDNOTE.removeprefix(r"(?<![\w-])")  # SQL has no look-behind: the query takes the character before apart


@query(_with(_NOTED) + rf"""SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?i){ref.LATIN}'), ''), nullif(regexp_extract(text, '(?i){ref.SOURCES}'), ''), nullif(regexp_extract(text, '{ref.IMPRINT}'), ''),
nullif(regexp_extract(text, '(?:^|[^\w-])({_ENDNOTE})', 1), '')) AS reference FROM noted""")
def reference_apparatus(spark, d):
    return _noted(spark, d).select("doc_id", ref.apparatus("text").alias("reference"))


@query()
def endnotes_stripped(spark, d):
    """No SQL form (possessive repeats); held against fixtures."""
    return _noted(spark, d).select("doc_id", F.md5(ref.without_head("text")).alias("digest"))


_NUMBERED = "numbered AS (SELECT chapter AS doc, pos // 8 AS page, pos AS line_no, CASE WHEN pos % 8 = 5 THEN (chapter % 9) || '-' || pos WHEN pos % 8 = 7 THEN 'A-' || pos ELSE text END AS text FROM chunks)"


@query(_with(tb.CHUNKS, _NUMBERED) + rf"""SELECT doc, CAST(page AS INTEGER) AS page, trim(arg_min(text, line_no) FILTER (WHERE regexp_matches(trim(text), '{lay.PAGE_NUMBER}'))) AS label,
count(*) FILTER (WHERE NOT regexp_matches(trim(text), '{lay.PAGE_NUMBER}')) AS n_body FROM numbered GROUP BY ALL""")
def page_numbers(spark, d):
    c, p = tb.chunks(spark, d), F.col("pos")
    text = F.when(p % 8 == 5, F.concat((F.col("chapter") % 9).cast("string"), F.lit("-"), p.cast("string"))).when(p % 8 == 7, F.concat(F.lit("A-"), p.cast("string"))).otherwise(F.col("text"))
    return lay.page_numbers(c.select(F.col("chapter").alias("doc"), F.floor(p / 8).cast("int").alias("page"), p.alias("line_no"), text.alias("text")))


@query(_with(tb.BLOCKS, _LINES, """g AS (SELECT *, y - lag(y) OVER (PARTITION BY doc, page ORDER BY line_no) AS gap, round_even(x, 0) AS rx FROM ln)""",
"fo AS (SELECT doc, page, font, count(*) AS n, min(line_no) AS first FROM g GROUP BY ALL)", "xs AS (SELECT doc, page, rx, count(*) AS n, min(line_no) AS first FROM g GROUP BY ALL)",
"bf AS (SELECT doc, page, count(*) AS fonts, max(n) AS n, arg_max(font, n * 1000000 - first) AS font FROM fo GROUP BY ALL)", "bx AS (SELECT doc, page, arg_max(rx, n * 1000000 - first) AS margin FROM xs GROUP BY ALL)",
"st AS (SELECT doc, page, coalesce(median(gap) FILTER (WHERE gap > 0 AND gap < 60), 12.0)::DOUBLE AS lead_gap, median(size) AS body_size, count(*) AS k FROM g GROUP BY ALL)") + """
SELECT doc, page, lead_gap AS "leading", body_size, CASE WHEN n >= 0.6 * k AND fonts > 1 THEN font END AS body_font, margin FROM st JOIN bf USING (doc, page) JOIN bx USING (doc, page)""")
def page_statistics(spark, d):
    return lay.page_statistics(_lines(spark, d))


@query(_with(tb.BLOCKS) + "SELECT page_id AS doc, count(*) FILTER (WHERE tag = 'li') > count(*) FILTER (WHERE tag IN ('h1', 'p')) AS has_sections FROM blocks WHERE tag IN ('h1', 'p', 'li') GROUP BY 1")
def outline_levels(spark, d):
    o = tb.blocks(spark, d).where("tag IN ('h1', 'p', 'li')")
    return lay.outline_levels(o.select(F.col("page_id").alias("doc"), F.when(F.col("tag") == "li", 2).otherwise(1).alias("level")))


_CONTENTS = r"""contents AS (SELECT page_id AS doc, 'Contents' || chr(10) || string_agg('Chapter ' || (block_no % 3 + 1) || '.' || chr(10) || regexp_replace(text, '[^a-zA-Z]+', ' ', 'g') || ' x' || chr(10) ||
  'First part—' || chr(10) || regexp_replace(text, '[^a-zA-Z]+', '--', 'g') || '— .', chr(10) ORDER BY block_no) AS text FROM blocks WHERE tag IN ('h1', 'p') GROUP BY 1),
en AS (SELECT doc, unnest(l) AS e, generate_subscripts(l, 1) AS nr FROM (SELECT doc, string_split(text, 'Chapter ')[2:] AS l FROM contents)),
sp AS (SELECT doc, nr, CAST(regexp_extract(e, '^(\d+)', 1) AS INTEGER) AS chapter, trim(regexp_extract(e, '^\d+\.?\s*\n\s*([^\n]{3,80})\n', 1)) AS title,
  list_filter(list_transform(string_split_regex(trim(regexp_replace(regexp_replace(e, '^\d+\.?\s*\n\s*[^\n]{3,80}\n', ''), '\s*\n\s*', ' ', 'g')), '\s*[—–]+\s*|\s*-{2,}\s*'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'), ' .-—')), lambda s: length(s) BETWEEN 3 AND 69) AS sections FROM en WHERE regexp_matches(e, '^\d+\.?\s*\n\s*[^\n]{3,80}\n'))"""


@query(_with(tb.BLOCKS, _CONTENTS) + "SELECT doc, chapter, title, sections FROM (SELECT *, row_number() OVER (PARTITION BY doc, chapter ORDER BY len(sections) DESC, nr) AS r FROM sp) WHERE r = 1")
def printed_contents(spark, d):
    b = tb.blocks(spark, d).where("tag IN ('h1', 'p')")
    plain = lambda x, s: F.regexp_replace(x, "[^a-zA-Z]+", s)
    part = F.concat(F.lit("Chapter "), (F.col("block_no") % 3 + 1).cast("string"), F.lit(".\n"), plain("text", " "), F.lit(" x\nFirst part—\n"), plain("text", "--"), F.lit("— ."))
    g = b.groupBy(F.col("page_id").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("block_no", part.alias("t")))).alias("p"))
    return lay.printed_contents(g.select("doc", F.lit(0).alias("page"), F.concat(F.lit("Contents\n"), F.array_join(F.transform("p", lambda x: x["t"]), "\n")).alias("text")))


_HEADS = """heads AS (SELECT id, CASE id % 5 WHEN 0 THEN upper(t) || ' 10 IN 5' WHEN 1 THEN 'OI  May 2026' WHEN 2 THEN 'Notes' WHEN 3 THEN t || ' (continued)' ELSE t END AS h FROM (SELECT id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM chunks))"""


@query(_with(tb.CHUNKS, _HEADS, r"k AS (SELECT id, h, trim(regexp_replace(h, '\s+', ' ', 'g')) AS t, regexp_replace(h, '[^\p{L}]', '', 'g') AS l FROM heads)") + r"""SELECT id,
CASE WHEN length(l) > 0 AND length(regexp_replace(l, '[^\p{Lu}]', '', 'g')) >= 0.75 * length(l) THEN array_to_string(list_transform(regexp_extract_all(lower(trim(regexp_replace(translate(t, '0158', 'OISB'), '\s+', ' ', 'g'))), '\p{L}+|[^\p{L}]+'), lambda r: upper(r[1]) || substr(r, 2)), '') ELSE t END AS heading,
regexp_matches(trim(h), '^[\dOoIl]{1,2}\s+\w{3,9}\s+[\dOoIl]{4}$') OR length(trim(h)) < 4 OR NOT regexp_matches(trim(h), '\p{L}') OR lower(trim(h)) IN ('and', 'or', 'note', 'notes', 'continued') AS noise FROM k""")
def heading_cleanup(spark, d):
    """Every line of every document as a heading, whole."""
    n, plain = F.col("id") % 5, F.regexp_replace("text", "[^ -~]", "")
    h = F.when(n == 0, F.concat(F.upper(plain), F.lit(" 10 IN 5"))).when(n == 1, "OI  May 2026").when(n == 2, "Notes").when(n == 3, F.concat(plain, F.lit(" (continued)"))).otherwise(plain)
    return tb.chunks(spark, d).select("id", h.alias("h")).select("id", lay.clean_heading("h").alias("heading"), lay.heading_noise("h").alias("noise"))


@query(r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, CASE WHEN len(k) > 0 THEN k ELSE [text] END AS l FROM (
SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 25) AS k FROM documents)))""")
def source_sentences(spark, d):
    return src.table(spark, d, "documents").select("doc_id", F.posexplode(tx.source_sentences("text")).alias("pos", "sentence"))


@query(r"""WITH m AS (SELECT conv_id, turn, unnest(regexp_extract_all('as FM 3-' || turn || '.' || (conv_id % 7) || ' and mcdp 1 say, see ATP 5-0.1x; ' || text, '""" + tx.PUB_MENTION + r"""', 1)) AS p FROM conversations)
SELECT DISTINCT conv_id, turn, trim(regexp_replace(translate(upper(p), '.', '-'), '\s+', ' ', 'g')) AS pub FROM m""")
def publication_mentions(spark, d):
    t = F.concat(F.lit("as FM 3-"), F.col("turn").cast("string"), F.lit("."), (F.col("conv_id") % 7).cast("string"), F.lit(" and mcdp 1 say, see ATP 5-0.1x; "), F.col("text"))
    return src.table(spark, d, "conversations").select("conv_id", "turn", F.explode(tx.pub_mentions(t)).alias("pub"))


# -- manifest

_HOSTS = [("m.", "mobile"), ("blog.", "blog"), ("example.net", "network"), ("example.org", "organisation")]
_HOST_SQL = "CASE " + " ".join(f"WHEN contains(url, '{p}') THEN '{n}'" for p, n in _HOSTS) + " ELSE 'unknown' END"


@query(f"SELECT page_id, {_HOST_SQL} AS host FROM pages")
def host_patterns(spark, d):
    return src.table(spark, d, "pages").select("page_id", mf.host(F.col("url"), _HOSTS).alias("host"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR coalesce(toxic = 1, false) THEN 'BLOCKED' WHEN NOT coalesce(quality = 1, false) THEN 'REVIEW' WHEN doc_id % 3 > 0 THEN 'CLEAR (with blind spots)' ELSE 'CLEAR' END AS flag FROM documents LEFT JOIN labels USING (doc_id)""")
def screening_flags(spark, d):
    j = src.table(spark, d, "documents").select("doc_id").join(src.table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", mf.screening_flag((F.col("doc_id") % 7 == 0).cast("int"), F.col("toxic") == 1, F.col("quality") == 1, F.col("doc_id") % 3).alias("flag"))


@query("SELECT count(*) AS documents, count(*) FILTER (WHERE NOT coalesce(quality = 1, false)) AS blocked, count(*) FILTER (WHERE quality = 1) AS cleared, CAST(sum(n_chars // 100) AS BIGINT) AS pages FROM documents LEFT JOIN labels USING (doc_id)")
def manifest_totals(spark, d):
    j = src.table(spark, d, "documents").select("doc_id", "n_chars").join(src.table(spark, d, "labels"), "doc_id", "left")
    return mf.totals(j.select((F.col("quality") == 1).alias("cleared"), F.expr("n_chars div 100").alias("pages")))


@query("SELECT doc_id, source FROM documents ORDER BY md5('12:' || doc_id), doc_id LIMIT 40")
def seeded_sample(spark, d):
    return mf.seeded_sample(src.table(spark, d, "documents").select("doc_id", "source"), "doc_id", 40, "12")


# -- answers, evaluation, tuning

@query(f"""WITH {_BM25}, {_OVER}, {_FUSED}
SELECT query_id AS item_id, 'SOURCES:' || chr(10) || chr(10) || string_agg('[' || rank || '] ' || source || chr(10) || d.text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || chr(10) || 'QUESTION: ' || any_value(b.text) AS prompt
FROM hy JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 8 GROUP BY 1""")
def prompt_from_hits(spark, d):
    """Prompts of all questions from the ranked hits of the hybrid search, with the hits' whole texts."""
    best = _best(spark, d).select("query_id", "rank", "doc_id")
    docs = src.table(spark, d, "documents").select("doc_id", F.col("source").alias("citation"), "text")
    packed = docs.join(best, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "citation", "text"))).alias("s"))
    q = src.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return q.join(packed, "query_id").select(F.col("query_id").alias("item_id"), gates.prompt(F.col("question"), F.col("s")).alias("prompt"))


@query("""WITH l AS (SELECT DISTINCT doc_id % 10 AS query_id, source AS pub_id, lang AS section FROM documents WHERE doc_id % 9 = 0 AND doc_id % 10 < 7)
SELECT doc_id, EXISTS (SELECT 1 FROM l WHERE l.query_id = d.doc_id % 10 AND l.pub_id = d.source AND l.section = d.lang) AS relevant,
CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.query_id = d.doc_id % 10) THEN EXISTS (SELECT 1 FROM l WHERE l.query_id = d.doc_id % 10 AND l.pub_id = d.source) END AS cited_relevant FROM documents d""")
def label_match(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 10).alias("query_id"), F.col("source").alias("pub_id"), F.col("lang").alias("section"))
    hits = docs.withColumn("section", F.concat(F.lit(" "), F.upper("section"), F.lit(" ")))
    return ev.label_match(hits, docs.where("doc_id % 9 = 0 AND query_id < 7")).select("doc_id", "relevant", "cited_relevant")


@query(f"SELECT *, false_answer + over_refusal AS total FROM ({SQL['threshold_grid']}) ORDER BY total, trap_missed, g1, g2 LIMIT 1")
def best_operating_point(spark, d):
    return ev.best_point(threshold_grid(spark, d))


def _signals(spark, d):
    return tb.records(spark, d).select("kind", F.col("top_score").alias("value"))


@query(_with(tb.RECORDS) + "SELECT kind, count(*) AS n, round(min(top_score), 6) AS lo, round(median(top_score), 6) AS mid, round(max(top_score), 6) AS hi FROM records WHERE top_score IS NOT NULL GROUP BY 1")
def signal_ranges(spark, d):
    return ev.signal_ranges(_signals(spark, d))


@query(_with(tb.RECORDS) + """SELECT threshold, false_answers, over_refusals FROM (SELECT t::DOUBLE / 2 AS threshold, count(*) FILTER (WHERE kind = 'out' AND top_score >= t::DOUBLE / 2) AS false_answers, count(*) FILTER (WHERE kind = 'in' AND top_score < t::DOUBLE / 2) AS over_refusals,
count(*) FILTER (WHERE kind = 'out') AS o, count(*) FILTER (WHERE kind = 'in') AS i FROM records, range(-16, 17) g(t) WHERE top_score IS NOT NULL GROUP BY t) ORDER BY round(false_answers / o + over_refusals / i, 9), threshold LIMIT 1""")
def best_threshold(spark, d):
    return ev.best_threshold(_signals(spark, d))


# -- records

@query(_with(tb.RECORDS) + """, g AS (SELECT id, CASE WHEN top_score >= 3.5 THEN 'FINDABILITY' WHEN n_claims > 0 THEN 'CORPUS' ELSE 'DOCTRINAL' END AS kind, CASE WHEN n_claims > 0 THEN pub_id END AS pub FROM records)
SELECT kind, count(*) AS n, list(id ORDER BY id)[1:12] AS first_ids, coalesce(list_sort(list(DISTINCT pub) FILTER (WHERE pub IS NOT NULL)), []) AS missing FROM g GROUP BY 1""")
def gap_report(spark, d):
    none = F.array().cast("array<string>")
    g = tb.records(spark, d).select("id", gates.gap_class(F.col("top_score"), 3.5, F.col("n_claims")).alias("kind"), F.when(F.col("n_claims") > 0, F.array("pub_id")).otherwise(none).alias("missing"))
    return rec.gap_report(g)


@query(_with(tb.RECORDS) + """SELECT id, sha256('{"error":' || CASE WHEN error IS NULL THEN 'null' ELSE '"' || error || '"' END || ',"id":' || id || ',"kind":"' || kind || '","n_claims":' || n_claims || '}') AS digest FROM records""")
def canonical_records(spark, d):
    return rec.canonical(tb.records(spark, d), ["kind", "id", "error", "n_claims"]).select("id", F.sha2("canonical", 256).alias("digest"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def sequence_numbers_all(spark, d):
    e = src.table(spark, d, "events").select("event_id", "ts")
    return rec.with_seq(e, e.where("false").select(F.col("event_id").alias("seq")), ["ts", "event_id"]).select("event_id", F.col("seq").cast("long").alias("seq"))


@query("SELECT event_type, round(max(value), 6) AS top, round(avg(value), 6) AS mean, round(arg_max(value, event_id) - arg_min(value, event_id), 6) AS drift, arg_max(value, event_id) - arg_min(value, event_id) < 100 AS steady FROM events GROUP BY 1")
def telemetry_summary(spark, d):
    return rec.telemetry(src.table(spark, d, "events"), "event_type", "value", "event_id")


@query("SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    e = src.table(spark, d, "events").withColumn("ts", F.expr("timestamp_seconds(timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)))"))
    return win.tumbling(e, "ts", "event_type", "value")


# -- review work

_STOP = "[" + ", ".join(f"'{w}'" for w in tx.REVIEW_STOP) + "]"


_ITEMS = """mk AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'Explain ' ELSE '' END || text || CASE WHEN id % 3 = 0 THEN '?' ELSE '' END AS q, coalesce(lead(text) OVER (PARTITION BY chapter ORDER BY pos), text) AS p, CASE WHEN id % 6 = 0 THEN '7. Ibid., p. 1-6. ' || text ELSE text END AS s FROM chunks)"""


def _asked(spark, d):
    """Every line as a question, the next line as its key point, the line itself as the source, some under a note's head."""
    from pyspark.sql import Window

    n, t = F.col("id") % 12, F.col("text")
    q = F.concat(F.when(n % 4 == 0, "Explain ").otherwise(""), t, F.when(n % 3 == 0, "?").otherwise(""))
    after = F.coalesce(F.lead("text").over(Window.partitionBy("chapter").orderBy("pos")), t)
    return tb.chunks(spark, d).select("id", q.alias("q"), after.alias("p"), F.when(n % 6 == 0, F.concat(F.lit("7. Ibid., p. 1-6. "), t)).otherwise(t).alias("s"))


@query(_with(tb.CHUNKS, _ITEMS) + f"""SELECT id, list_concat(CASE WHEN length(trim(q)) < 25 OR NOT contains(q, '?') AND NOT regexp_matches(q, '{lr.IMPERATIVE}') OR len(k) < 2 THEN ['SHAPE'] ELSE [] END,
list_concat(CASE WHEN len(k) > 0 AND len(t) > 0 AND len(list_intersect(t, k)) / len(list_distinct(k)) >= 0.6 THEN ['ANSWER_LEAKED'] ELSE [] END, CASE WHEN id % 6 = 0 THEN ['SOURCE_NOT_TEACHABLE'] ELSE [] END)) AS flags FROM (
SELECT id, q, list_filter(regexp_extract_all(lower(q), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)) AS t, list_filter(regexp_extract_all(lower(p), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)) AS k FROM mk)""")
def precheck_flags(spark, d):
    return _asked(spark, d).select("id", lr.precheck(F.col("q"), F.array("p"), F.col("s")).alias("flags"))


_SECTIONS = "sec AS (SELECT DISTINCT pub_id, CASE WHEN chapter % 3 > 0 THEN chapter END AS chapter, section FROM chunks)"


@query(_with(tb.CHUNKS, _SECTIONS) + "SELECT * FROM sec s WHERE NOT EXISTS (SELECT 1 FROM sec t WHERE t.section <> 'en' AND s.pub_id IS NOT DISTINCT FROM t.pub_id AND s.chapter IS NOT DISTINCT FROM t.chapter AND s.section IS NOT DISTINCT FROM t.section)")
def undone_sections(spark, d):
    s = tb.chunks(spark, d).select("pub_id", F.when(F.col("chapter") % 3 > 0, F.col("chapter")).alias("chapter"), "section").distinct()
    return lr.undone(s, s.where("section <> 'en'"))


@query(_with(tb.REVIEWS, "new AS (SELECT item_id, 'approved' AS status, CAST(NULL AS VARCHAR[]) AS flags, CASE WHEN item_id % 2 = 0 THEN 'new ' || item_id END AS edited_question FROM reviews WHERE item_id % 3 = 0)") + """SELECT item_id,
CASE WHEN n.item_id IS NOT NULL THEN n.status ELSE o.status END AS status, CASE WHEN n.item_id IS NOT NULL THEN n.flags ELSE o.flags END AS flags, coalesce(n.edited_question, o.edited_question) AS edited_question FROM reviews o FULL JOIN new n USING (item_id)""")
def decide_reviews(spark, d):
    old = tb.reviews(spark, d)
    new = old.where("item_id % 3 = 0").select("item_id", F.lit("approved").alias("status"), F.lit(None).cast("array<string>").alias("flags"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("new "), F.col("item_id").cast("string"))).alias("edited_question"))
    return src.upsert(old, new, ["item_id"], ["edited_question"])


@query(_with(tb.ATTEMPTS, tb.ITEMS, tb.REVIEWS) + "SELECT pub_id, section, item_id, coalesce(nullif(edited_question, ''), question) AS question FROM items JOIN reviews USING (item_id) WHERE status = 'approved'")
def served_items(spark, d):
    return lr.served(tb.items(spark, d), tb.reviews(spark, d))
