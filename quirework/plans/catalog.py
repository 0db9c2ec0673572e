"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Gates, Search
from ..functions import maths
from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import gates
from ..operators import grounding as gr
from ..operators import layout as lay
from ..operators import learning as lr
from ..operators import lexical as lx
from ..operators import records as rec
from ..operators import retrieval as rt
from ..operators import verification as vf
from ..sources import shared
from ..sources import tables as src
from . import lexical_sql as ls
from . import tables as tb

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = 1_705_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _with(*views: str) -> str:
    return "WITH " + ", ".join(views) + "\n"


# -- retrieval

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')".format
_OVER = rf"""op AS (SELECT DISTINCT doc_id, unnest({_TOK('text')}) AS term FROM documents),
ot AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOK('text')}) AS term FROM benchmark) WHERE length(term) >= 2 GROUP BY ALL),
nt AS (SELECT query_id, count(*) AS k FROM ot GROUP BY 1),
ov AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (
  SELECT query_id, doc_id, round(count(*) / any_value(k)::DOUBLE, 6) AS score FROM ot JOIN op USING (term) JOIN nt USING (query_id) GROUP BY ALL))"""


def _fused(depth: int = 50) -> str:
    return f"""fu AS (SELECT query_id, doc_id, round(coalesce(1 / (60 + b.rank), 0) + coalesce(1 / (60 + o.rank), 0), 9) AS score, b.rank AS first_rank, o.rank AS second_rank, b.score AS first_score
  FROM (SELECT * FROM bm WHERE rank <= {depth}) b FULL JOIN (SELECT * FROM ov WHERE rank <= {depth}) o USING (query_id, doc_id)),
hy AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(first_rank, 1000000 + second_rank)) AS INTEGER) AS rank FROM fu)"""


_FUSED = _fused()
_BM25 = ls.BM25
_FOUND = "CASE WHEN second_rank IS NULL THEN 'bm25' WHEN first_rank IS NULL THEN 'overlap' ELSE 'bm25+overlap' END"


def _bm25(spark, d, k):
    docs = src.table(spark, d, "documents")
    return lx.bm25(lx.index_of(docs, "doc_id"), src.table(spark, d, "benchmark"), k, "item_id")


def _hybrid(spark, d, depth: int | None = None):
    """Lexical hits fused with word overlap, which stands where a list of nearest vectors would: no question has a vector here."""
    docs, q = src.table(spark, d, "documents").select("doc_id", "text"), src.table(spark, d, "benchmark")
    s = Search()
    return rt.fuse(_bm25(spark, d, depth or s.bm25_k), rt.overlap_list(docs, q, depth or s.dense_k, "doc_id", "item_id"), "doc_id", s.rrf_k, ("bm25", "overlap"))


def _best(spark, d):
    """The hits to show, written: a few a question, so documents meet them without being exchanged."""
    return shared.saved(_hybrid(spark, d).where(F.col("rank") <= Search().final_k).select("query_id", "rank", "doc_id", "score"), "hits")


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """All questions against the written index: phrases, stems, accents folded."""
    return _bm25(spark, d, 10)


@query(f"WITH {_BM25} SELECT stem AS term, count(DISTINCT doc_id) AS df, count(*) AS n FROM lp GROUP BY 1")
def index_vocabulary(spark, d):
    """Built anew from the table: each stem's rows and occurrences."""
    return lx.postings(src.table(spark, d, "documents"), "doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("places").cast("long")).alias("n"))


@query(f"WITH {_OVER} SELECT query_id, doc_id, score, rank FROM ov WHERE rank <= 10")
def overlap_topk(spark, d):
    return rt.overlap_list(src.table(spark, d, "documents"), src.table(spark, d, "benchmark"), 10, "doc_id", "item_id")


@query(f"WITH {_BM25}, {_OVER}, {_FUSED} SELECT query_id, doc_id, score, first_rank, second_rank, first_score, {_FOUND} AS found_by, rank FROM hy")
def rrf_fusion(spark, d):
    return _hybrid(spark, d)


@query(f"WITH {_BM25}, {_OVER}, {_FUSED} SELECT query_id, rank, doc_id, hy.score AS score, source, lang, length(text) AS n_chars FROM hy JOIN documents USING (doc_id) WHERE rank <= 8")
def hybrid_search(spark, d):
    best = _best(spark, d).select("query_id", "rank", "doc_id", "score")
    docs = src.table(spark, d, "documents").select("doc_id", "source", "lang", F.length("text").cast("long").alias("n_chars"))
    return docs.join(best, "doc_id").select("query_id", "rank", "doc_id", "score", "source", "lang", "n_chars")


def _reranked_sql(k: int, depth: int = 50) -> str:
    """The stand-in scorer: the share of the question's distinct words that source and text hold, in tenths of their number from -5 to 5."""
    return f"""{_fused(depth)},
cw AS (SELECT query_id, doc_id, rank AS fused_rank, first_score, contains(d.text, b.text) AS relevant, list_distinct({_TOK('b.text')}) AS q, {_TOK("d.source || chr(10) || coalesce(d.text, '')")} AS t FROM hy JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id),
rs AS (SELECT query_id, doc_id, fused_rank, first_score, relevant, round(CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q) END * 10 - 5, 6) AS rerank_score FROM cw),
rr AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS INTEGER) AS rank FROM rs)"""


def _overlap_scorer(question, document):
    """Of the distinct terms of both."""
    return F.round(tx.overlap(document, question) * 10 - 5, 6)


def _reranked(spark, d, k: int, depth: int | None = None) -> DataFrame:
    """The fused hits are written first: the documents that they name are picked where they lie, and taken apart once each."""
    distinct = lambda x: F.array_distinct(tx.tokens(x))
    q = src.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"), distinct("text").alias("question"))
    fused = shared.saved(_hybrid(spark, d, depth).select("query_id", "doc_id", F.col("rank").alias("fused_rank"), "first_score"), "fused")
    docs = src.table(spark, d, "documents").select("doc_id", "source", "text").join(fused.select("doc_id").distinct(), "doc_id", "left_semi")
    own = docs.select("doc_id", distinct(F.concat("source", F.lit("\n"), F.coalesce("text", F.lit("")))).alias("document"), "text")
    met = own.join(fused, "doc_id").join(q, "query_id").withColumn("relevant", F.contains("text", "passage"))
    return rt.rerank(met, _overlap_scorer, k).select("query_id", "doc_id", "fused_rank", "first_score", "relevant", "rerank_score", "rank")


@query(f"WITH {_BM25}, {_OVER}, {_reranked_sql(8)} SELECT query_id, doc_id, fused_rank, first_score, relevant, rerank_score, rank FROM rr WHERE rank <= 8")
def hybrid_rerank(spark, d):
    """All fused hits scored again from their whole texts, the best eight kept; the lexical score travels with them."""
    return _reranked(spark, d, Search().final_k)


_RECALL = """SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN rank <= 8 THEN 1.0 ELSE 0 END), 6) AS recall_8, round(sum(coalesce(1 / rank, 0)) / count(*), 6) AS mrr"""


def _recall_sql(rank: str, where: str) -> str:
    return f"{_RECALL} FROM (SELECT item_id, min({rank}) AS rank FROM benchmark LEFT JOIN (SELECT * FROM rr WHERE relevant AND {where}) ON query_id = item_id GROUP BY 1)"


@query(f"WITH {_BM25}, {_OVER}, {_reranked_sql(8)} SELECT 'fused' AS stage, * FROM ({_recall_sql('fused_rank', 'true')}) UNION ALL SELECT 'reranked', * FROM ({_recall_sql('rank', 'rank <= 8')})")
def recall_mrr(spark, d):
    """Recall and mean reciprocal rank of all fused hits, and of the eight kept after scoring again; a hit is a document that holds the question's passage."""
    q = src.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    r = shared.saved(_reranked(spark, d, 10**6), "reranked")
    stages = [("fused", r.select("query_id", F.col("fused_rank").alias("rank"), "relevant")), ("reranked", r.where(F.col("rank") <= Search().final_k).select("query_id", "rank", "relevant"))]
    first, second = (rt.recall(hits, q).select(F.lit(name).alias("stage"), "*") for name, hits in stages)
    return first.unionByName(second)


_DEEP = f"""tp AS (SELECT query_id, max(rerank_score) FILTER (WHERE fused_rank <= 50) AS top, max(rerank_score) AS deep_top FROM rr GROUP BY 1),
nm AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all('see FM 3-' || (item_id % 4) || ' and MCDP ' || (item_id % 3) || ': ' || text, '{tx.PUB_MENTION}', 1), lambda p: trim(regexp_replace(translate(upper(p), '.', '-'), '\\s+', ' ', 'g')))) AS pubs FROM benchmark),
ms AS (SELECT item_id, list_filter(pubs, lambda p: NOT (p = 'MCDP 1' OR starts_with(p, 'MCDP 1') OR starts_with('MCDP 1', p) OR p = 'FM 3' OR starts_with(p, 'FM 3') OR starts_with('FM 3', p))) AS missing FROM nm)"""


@query(f"WITH {_BM25}, {_OVER}, {_reranked_sql(5, 800)}, {_DEEP} SELECT item_id, deep_top, len(missing) AS n_missing, CASE WHEN deep_top >= 4.5 THEN 'FINDABILITY' WHEN len(missing) > 0 THEN 'CORPUS' ELSE 'DOCTRINAL' END AS kind FROM ms LEFT JOIN tp ON query_id = item_id")
def deep_gaps(spark, d):
    """Each question searched 800 deep and classed: an answer lies deeper, a named publication is not loaded, or neither."""
    deep = _reranked(spark, d, 5, 800).groupBy("query_id").agg(F.max("rerank_score").alias("deep_top"))
    asked = F.concat(F.lit("see FM 3-"), F.col("item_id") % 4, F.lit(" and MCDP "), F.col("item_id") % 3, F.lit(": "), F.col("text"))
    q = src.table(spark, d, "benchmark").select("item_id", tx.pub_mentions(asked).alias("pubs"))
    loaded = spark.createDataFrame([("MCDP 1",), ("FM 3",)], "pub string")
    missing = rec.missing_publications(q.select("item_id", F.explode("pubs").alias("pub")), loaded).groupBy("item_id").agg(F.count(F.lit(1)).alias("m"))
    met = q.select("item_id").join(missing, "item_id", "left").join(deep.withColumnRenamed("query_id", "item_id"), "item_id", "left").withColumn("n_missing", F.coalesce("m", F.lit(0)))
    return met.select("item_id", "deep_top", "n_missing", gates.gap_class(F.col("deep_top"), 4.5, F.col("n_missing")).alias("kind"))


@query("""WITH w AS (SELECT vec_id, vec_id // 3 AS chunk_id, embedding FROM embeddings),
p AS (SELECT q.vec_id AS query_id, w.vec_id, w.chunk_id, round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[])), 6) AS distance FROM embeddings q, w WHERE q.vec_id % 50 = 0),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM p) WHERE r <= 24),
b AS (SELECT query_id, chunk_id, min(distance) AS distance FROM n GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank FROM b) WHERE rank <= 8""")
def dense_topk(spark, d):
    v = src.table(spark, d, "embeddings")
    w = v.select("vec_id", F.floor(F.col("vec_id") / 3).alias("chunk_id"), "embedding")
    return rt.dense(w, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 8)


@query("""SELECT a.vec_id AS vec_id, a.label AS label, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), c.m), 6) AS similarity FROM embeddings a
JOIN (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1) c USING (label)""")
def cosine_to_centroid(spark, d):
    v = src.table(spark, d, "embeddings")
    one = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    m = one.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    return v.join(F.broadcast(m), "label").select("vec_id", "label", F.round(maths.cosine(F.col("embedding"), F.col("m")), 6).alias("similarity"))


# -- text

@query(_with(tb.CHUNKS) + "SELECT id, pub_id || ', ' || section || ' | Chapter ' || chapter || ': ' || pub_id || ' | ' || section || chr(10) || text AS text FROM chunks WHERE chapter <> 0 UNION ALL SELECT id, pub_id || ', ' || section || ' | ' || pub_id || ' | ' || section || chr(10) || text FROM chunks WHERE chapter = 0")
def retrieval_text(spark, d):
    c = tb.chunks(spark, d)
    return c.select("id", tx.retrieval_text(tx.retrieval_header("pub_id", "section", "chapter", "pub_id", "section"), F.col("text")).alias("text"))


@query("""SELECT doc_id, CAST(s AS BIGINT) AS start, substr(text, s + 1, CASE WHEN length(text) <= 1150 THEN 1150 ELSE 1000 END) AS text FROM (SELECT doc_id, text,
unnest(CASE WHEN length(text) <= 1150 THEN [0] ELSE range(0, CAST(ceil((length(text) - 1000) / 800.0) AS INTEGER) * 800 + 1, 800) END) AS s FROM documents)""")
def char_windows(spark, d):
    s = Search()
    return src.table(spark, d, "documents").select("doc_id", F.inline(tx.windows("text", s.window, s.step, s.single)))


@query(r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (
SELECT doc_id, string_split(regexp_replace(regexp_replace(trim(text), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM documents))""")
def sentence_split(spark, d):
    return src.table(spark, d, "documents").select("doc_id", F.posexplode(tx.sentences("text")).alias("pos", "sentence"))


@query(_with(tb.ANSWERS) + r"SELECT conv_id, turn, list_transform(regexp_extract_all(answer, '\[(\d{1,9})\]', 1), lambda x: CAST(x AS INTEGER)) AS markers FROM answers")
def citation_markers(spark, d):
    return tb.answers(spark, d).select("conv_id", "turn", tx.markers("answer").alias("markers"))


@query("SELECT doc_id, length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS n, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS digest FROM documents")
def compact_form(spark, d):
    return src.table(spark, d, "documents").select("doc_id", F.length(tx.compact("text")).cast("long").alias("n"), F.md5(tx.compact("text")).alias("digest"))


@query(_with(tb.CHUNKS) + r"""SELECT id, concat_ws(', ', pub_id, CASE WHEN chapter <> 0 THEN 'Ch ' || chapter || ': ' || section ELSE section END,
CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 4 AND length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1) <= 0.15 AND NOT regexp_matches(lower(text), '(^|\s)distribut') THEN '"' || text || '"' END,
'para ' || pos, 'p.' || pos) AS citation FROM chunks""")
def format_citation(spark, d):
    c = tb.chunks(spark, d)
    return c.select("id", tx.citation("pub_id", F.lit(None).cast("string"), "section", "chapter", "text", "pos", F.col("pos").cast("string")).alias("citation"))


@query(_with(tb.CHUNKS) + r"""SELECT id, len(regexp_extract_all(text, '\.{4,}|\. \. \. \.')) >= 2 OR (length(text) > 0 AND length(regexp_replace(text, '[^\p{L}\s]', '', 'g')) / length(text) < 0.75) AS navigation FROM chunks""")
def navigation_filter(spark, d):
    return tb.chunks(spark, d).select("id", tx.navigation("text", "pub_id", "section").alias("navigation"))


@query(_with(tb.CHUNKS) + r"""SELECT id, regexp_replace(upper(pub_id[1]) || lower(pub_id[2:]), '[^A-Za-z0-9]', '', 'g') || '-c' || chapter || '-' || substr(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 10) || '-' || pos AS item_id FROM chunks""")
def item_ids(spark, d):
    return tb.chunks(spark, d).withColumn("pub_id", F.initcap("pub_id")).select("id", tx.item_id("pub_id", "chapter", "text", "pos").alias("item_id"))


_STOP = "[" + ", ".join(f"'{w}'" for w in tx.REVIEW_STOP) + "]"


def _ct(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains({_STOP}, t))"


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, {_ct('a.text')} AS q, list_distinct({_ct('b.text')}) AS k FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, round(CASE WHEN len(q) = 0 OR len(k) = 0 THEN 0 ELSE len(list_intersect(q, k)) / len(k) END, 6) AS overlap, (CASE WHEN len(q) = 0 OR len(k) = 0 THEN 0 ELSE len(list_intersect(q, k)) / len(k) END) >= 0.6 AS leaked FROM p""")
def leak_flags(spark, d):
    c = src.table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("key_point"))
    o = tx.overlap(tx.content_tokens("text"), tx.content_tokens("key_point"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", F.col("turn").cast("long").alias("turn"), F.round(o, 6).alias("overlap"), (o >= 0.6).alias("leaked"))


@query(r"SELECT event_id, coalesce(CAST(epoch(try_strptime(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%dT%H:%M:%SZ')) AS DOUBLE), 0) AS seconds, 0.0::DOUBLE AS broken FROM events")
def epoch_parse(spark, d):
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e = maths.epoch(t)
    return src.table(spark, d, "events").select("event_id", e.alias("seconds"), maths.epoch(F.concat(t, F.lit(" "))).alias("broken"))


@query("SELECT c_custkey, CASE WHEN regexp_full_match(lower(trim(c_name)), '[a-z0-9][a-z0-9._-]{0,63}') THEN lower(trim(c_name)) END AS learner FROM customer")
def learner_ids(spark, d):
    return src.table(spark, d, "customer").select("c_custkey", tx.learner_id("c_name").alias("learner"))


# -- gates, evaluation

@query(_with(tb.ANSWERS) + rf"""SELECT conv_id, turn, used, CASE WHEN contains(answer, '{Gates().refusal_sentinel}') THEN 'model_declined' WHEN factual AND len(used) = 0 THEN 'uncited_answer' END AS reason FROM (
SELECT conv_id, turn, answer, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '\[(\d{{1,9}})\]', 1), lambda x: CAST(x AS INTEGER)), lambda m: m >= 1 AND m <= n_chunks))) AS used,
len(list_filter(string_split(regexp_replace(trim(answer), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: length(trim(s)) > 25)) > 0 AS factual FROM answers)""")
def cite_or_refuse(spark, d):
    g = Gates()
    a = tb.answers(spark, d)
    return a.select("conv_id", "turn", gates.citations(F.col("answer"), F.col("n_chunks")).alias("used"), gates.cite_or_refuse(F.col("answer"), F.col("n_chunks"), g.refusal_sentinel, g.factual_chars).alias("reason"))


@query(_with(tb.RECORDS) + "SELECT id, CASE WHEN n_claims = 0 THEN 'no_results' WHEN (top_score IS NULL OR top_score < 3.0) AND NOT min_support * 10 >= 8 THEN 'low_retrieval_score' END AS reason FROM records")
def score_gate(spark, d):
    return tb.records(spark, d).select("id", gates.score_gate(F.col("n_claims"), F.col("top_score"), 3.0, -F.col("min_support") * 10, 8.0).alias("reason"))


_ANS = "NOT declined AND (score_thr IS NULL OR coalesce(top_score >= score_thr, false)) AND (support_thr IS NULL OR n_claims = 0 OR coalesce(min_support >= support_thr, false))"
_COUNTS = """count(*) FILTER (WHERE kind = 'in') AS n_in, count(*) FILTER (WHERE kind = 'out' AND NOT expects) AS n_out, count(*) FILTER (WHERE kind = 'out' AND expects) AS n_traps,
count(*) FILTER (WHERE kind = 'in' AND NOT a) AS refused, count(*) FILTER (WHERE kind = 'out' AND NOT expects AND a) AS false_answers, count(*) FILTER (WHERE kind = 'out' AND expects AND NOT a) AS trap_missed"""
_RATES = "refused / greatest(n_in, 1) AS over_refusal, false_answers / greatest(n_out, 1) AS false_answer"


@query(_with(tb.RECORDS) + f"SELECT *, {_RATES} FROM (SELECT pub_id, {_COUNTS} FROM (SELECT *, {_ANS} AS a FROM (SELECT *, 0.0::DOUBLE AS score_thr, 0.3::DOUBLE AS support_thr FROM records WHERE error IS NULL)) GROUP BY pub_id)")
def gate_confusion(spark, d):
    r = tb.records(spark, d).withColumn("score_thr", F.lit(0.0)).withColumn("support_thr", F.lit(0.3))
    return ev.confusion(r, ["pub_id"])


def _grid(v: str, first: str, places: int) -> str:
    """Off, ``first`` (further points), and statistics' exclusive quantiles; format() rounds a double's own value, half to even."""
    return f"""(WITH x AS (SELECT list({v} ORDER BY {v}) AS v FROM records WHERE {v} IS NOT NULL AND error IS NULL),
    q AS (SELECT list((v[j] * (20 - (i * m - j * 20)) + v[j + 1] * (i * m - j * 20)) / 20 ORDER BY i) AS q FROM (SELECT v, len(v) + 1 AS m, i, greatest(1, least(i * (len(v) + 1) // 20, len(v) - 1)) AS j FROM x, range(1, 20) r(i))),
    p AS (SELECT list_concat([CAST(NULL AS DOUBLE)], list_concat({first}, q)) AS p FROM x, q)
    SELECT CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS g, CAST(format('{{:.{places}f}}', unnest(p)) AS DOUBLE) AS t FROM p)"""


_SCORES, _SUPPORTS = _grid("top_score", "[v[1] - 1]", 2), _grid("min_support", "CAST([] AS DOUBLE[])", 3)


@query(_with(tb.RECORDS) + f"SELECT *, {_RATES} FROM (SELECT g1, score_thr, g2, support_thr, {_COUNTS} FROM (SELECT *, {_ANS} AS a FROM (SELECT records.*, s.g AS g1, s.t AS score_thr, u.g AS g2, u.t AS support_thr FROM records, {_SCORES} s, {_SUPPORTS} u WHERE error IS NULL)) GROUP BY g1, score_thr, g2, support_thr)")
def threshold_grid(spark, d):
    """21 score points (off, below all, 19 quantiles) by 20 support points (off, 19 quantiles)."""
    r = tb.records(spark, d)
    ok = r.where("error IS NULL")
    return ev.sweep(r, ev.quantile_grid(ok, "top_score"), ev.quantile_grid(ok, "min_support", below=False, places=3))


@query(_with(tb.RECORDS) + f"SELECT g AS grid_no, t AS top_score FROM {_SCORES}")
def exclusive_quantiles(spark, d):
    return ev.quantile_grid(tb.records(spark, d).where("error IS NULL"), "top_score")


_OFF = "l AS (SELECT pub_id, count(*) AS n, quantile_cont(top_score, 0.5) AS loc FROM records WHERE error IS NULL AND kind = 'in' AND top_score IS NOT NULL GROUP BY 1), r AS (SELECT median(loc) AS ref FROM l WHERE n >= 5), o AS (SELECT pub_id, n, round(loc, 6) AS location, CASE WHEN n >= 5 THEN CAST(format('{:.3f}', ref - loc) AS DOUBLE) END AS \"offset\", n < 5 AS skipped FROM l, r)"


_three = "CAST(format('{{:.3f}}', {}) AS DOUBLE)".format
_two = "CAST(format('{{:.2f}}', {}) AS DOUBLE)".format


@query(_with(tb.RECORDS, _OFF) + f"""SELECT pub_id, k AS n, {_two('lo')} AS lo, {_two('m')} AS mid, {_two('hi')} AS hi, coalesce("offset", 0.0) AS "offset", {_two('m + coalesce("offset", 0.0)')} AS mid_after
FROM (SELECT pub_id, count(*) AS k, min(top_score) AS lo, median(top_score) AS m, max(top_score) AS hi FROM records WHERE error IS NULL AND kind = 'in' AND top_score IS NOT NULL GROUP BY 1) LEFT JOIN o USING (pub_id)""")
def pub_distribution(spark, d):
    r = tb.records(spark, d)
    return ev.distribution(r, ev.offsets(r, 5))


@query(_with(tb.RECORDS, _OFF) + "SELECT * FROM o")
def calibration_offsets(spark, d):
    return ev.offsets(tb.records(spark, d), 5)


@query(_with(tb.RECORDS, _OFF) + "SELECT id, round(top_score + coalesce(\"offset\", 0), 6) AS effective FROM records LEFT JOIN o USING (pub_id)")
def calibrated_scores(spark, d):
    r = tb.records(spark, d)
    return ev.calibrated(r, ev.offsets(r, 5)).select("id", F.round("effective", 6).alias("effective"))


@query(_with(tb.RECORDS) + "SELECT len(l) AS n, l[len(l) // 2 + 1] AS p50, l[least(len(l), CAST(floor(0.95 * len(l)) AS BIGINT) + 1)] AS p95 FROM (SELECT list(latency ORDER BY latency) AS l FROM records)")
def latency_nearest_rank(spark, d):
    return ev.nearest_ranks(tb.records(spark, d), "latency", {"p50": 0.5, "p95": 0.95})


_CURVE = f"""rf AS (SELECT *, -5 + n_claims * 3 + min_support AS value FROM records WHERE error IS NULL AND (declined OR coalesce(top_score < 0, true))),
cv AS (SELECT t AS threshold, count(*) FILTER (WHERE kind = 'in' AND value >= t) AS fixed, count(*) FILTER (WHERE kind = 'out' AND NOT expects AND value >= t) AS broken FROM rf, (SELECT DISTINCT {_three('value')} AS t FROM rf) GROUP BY t)"""


def _refused(spark, d) -> DataFrame:
    r = tb.records(spark, d).where("error IS NULL").where(F.col("declined") | F.coalesce(F.col("top_score") < 0, F.lit(True)))
    return r.select("kind", "expects", (-5 + F.col("n_claims") * 3 + F.col("min_support")).alias("value"))


@query(_with(tb.RECORDS, _CURVE) + "SELECT * FROM cv")
def rescue_curve(spark, d):
    return ev.rescue_curve(_refused(spark, d))


@query(_with(tb.RECORDS, _CURVE) + "SELECT * FROM cv WHERE broken = 0 AND fixed > 0 ORDER BY fixed DESC, threshold LIMIT 1")
def best_rescue(spark, d):
    return ev.best_rescue(ev.rescue_curve(_refused(spark, d)))


# -- records

@query(_with(tb.INTERACTIONS) + "SELECT count(*) AS n, count(*) FILTER (WHERE answered) AS answered, count(*) FILTER (WHERE NOT answered) AS abstained, round_even(avg(latency_s), 2) AS mean_latency FROM interactions")
def interaction_stats(spark, d):
    return rec.stats(tb.interactions(spark, d))


@query(_with(tb.INTERACTIONS) + "SELECT seq, actor, question, latency_s FROM interactions WHERE NOT answered ORDER BY seq DESC LIMIT 50")
def refusals_recent(spark, d):
    return rec.refusals(tb.interactions(spark, d), 50).select("seq", "actor", "question", "latency_s")


@query(_with(tb.INTERACTIONS) + """SELECT seq, '{"actor":{"name":"' || actor || '"},"verb":{"id":"https://example.org/xapi/verbs/' || CASE WHEN answered THEN 'answered' ELSE 'asked' END || '"},"object":{"name":"' || question || '"},"result":{"response":"' || replace(answer_text, '"', chr(92) || '"') || '","success":' || CAST(answered AS VARCHAR) || '}}' AS statement_json FROM interactions""")
def xapi_statements(spark, d):
    return rec.statements(tb.interactions(spark, d))


_PUBS = """named AS (SELECT p_name AS pub FROM part UNION SELECT p_type FROM part UNION SELECT p_brand FROM part WHERE p_size > 20),
loaded AS (SELECT p_brand || ' (reprint)' AS b FROM part WHERE p_partkey % 3 = 0 UNION SELECT p_type[1:2] FROM part WHERE p_size < 2 AND p_partkey % 4 = 0 UNION SELECT p_name || ', volume 2' FROM part WHERE p_partkey % 5 = 0)"""


@query(_with(_PUBS) + "SELECT pub FROM named WHERE NOT EXISTS (SELECT 1 FROM loaded WHERE pub = b OR starts_with(pub, b) OR starts_with(b, pub))")
def prefix_anti_join(spark, d):
    """Loaded names of two letters, longer ones, and names that go on where a loaded one ends, and the other way round."""
    p = src.table(spark, d, "part")
    one = lambda c, where="true": p.where(where).select(c.alias("pub"))
    named = one(F.col("p_name")).unionByName(one(F.col("p_type"))).unionByName(one(F.col("p_brand"), "p_size > 20")).distinct()
    loaded = one(F.concat("p_brand", F.lit(" (reprint)")), "p_partkey % 3 = 0").unionByName(one(F.substring("p_type", 1, 2), "p_size < 2 AND p_partkey % 4 = 0")).unionByName(one(F.concat("p_name", F.lit(", volume 2")), "p_partkey % 5 = 0"))
    return rec.missing_publications(named, loaded)


@query(_with(tb.RECORDS) + "SELECT id, CASE WHEN top_score >= 3.5 THEN 'FINDABILITY' WHEN n_claims > 0 THEN 'CORPUS' ELSE 'DOCTRINAL' END AS kind FROM records")
def gap_classification(spark, d):
    return tb.records(spark, d).select("id", gates.gap_class(F.col("top_score"), 3.5, F.col("n_claims")).alias("kind"))


# -- learning

@query(_with(tb.ATTEMPTS) + "SELECT learner, item_id, arg_max(score, seq) AS score, count(*) AS attempts FROM attempts GROUP BY ALL")
def latest_attempt(spark, d):
    return lr.latest(tb.attempts(spark, d))


_SCHED = """m AS (SELECT learner, item_id, max(seq) FILTER (WHERE verdict <> 'correct') AS miss, max(seq) AS top FROM attempts GROUP BY ALL),
k AS (SELECT a.learner, a.item_id, CAST(count(*) FILTER (WHERE verdict = 'correct' AND (miss IS NULL OR seq > miss)) AS INTEGER) AS streak, any_value(top) AS top FROM attempts a JOIN m USING (learner, item_id) GROUP BY ALL),
sched AS (SELECT k.learner, k.item_id, streak, at_s + 86400 * CASE WHEN verdict = 'incorrect' THEN CASE WHEN confidence >= 3 THEN 0 ELSE 1 END WHEN verdict = 'partial' THEN 1
  WHEN confidence IS NULL OR confidence <= 1 THEN least([1, 3, 7, 21, 60][least(greatest(streak, 1), 5)], 3) ELSE [1, 3, 7, 21, 60][least(greatest(streak, 1), 5)] END AS due FROM k JOIN attempts ON seq = top)"""


@query(_with(tb.ATTEMPTS, _SCHED) + "SELECT learner, item_id, streak, due FROM sched")
def streak_schedule(spark, d):
    return lr.schedule(tb.attempts(spark, d))


@query(_with(tb.ATTEMPTS, tb.ITEMS, _SCHED) + f"SELECT learner, count(*) FILTER (WHERE due <= {NOW}) AS due, count(*) FILTER (WHERE due > {NOW}) AS scheduled, (SELECT count(*) FROM items) - count(*) AS unseen, min(due) FILTER (WHERE due > {NOW}) AS next_due FROM sched GROUP BY 1")
def due_counts(spark, d):
    return lr.due_counts(lr.schedule(tb.attempts(spark, d)), tb.items(spark, d), NOW)


@query(_with(tb.ATTEMPTS, tb.ITEMS, _SCHED, "last AS (SELECT learner, arg_max(item_id, seq) AS served FROM attempts GROUP BY 1)") + f"""SELECT learner, item_id, tier FROM (
SELECT *, row_number() OVER (PARTITION BY learner ORDER BY tier, CASE WHEN tier = 1 THEN due END, CASE WHEN tier = 3 THEN streak END, CASE WHEN tier = 3 THEN due END, pos, item_id) AS r FROM (
SELECT l.learner, i.item_id, i.pos, streak, due, CAST(CASE WHEN due IS NULL THEN 2 WHEN due <= {NOW} THEN 1 ELSE 3 END AS INTEGER) AS tier FROM last l CROSS JOIN items i LEFT JOIN sched s ON s.learner = l.learner AND s.item_id = i.item_id WHERE i.item_id <> served)) WHERE r = 1""")
def next_item(spark, d):
    a = tb.attempts(spark, d)
    last = a.groupBy("learner").agg(F.max_by("item_id", "seq").alias("item_id"))
    return lr.next_item(lr.schedule(a), tb.items(spark, d).select("item_id", "pos"), last, NOW)


_SCORED = """sc AS (SELECT learner, item_id, arg_max(score, seq) AS score FROM attempts GROUP BY ALL),
tr AS (SELECT * FROM items WHERE item_id IN (SELECT item_id FROM reviews WHERE status <> 'rejected')),
z AS (SELECT pub_id, section, count(*) AS n_items FROM tr GROUP BY ALL),
dn AS (SELECT learner, pub_id, section, count(*) AS a, count(*) FILTER (WHERE score >= 1) AS m FROM sc JOIN tr USING (item_id) GROUP BY ALL),
pg AS (SELECT learner, pub_id, section, n_items, coalesce(a, 0) AS attempted, coalesce(m, 0) AS mastered FROM (SELECT DISTINCT learner FROM sc) CROSS JOIN z LEFT JOIN dn USING (learner, pub_id, section))"""


def _track(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Latest scores, the track, and what may be served: here all items that no reviewer has rejected."""
    return lr.latest(tb.attempts(spark, d)), tb.items(spark, d).select("pub_id", "section", "item_id"), tb.reviews(spark, d).where("status <> 'rejected'")


@query(_with(tb.ATTEMPTS, tb.ITEMS, tb.REVIEWS, _SCORED) + "SELECT *, CASE WHEN mastered = n_items THEN 'mastered' WHEN attempted > 0 THEN 'shaky' ELSE 'new' END AS state FROM pg")
def progress(spark, d):
    return lr.progress(*_track(spark, d))


def _roll(by: str) -> str:
    return _with(tb.ATTEMPTS, tb.ITEMS, tb.REVIEWS, _SCORED) + f"SELECT {by}, CAST(sum(n_items) AS BIGINT) AS n_items, CAST(sum(attempted) AS BIGINT) AS attempted, CAST(sum(mastered) AS BIGINT) AS mastered, CAST(round_even(100.0::DOUBLE * sum(attempted) / sum(n_items), 0) AS INTEGER) AS pct FROM pg GROUP BY ALL"


@query(_roll("learner, pub_id"))
def progress_publications(spark, d):
    return lr.rolled_up(lr.progress(*_track(spark, d)), ["learner", "pub_id"])


@query(_roll("learner"))
def progress_totals(spark, d):
    return lr.rolled_up(lr.progress(*_track(spark, d)), ["learner"])


_CLASS = """per AS (SELECT item_id, count(*) AS a, count(*) FILTER (WHERE score >= 1) AS m FROM sc GROUP BY 1),
cl AS (SELECT pub_id, section, count(*) AS n_items, CAST(coalesce(sum(a), 0) AS BIGINT) AS attempts, CAST(coalesce(sum(m), 0) AS BIGINT) AS mastered FROM tr LEFT JOIN per USING (item_id) GROUP BY ALL)"""


@query(_with(tb.ATTEMPTS, tb.ITEMS, tb.REVIEWS, _SCORED, _CLASS) + "SELECT *, CAST(CASE WHEN attempts = 0 THEN 0 ELSE round_even(100.0 * mastered / attempts, 0) END AS INTEGER) AS pct FROM cl")
def class_overview(spark, d):
    return lr.class_overview(*_track(spark, d))


@query(_with(tb.ATTEMPTS, tb.ITEMS, tb.REVIEWS, _SCORED, _CLASS) + """SELECT (SELECT count(DISTINCT learner) FROM sc) AS n_learners, n_items, attempts, mastered, CAST(CASE WHEN attempts = 0 THEN 0 ELSE round_even(100.0 * mastered / attempts, 0) END AS INTEGER) AS pct
FROM (SELECT CAST(sum(n_items) AS BIGINT) AS n_items, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(mastered) AS BIGINT) AS mastered FROM cl)""")
def class_totals(spark, d):
    scores, track, ok = _track(spark, d)
    return lr.class_totals(scores, lr.class_overview(scores, track, ok))


_BUCKETS = f"bu AS (SELECT learner, confidence, n, {_three('(confidence - 1) / 3')} AS stated, {_three('a')} AS actual, {_three('a - (confidence - 1) / 3')} AS gap FROM (SELECT learner, confidence, count(*) AS n, avg(score) AS a FROM attempts GROUP BY ALL))"


@query(_with(tb.ATTEMPTS, _BUCKETS) + "SELECT * FROM bu")
def calibration_buckets(spark, d):
    return lr.calibration(tb.attempts(spark, d))


@query(_with(tb.ATTEMPTS, _BUCKETS) + f"SELECT learner, CAST(sum(n) AS BIGINT) AS n, {_three('coalesce(sum(n) FILTER (WHERE gap < -0.15), 0) / sum(n)')} AS overconfident_share, arg_min(confidence, gap * 100 + confidence / 1000) AS worst_confidence FROM bu GROUP BY 1")
def overconfidence(spark, d):
    return lr.overconfidence(lr.calibration(tb.attempts(spark, d)))


@query(_with(tb.ATTEMPTS, tb.ITEMS, tb.REVIEWS) + "SELECT learner, seq, a.item_id AS item_id, coalesce(nullif(edited_question, ''), question) AS question FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY seq DESC) AS r FROM attempts) a LEFT JOIN items i ON i.item_id = a.item_id LEFT JOIN reviews v ON v.item_id = a.item_id WHERE r <= 20")
def history_with_edits(spark, d):
    h = lr.history(tb.attempts(spark, d), tb.items(spark, d).select("item_id", "question"), tb.reviews(spark, d), 20)
    return h.select("learner", "seq", "item_id", "question")


@query(_with(tb.REVIEWS) + "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status = 'rejected') AS rejected, CAST(round_even(100.0 * count(*) FILTER (WHERE status <> 'pending') / count(*), 0) AS INTEGER) AS reviewed_pct FROM reviews")
def review_stats(spark, d):
    return lr.review_stats(tb.reviews(spark, d))


_GSTOP = "[" + ", ".join(f"'{w}'" for w in tx.GRADING_STOP) + "]"


def _gt(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z]{{3,}}'), lambda t: NOT list_contains({_GSTOP}, t)))"


@query(f"""WITH t AS (SELECT doc_id, text, list_sort(list_distinct(list_filter(string_split(text, chr(10)), lambda s: length(s) > 0))) AS l FROM documents),
c AS (SELECT doc_id, unnest(l[1:-:2]) AS point, list_transform(l[2:-:2], lambda x: {_gt('x')}) AS missed FROM t),
h AS (SELECT doc_id, len(list_filter(missed, lambda x: len(list_intersect(x, {_gt('point')})) / greatest(len({_gt('point')}), 1) >= 0.5)) > 0 AS hit FROM c),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE hit) AS m FROM h GROUP BY 1)
SELECT doc_id, CASE WHEN m = 0 AND doc_id % 3 > 0 THEN 0 ELSE n - m END AS covered, CASE WHEN m = 0 AND doc_id % 3 > 0 THEN n ELSE m END AS missed FROM g""")
def grade_reconcile_lines(spark, d):
    """All distinct lines of every document: those at odd places are key points, the others what the grader called missed."""
    docs = src.table(spark, d, "documents").select("doc_id", F.array_sort(F.array_distinct(F.filter(F.split("text", "\n"), lambda s: F.length(s) > 0))).alias("l")).where(F.size("l") > 0)
    at = lambda k: F.filter("l", lambda x, i: i % 2 == k)
    verdict = F.when(F.col("doc_id") % 3 > 0, "partial").otherwise("correct")
    r = docs.select("doc_id", at(0).alias("points"), at(1).alias("called"), verdict.alias("verdict")).select("doc_id", F.inline(F.array(lr.reconcile_missed(F.col("points"), F.col("called"), F.col("verdict")))))
    return r.select("doc_id", F.size("covered").cast("long").alias("covered"), F.size("missed").cast("long").alias("missed"))


@query(_with(tb.CHUNKS) + r"SELECT pub_id, chapter, section, count(*) AS n, CAST(sum(CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS big, min(id) AS ord FROM chunks WHERE NOT regexp_matches(section, '(?i)^(mcd|mcdp|distribution|foreword|preface|notes?|conclusion notes)') GROUP BY ALL HAVING count(*) >= 2 AND big >= 1")
def teachable_sections(spark, d):
    return lr.teachable(tb.chunks(spark, d), 400)


@query(_with(tb.CHUNKS) + "SELECT pub_id, chapter, section, id, n_chars, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY pub_id, chapter, section ORDER BY n_chars DESC, id) AS r FROM chunks) WHERE r <= 2")
def top_chunks_per_section(spark, d):
    return lr.longest(tb.chunks(spark, d), 2).select("pub_id", "chapter", "section", "id", "n_chars", "r")


# -- corpus and layout

@query(_with(tb.CHUNKS) + "SELECT pub_id, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM chunks GROUP BY 1")
def corpus_counts(spark, d):
    c = tb.chunks(spark, d).groupBy("pub_id").agg(F.count(F.lit(1)).alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total"))))


@query(_with(tb.CHUNKS) + "SELECT doc, island, pos, text FROM (SELECT doc, island, max(l) AS has, max(pos) AS pos, string_agg(text, ' ' ORDER BY pos) AS text FROM (SELECT chapter AS doc, pos, text, CASE WHEN n_chars >= 80 THEN 1 ELSE 0 END AS l, CAST(coalesce(sum(CASE WHEN n_chars >= 80 THEN 1 ELSE 0 END) OVER (PARTITION BY chapter ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS island FROM chunks) GROUP BY ALL) WHERE has = 1")
def short_carry(spark, d):
    return lay.carry_short(tb.chunks(spark, d).select(F.col("chapter").alias("doc"), "pos", "text")).select("doc", "island", "pos", "text")


@query(_with(tb.CHUNKS) + "SELECT id, CAST(row_number() OVER (PARTITION BY pub_id, chapter, section ORDER BY id) AS INTEGER) AS ordinal FROM chunks")
def paragraph_ordinals(spark, d):
    c = tb.chunks(spark, d)
    return lay.ordinals(c.select("id", F.col("pub_id").alias("doc"), "chapter", "section", F.col("id").alias("pos"))).select("id", "ordinal")


@query(_with(tb.BLOCKS) + "SELECT page_id, block_no, tag, text FROM blocks")
def html_blocks(spark, d):
    return tb.blocks(spark, d)


_PAGED = r"""paged AS (SELECT chapter AS doc, pos // 8 AS page, pos AS line_no, (pos % 8) * 90 AS y, 720 AS height, CASE WHEN pos % 8 = 7 THEN pub_id || '  page ' || (pos // 8) WHEN pos % 8 = 6 AND chapter % 2 = 0 THEN '1-' || (pos // 8) ELSE text END AS text FROM chunks),
nm AS (SELECT *, trim(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\d+', '#', 'g')) AS norm FROM paged),
fu AS (SELECT doc, norm, count(*) AS n FROM nm WHERE (y < 720 * 0.15 OR y > 720 * 0.85) AND norm NOT IN ('', '#') GROUP BY ALL HAVING count(*) >= 3)"""


def _paged(spark, d) -> DataFrame:
    """Lines on pages of eight; the last of each page is a running foot, and in every other document the one before it the page's number."""
    c, p = tb.chunks(spark, d), F.col("pos")
    page = F.expr("pos div 8")
    text = F.when(p % 8 == 7, F.concat("pub_id", F.lit("  page "), page.cast("string"))).when((p % 8 == 6) & (F.col("chapter") % 2 == 0), F.concat(F.lit("1-"), page.cast("string"))).otherwise(F.col("text"))
    return c.select(F.col("chapter").alias("doc"), page.alias("page"), p.alias("line_no"), (p % 8 * 90).alias("y"), F.lit(720).alias("height"), text.alias("text"))


@query(_with(tb.CHUNKS, _PAGED) + "SELECT doc, norm, n FROM fu")
def furniture_lines(spark, d):
    return lay.furniture(_paged(spark, d))


@query(_with(tb.CHUNKS, _PAGED) + rf"SELECT doc, page, line_no, text FROM nm WHERE NOT regexp_matches(trim(text), '{lay.PAGE_NUMBER}') AND NOT EXISTS (SELECT 1 FROM fu WHERE fu.doc = nm.doc AND fu.norm = nm.norm)")
def body_lines(spark, d):
    lines = _paged(spark, d)
    return lay.body_lines(lines, lay.furniture(lines)).select("doc", "page", "line_no", "text")


@query(_with(tb.BLOCKS) + """, l AS (SELECT page_id AS doc, block_no, tag LIKE 'h%' AS heading, block_no * 12 + (length(text) % 3) * 10 AS y FROM blocks),
s AS (SELECT *, CASE WHEN heading OR coalesce(lag(heading) OVER w, false) OR coalesce(y - lag(y) OVER w > 1.45 * 12, false) THEN 1 ELSE 0 END AS s FROM l WINDOW w AS (PARTITION BY doc ORDER BY block_no)),
p AS (SELECT *, CAST(sum(s) OVER (PARTITION BY doc ORDER BY block_no) AS BIGINT) AS para FROM s)
SELECT doc, para, 0 AS page, min(block_no) AS first_line, count(*) AS n_lines FROM p WHERE NOT heading GROUP BY ALL""")
def paragraph_islands(spark, d):
    b = tb.blocks(spark, d)
    lines = b.select(F.col("page_id").alias("doc"), F.lit(0).alias("page"), F.col("block_no").alias("line_no"), (F.col("block_no") * 12 + (F.length("text") % 3) * 10).alias("y"), F.lit(12.0).alias("leading"), F.col("tag").startswith("h").alias("heading"))
    return lay.paragraphs(lines)


@query(_with(tb.BLOCKS) + """, o AS (SELECT page_id, block_no, CASE WHEN tag = 'h1' THEN 1 ELSE 2 END AS level, text AS title FROM blocks WHERE tag IN ('h1', 'li')),
a AS (SELECT b.page_id AS doc, b.block_no AS pos, arg_max(title, o.block_no) AS section, arg_max(title, o.block_no) FILTER (WHERE level = 1) AS chapter FROM blocks b LEFT JOIN o ON o.page_id = b.page_id AND o.block_no <= b.block_no WHERE b.tag = 'p' GROUP BY ALL)
SELECT doc, pos, chapter, CASE WHEN section IS DISTINCT FROM chapter THEN section END AS section FROM a""")
def outline_asof(spark, d):
    b = tb.blocks(spark, d)
    outline = b.where("tag IN ('h1', 'li')").select(F.col("page_id").alias("doc"), F.col("block_no").alias("start"), F.when(F.col("tag") == "h1", 1).otherwise(2).alias("level"), F.col("text").alias("title"))
    return lay.outline_asof(b.where("tag = 'p'").select(F.col("page_id").alias("doc"), F.col("block_no").alias("pos")), outline)


_MARKED = ["CUI", "controlled unclassified", "FOUO", "For Official  Use Only", "NOFORN noforn", "top secret", "CONFIDENTIAL", "TOP SECRET", "Law Enforcement Sensitive", "EXPORT CONTROL", "ITAR itar CUIS"]


def _screen_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT doc_id, {i} AS mark_no, CAST(len(regexp_extract_all(text, '{p}')) AS INTEGER) AS exact, CAST(len(regexp_extract_all(text, '(?i){p}')) AS INTEGER) AS loose FROM marked" for i, p in enumerate(lay.MARKS))
    case = " ".join(f"WHEN {i} THEN text || ' {m}.'" for i, m in enumerate(_MARKED))
    return f"WITH marked AS (SELECT doc_id, CASE doc_id % 40 {case} ELSE text END AS text FROM documents) SELECT * FROM ({rows}) WHERE loose > 0"


@query(_screen_sql())
def marking_screen(spark, d):
    """The documents' texts, of which some end in one of the marks."""
    mark = F.element_at(F.array(*[F.lit(f" {m}.") for m in _MARKED]), (F.col("doc_id") % 40 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 40 < len(_MARKED), F.concat("text", mark)).otherwise(F.col("text"))
    return lay.screen(src.table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id")


@query("""WITH f AS (SELECT doc_id, CAST(toxic + (1 - quality) AS INTEGER) AS exact, 0 AS mark_no FROM labels), a AS (SELECT doc_id, 1 AS exact FROM labels WHERE doc_id % 5 = 0),
o AS (SELECT doc_id, count(*) AS b FROM f WHERE exact > 0 AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = f.doc_id AND a.exact = f.exact) GROUP BY 1)
SELECT doc_id, lang = 'en' AND n_chars <= 20000 AND coalesce(b, 0) = 0 AS cleared, coalesce(b, 0) AS blocked_by FROM documents LEFT JOIN o USING (doc_id)""")
def clearance(spark, d):
    lab = src.table(spark, d, "labels")
    found = lab.select("doc_id", F.lit(0).alias("mark_no"), (F.col("toxic") + 1 - F.col("quality")).cast("int").alias("exact"))
    judged = lab.where("doc_id % 5 = 0").select("doc_id", F.lit(0).alias("mark_no"), F.lit(1).alias("exact"))
    docs = src.table(spark, d, "documents").select("doc_id", (F.col("lang") == "en").alias("evidence"), (F.col("n_chars") > 20000).alias("restricted"))
    return lay.clearance(docs, found, judged, "doc_id")


_LINES = """ln AS (SELECT page_id AS doc, 0 AS page, block_no AS line_no, tag, text, CASE WHEN block_no % 2 = 0 THEN 50.0 ELSE 320.0 END::DOUBLE AS x,
  CASE WHEN block_no % 9 = 0 THEN 500.0 WHEN block_no % 2 = 0 THEN 250.0 ELSE 520.0 END::DOUBLE AS x1, CAST(block_no // 2 * 12 AS INTEGER) AS y, CAST(10 + block_no % 3 AS DOUBLE) AS size,
  tag LIKE 'h%' OR tag = 'li' AS bold, CASE WHEN block_no % 4 = 0 THEN 'ABCDEF+Arial-BoldMT' ELSE 'TimesNewRoman' END AS font FROM blocks)"""


def _lines(spark, d) -> DataFrame:
    b = tb.blocks(spark, d)
    even = F.col("block_no") % 2 == 0
    return b.select(
        F.col("page_id").alias("doc"), F.lit(0).alias("page"), F.col("block_no").alias("line_no"), "tag", "text", F.when(even, 50.0).otherwise(320.0).alias("x"),
        F.when(F.col("block_no") % 9 == 0, 500.0).when(even, 250.0).otherwise(520.0).alias("x1"), (F.expr("block_no div 2") * 12).cast("int").alias("y"), (10 + F.col("block_no") % 3).cast("double").alias("size"),
        (F.col("tag").startswith("h") | (F.col("tag") == "li")).alias("bold"), F.when(F.col("block_no") % 4 == 0, "ABCDEF+Arial-BoldMT").otherwise("TimesNewRoman").alias("font"),
    )


@query(_with(tb.BLOCKS, _LINES, r"""t AS (SELECT *, trim(text) AS t, regexp_replace(translate(text, '0158', 'OISB'), '[^\p{L}]', '', 'g') AS l FROM ln),
f AS (SELECT *, length(l) AS n, length(regexp_replace(l, '[^\p{Lu}]', '', 'g')) / greatest(length(l), 1) >= 0.75 AS caps FROM t)""") + """SELECT doc, line_no, text FROM f WHERE length(t) BETWEEN 3 AND 90 AND NOT regexp_matches(t, '[.,;:]$') AND n >= 3
AND ((bold AND size >= 1.15 * 10.0) OR (bold AND font <> 'TimesNewRoman' AND size >= 10.0) OR (NOT size < 9.5 AND caps))""")
def heading_lines(spark, d):
    is_heading = lay.heading(F.col("text"), F.col("size"), F.col("bold"), F.col("font"), F.lit(10.0), F.lit("TimesNewRoman"))
    return _lines(spark, d).where(is_heading).select("doc", "line_no", "text")


@query(_with(tb.BLOCKS, _LINES, """k AS (SELECT *, count(*) FILTER (WHERE length(text) > 20) OVER w AS n, count(*) FILTER (WHERE length(text) > 20 AND x < 300) OVER w AS l,
count(*) FILTER (WHERE length(text) > 20 AND x < 282 AND x1 > 318) OVER w AS a FROM ln WINDOW w AS (PARTITION BY doc, page)),
t AS (SELECT *, n >= 8 AND least(l, n - l) / greatest(n, 1) >= 0.2 AND a <= 0.15 * n AS two_columns FROM k)""") + """SELECT doc, page, line_no, two_columns,
CAST(row_number() OVER (PARTITION BY doc, page ORDER BY CASE WHEN two_columns AND x >= 300 THEN 1 ELSE 0 END, y, x, line_no) AS INTEGER) AS position FROM t""")
def reading_order(spark, d):
    return lay.reading_order(_lines(spark, d), 600.0).select("doc", "page", "line_no", "two_columns", "position")


_CHECKED = r"""pg AS (SELECT doc, page, label, own || coalesce(lead(own) OVER (PARTITION BY doc ORDER BY page), '') AS stream FROM (SELECT chapter AS doc, pos AS page, pos // 2 AS label, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS own FROM chunks)),
wd AS (SELECT id, chapter AS doc, pos // 2 + CASE WHEN id % 7 = 0 THEN 3 ELSE 0 END AS label, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM chunks),
pr AS (SELECT id, doc, label, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 12 THEN [array_to_string(w, ' ')]
  ELSE list_transform([0, 1, 2], lambda i: array_to_string(w[least(len(w) - 6, 2 + i * greatest(1, (len(w) - 6) // 3)) + 1:least(len(w) - 6, 2 + i * greatest(1, (len(w) - 6) // 3)) + 6], '')) END AS p FROM wd),
ht AS (SELECT id, len(p) AS n, page, CASE WHEN page IS NOT NULL THEN len(list_filter(p, lambda x: contains(stream, x))) END AS hits FROM pr LEFT JOIN pg USING (doc, label)),
checked AS (SELECT id, CAST(max(n) AS INTEGER) AS n_probes, CAST(coalesce(max(hits), 0) AS INTEGER) AS hits, CAST(min(page) FILTER (WHERE hits = top) AS INTEGER) AS page,
  CASE WHEN max(hits) IS NULL THEN 'NO_PAGE' WHEN max(hits) = max(n) THEN 'PASS' WHEN max(hits) > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM (SELECT *, max(hits) OVER (PARTITION BY id) AS top FROM ht) GROUP BY id)"""


def _checked(spark, d) -> DataFrame:
    c = tb.chunks(spark, d)
    label = F.expr("pos div 2")
    pages = c.select(F.col("chapter").alias("doc"), F.col("pos").alias("page"), label.alias("label"), "text")
    return vf.check(c.select("id", F.col("chapter").alias("doc"), (label + F.when(F.col("id") % 7 == 0, 3).otherwise(0)).alias("label"), "text"), pages)


@query(_with(tb.CHUNKS, _CHECKED) + "SELECT * FROM checked")
def citation_check(spark, d):
    return _checked(spark, d)


@query(_with(tb.CHUNKS, _CHECKED) + "SELECT verdict, count(*) AS n, round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM checked GROUP BY 1")
def citation_tally(spark, d):
    return vf.tally(_checked(spark, d))


_SUPPORT = """s AS (SELECT vec_id // 10 AS query_id, vec_id % 10 AS sent_no, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 10 < 6),
k AS (SELECT vec_id // 10 AS query_id, vec_id % 10 AS chunk_no, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 10 >= 6),
sup AS (SELECT query_id, sent_no, coalesce(round_even(sim, 4), 0.0) AS support, chunk_no AS best FROM (SELECT query_id, sent_no, chunk_no, sim, row_number() OVER (PARTITION BY query_id, sent_no ORDER BY sim DESC, chunk_no) AS r
  FROM (SELECT query_id, sent_no, chunk_no, CASE WHEN chunk_no IS NOT NULL THEN list_cosine_similarity(s.v, k.v) END AS sim FROM s LEFT JOIN k USING (query_id))) WHERE r = 1)"""


def _supports(spark, d) -> DataFrame:
    """Vectors in tens: the first six of ten are sentences of an answer, the others its chunks; every row has a part."""
    e = src.table(spark, d, "embeddings").select(F.expr("vec_id div 10").alias("query_id"), (F.col("vec_id") % 10).alias("no"), F.col("embedding").alias("vec"))
    return gr.supports(e.where("no < 6").withColumnRenamed("no", "sent_no"), e.where("no >= 6").withColumnRenamed("no", "chunk_no"))


@query(_with(_SUPPORT) + "SELECT * FROM sup")
def sentence_support(spark, d):
    return _supports(spark, d)


@query(_with(_SUPPORT) + """SELECT query_id, count(*) AS n, count(*) FILTER (WHERE support < 0.5) AS unsupported, min(support) AS min_support,
CASE WHEN count(*) FILTER (WHERE support < 0.5) = count(*) THEN 'ungrounded_answer' WHEN count(*) FILTER (WHERE support < 0.5) > 0 THEN 'mark' END AS action FROM sup GROUP BY 1""")
def grounding_actions(spark, d):
    return gr.actions(_supports(spark, d), 0.5)


@query(_with(tb.RECORDS) + """SELECT count(*) FILTER (WHERE kind = 'in') AS n_in, count(*) FILTER (WHERE kind = 'in' AND a) AS over_refusal, count(*) FILTER (WHERE kind = 'out' AND NOT e) AS n_out,
count(*) FILTER (WHERE kind = 'out' AND NOT e AND NOT a) AS false_answer, count(*) FILTER (WHERE kind = 'out' AND e) AS n_traps, count(*) FILTER (WHERE kind = 'out' AND e AND NOT a) AS traps_kept,
count(*) FILTER (WHERE kind = 'in' AND NOT a AND id % 5 <> 0) AS cite_scored, count(*) FILTER (WHERE kind = 'in' AND NOT a AND id % 5 <> 0 AND id % 3 = 0) AS cite_correct,
count(*) FILTER (WHERE kind = 'in' AND NOT a AND n_claims > 0) AS with_citation FROM (SELECT *, declined OR coalesce(top_score < 0, true) AS a, id % 4 = 0 AS e FROM records WHERE error IS NULL)""")
def answer_metrics(spark, d):
    r = tb.records(spark, d).where("error IS NULL")
    return ev.answer_metrics(r.select("kind", (F.col("id") % 4 == 0).alias("expects_answer"), (F.col("declined") | F.coalesce(F.col("top_score") < 0, F.lit(True))).alias("abstained"), F.when(F.col("id") % 5 != 0, F.col("id") % 3 == 0).alias("cited_relevant"), (F.col("n_claims") > 0).alias("has_citation")))


@query(r"""WITH c AS (SELECT conv_id, turn, role, regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g') AS p FROM conversations),
r AS (SELECT *, 'Sure: {"question": " ' || p || '", "key_points": [" turn ' || turn || ' ", "", "' || p || '", "' || role || '", "more"]} done' AS raw FROM c),
j AS (SELECT *, regexp_extract(raw, '(?s)\{.*\}') AS j FROM r)
SELECT conv_id, turn, trim(json_extract_string(j, '$.question')) AS question, list_filter(list_transform(CAST(json_extract(j, '$.key_points') AS VARCHAR[]), lambda k: trim(k)), lambda k: k <> '')[1:3] AS key_points FROM j WHERE length(trim(json_extract_string(j, '$.question'))) >= 15""")
def item_parse(spark, d):
    """Noisy model text around JSON made of each turn: blanks, an empty point, more points than are kept."""
    plain = F.regexp_replace("text", "[^A-Za-z0-9]+", " ")
    raw = F.concat(F.lit('Sure: {"question": " '), plain, F.lit('", "key_points": [" turn '), F.col("turn").cast("string"), F.lit(' ", "", "'), plain, F.lit('", "'), F.col("role"), F.lit('", "more"]} done'))
    got = src.table(spark, d, "conversations").select("conv_id", "turn", tx.item_json(raw).alias("i"))
    return got.where("i IS NOT NULL").select("conv_id", "turn", "i.question", "i.key_points")


# -- sequential text logic; where there is no SQL form, tests/test_language.py holds it against fixtures

_ASKED = "aq AS (SELECT item_id, 'MCDP 1-0, p. 5 -- chapter ' || item_id || ' of FM 3-' || (item_id % 7) || '.2x: ' || text || ' 7' AS text FROM benchmark UNION ALL SELECT -1, '-- ?!')"


@query(f"WITH {_ASKED}, {ls.phrases('aq')} SELECT item_id, coalesce(list(string_split(p, ' ') ORDER BY spot) FILTER (WHERE p IS NOT NULL), []) AS phrases FROM aq LEFT JOIN qp USING (item_id) GROUP BY 1")
def query_phrases(spark, d):
    """Search phrases of every question, publications and chapters named before it; and of one without a word."""
    from ..operators import language

    text = F.concat(F.lit("MCDP 1-0, p. 5 -- chapter "), F.col("item_id").cast("string"), F.lit(" of FM 3-"), (F.col("item_id") % 7).cast("string"), F.lit(".2x: "), "text", F.lit(" 7"))
    asked = src.table(spark, d, "benchmark").select("item_id", text.alias("text"))
    odd = spark.range(1).select(F.lit(-1).cast("long").alias("item_id"), F.lit("-- ?!").alias("text"))
    return asked.unionByName(odd).select("item_id", language.query_phrases("text").alias("phrases"))


@query()
def presuppositions(spark, d):
    from ..operators import language

    turn = F.col("turn").cast("string")
    asked = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("What are the "), turn, F.lit(" phases of planning? "))).when(F.col("turn") % 4 == 1, F.concat(F.lit("According to the 201"), F.col("turn") % 10, F.lit(" Field Guide, what is the dose? "))).when(F.col("turn") % 4 == 2, F.concat(F.lit("What does the 3rd edition say on page "), turn, F.lit("? "))).otherwise("")
    said = src.table(spark, d, "conversations").select("conv_id", "turn", F.concat(asked, "text").alias("q"))
    return said.select("conv_id", "turn", F.explode(language.presuppositions("q")).alias("p")).select("conv_id", "turn", "p.*")


@query(rf"""WITH tv AS MATERIALIZED (SELECT term, count(*) AS n FROM (SELECT unnest({_TOK('text')}) AS term FROM documents) GROUP BY 1),
{ls.stems('tv', 'ts')} SELECT stem, count(*) AS forms, CAST(sum(n) AS BIGINT) AS n FROM tv JOIN ts USING (term) GROUP BY 1""")
def stemmed_vocabulary(spark, d):
    from ..operators import language

    terms = src.table(spark, d, "documents").select(F.explode(tx.tokens("text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    one = terms.select(language.stems(F.array("term"))[0].alias("stem"), "n")
    return one.groupBy("stem").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n"))


@query()
def answer_specifics(spark, d):
    """Each turn of a conversation against the turn before it, which is both its question and its only source."""
    from pyspark.sql import Window

    from ..operators import specifics

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = src.table(spark, d, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before"))
    return t.select("conv_id", "turn", specifics.specifics_verdict("text", "before", F.array("before")).alias("v")).select("conv_id", "turn", F.size("v.unsupported").alias("unsupported"), "v.refuse", "v.reason")


from . import further, study  # noqa: E402, F401  (add their queries to the tables above)
