"""Items, reviews, tracks, sinks and readers on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quirework.functions import maths
from quirework.functions import text as tx
from quirework.operators import bank
from quirework.operators import language as lg
from quirework.operators import layout as lay
from quirework.operators import learning as lr
from quirework.operators import records as rec
from quirework.sources import manifest as mf
from quirework.sources import tables as src

CHUNK = "id long, pub_id string, chapter int, section string, text string, n_chars int"


def _chunks(spark):
    rows = [(1, "P 1", None, "a", "x" * 90), (2, "P 1", None, "a", "y" * 80), (3, "P 1", 1, "a", "z" * 70), (4, "P 1", 1, "b", "w" * 10), (5, "P 1", None, "a", "v" * 85)]
    return spark.createDataFrame([(*r, len(r[4])) for r in rows], CHUNK)


def test_sections_with_and_without_a_chapter_are_apart(spark):
    c = _chunks(spark)
    s = c.select("pub_id", "chapter", "section").distinct()
    got = {(r.chapter, r.section, r.id): r.ordinal for r in bank.section_chunks(s, c, 2, 50).collect()}
    assert got == {(None, "a", 1): 0, (None, "a", 5): 1, (1, "a", 3): 0}


def test_generation_leaves_out_what_fails_and_resumes(spark):
    c = _chunks(spark)
    s = c.select("pub_id", "chapter", "section").distinct()
    say = lambda t: F.when(F.substring(t, 1, 1) != "v", F.concat(F.lit('ok {"question": "What is told of '), F.substring(t, 1, 1), F.lit(' here?", "key_points": ["k"]}')))
    all_ = bank.generate(bank.section_chunks(s, c, 2, 50), say).collect()
    assert {(r.source_chunk_id, r.ordinal) for r in all_} == {(1, 0), (3, 0)} and all(r.item_id.startswith("P1-c") for r in all_)
    rest = bank.generate(bank.section_chunks(lr.undone(s, s.where("chapter IS NULL")), c, 2, 50), say).collect()
    assert {r.item_id for r in rest} == {r.item_id for r in all_ if r.chapter == 1}
    t = bank.track_of(spark.createDataFrame(all_))
    assert [(r.chapter, r.place, len(r.item_ids)) for r in t.orderBy("place").collect()] == [(None, 1, 1), (1, 2, 1)]
    pool = bank.servable_track(t, spark.createDataFrame(all_).where("chapter = 1"))
    assert [(r.section, r.pos) for r in pool.collect()] == [("a", 0)]


def test_ungrounded_points_and_failed_checks(spark):
    p = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, None), (2, 1, [1.0, 0.0]), (3, 0, [1.0, 1.0])], "item_id int, point_no int, vec array<double>")
    s = spark.createDataFrame([(1, 0, [1.0, 0.1]), (2, 0, [1.0, 0.0])], "item_id int, sent_no int, vec array<double>")
    got = {(r.item_id, r.point_no): (r.best, r.code) for r in bank.ungrounded(p, s).collect()}
    assert got == {(1, 0): (1.0, None), (1, 1): (0.1, "UNGROUNDED_KEY_POINT"), (2, 0): (None, "PRECHECK_FAILED"), (2, 1): (None, "PRECHECK_FAILED"), (3, 0): (0.0, "UNGROUNDED_KEY_POINT")}
    items = spark.createDataFrame([(1, "Explain how friction slows a force in war", ["friction of every kind"], "a plain source"), (2, "Short?", [], "see Ibid., p. 4")], "item_id int, question string, key_points array<string>, source_text string")
    flags = {r.item_id: [x.code for x in r.flags] for r in bank.precheck(items, bank.ungrounded(p, s)).collect()}
    assert flags == {1: ["UNGROUNDED_KEY_POINT"], 2: ["SHAPE", "SOURCE_NOT_TEACHABLE", "PRECHECK_FAILED"]}


def test_queue_and_bulk_leave_what_is_not_pending_or_not_in_the_bank(spark):
    r = spark.createDataFrame([(1, "pending", []), (2, "pending", None), (3, "pending", ["SHAPE"]), (4, "approved", []), (9, "pending", []), (5, "pending", ["UNGROUNDED_KEY_POINT", "SHAPE"])], "item_id int, status string, flags array<string>")
    items = spark.createDataFrame([(i, f"q{i}") for i in range(1, 7)], "item_id int, question string")
    assert [(x.item_id, x.severity) for x in bank.queue(r, items).collect()] == [(5, 2), (3, 1), (1, 0), (2, 0)]
    got = {x.item_id: (x.status, x.reviewer, x.checked) for x in bank.bulk_approve(r, items).collect()}
    assert got == {1: ("approved", "bulk:unflagged", True), 2: ("pending", None, False), 3: ("pending", None, True), 5: ("pending", None, True)}
    edits = spark.createDataFrame([(1, "", []), (2, "new", ["a"])], "item_id int, edited_question string, edited_points array<string>")
    out = {x.item_id: (x.question, x.key_points) for x in bank.with_edits(items.withColumn("key_points", F.array(F.lit("k"))), edits).collect()}
    assert out[1] == ("q1", ["k"]) and out[2] == ("new", ["a"]) and out[3] == ("q3", ["k"])


def test_answers_without_a_factual_sentence_are_not_refused(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    s = spark.createDataFrame([(1, 0.9), (1, 0.2), (2, 0.5)], "query_id int, support double")
    assert {tuple(r) for r in bank.gate_answers(a, s, 0.5).collect()} == {(1, 0.2, True), (2, 0.5, False), (3, 1.0, False)}


def test_a_batch_written_twice_counts_once_and_exports_are_noted(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a", "q", i % 2 == 0, 1.0, "t") for i in range(6)], "seq long, actor string, question string, answered boolean, latency_s double, answer_text string")
    path, notes = f"file://{tmp_path}/i", f"file://{tmp_path}/n"
    for batch, where in ((1, "seq < 3"), (2, "seq >= 3"), (2, "seq >= 3")):
        rec.append(rows.where(where), path, batch)
    got = rec.appended(spark, path).collect()
    assert sorted(r.seq for r in got) == list(range(6)) and all(json.loads(r.statement_json)["actor"]["name"] == "a" for r in got)
    rec.mark_exported(rows.where("seq < 2"), notes, 1)
    rec.mark_exported(rows.where("seq < 4"), notes, 2)
    assert sorted(r.seq for r in rec.pending(rec.appended(spark, path), spark.read.parquet(notes)).collect()) == [4, 5]


def test_manifest(spark):
    m = spark.createDataFrame([("MCDP 1", True), ("MCWP 2", None), ("mcdp 3", True)], "pub_id string, cleared boolean")
    assert [r.pub_id for r in mf.cleared_documents(m, "Mcdp").collect()] == ["MCDP 1", "mcdp 3"]
    with pytest.raises(ValueError):
        mf.required(mf.cleared_documents(m, "x"), "document")
    p = spark.createDataFrame([(1, 0, " ", True), (1, 1, None, True), (1, 2, None, None), (1, 3, "t", True)], "doc int, page int, text string, has_image boolean")
    assert [tuple(r) for r in mf.blind_spots(p).collect()] == [(1, [0, 1])]


def test_section_counter_and_outline(spark):
    p = spark.createDataFrame([(1, 1, None, 0), (1, 1, "a", 1), (1, 1, "a", 2), (1, 2, "a", 3), (1, 2, None, 4)], "doc int, chapter int, section string, pos int")
    seq = lambda by: [r.section_seq for r in lay.section_counter(p, by).orderBy("pos").collect()]
    assert seq(True) == [0, 1, 1, 1, 2] and seq(False) == [0, 1, 1, 1, 2]
    o = spark.createDataFrame([(1, 0, 1, "x"), (1, 3, 2, " a \n b "), (1, -1, 1, "y")], "doc int, page int, level int, title string")
    assert [tuple(r) for r in lay.clean_outline(o).collect()] == [(1, 2, 2, "a b")]


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "x": 1,\n "y": "b"\n}')
    (tmp_path / "b.bin").write_bytes(b"\x00abc")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.StringType())])
    assert [tuple(r) for r in src.json_document(spark, f"file://{tmp_path}/a.json", schema).collect()] == [(1, "b")]
    got = src.file_digests(spark, f"file://{tmp_path}/*.bin").first()
    assert (got.bytes, got.sha256) == (4, hashlib.sha256(b"\x00abc").hexdigest())
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(maths.epoch_text(F.lit(86400))) == "1970-01-02T00:00:00Z" and one(maths.percent_text(F.lit(1), F.lit(0))) == "n/a" and one(maths.percent_text(F.lit(1), F.lit(3))) == "33.3%"
    assert one(tx.support_label(F.lit(None).cast("string"))) == "NOT_SUPPORTED" and one(tx.dehyphenated(F.array(F.lit("ma-"), F.lit("ny --"), F.lit("x-"), F.lit("Y")))) == "many -- x- Y"
    h = spark.createDataFrame([("Frictoin",), ("Nothing alike",), (None,)], "heading string")
    assert [r.title for r in lg.match_headings(h, ["Fraction of", "Friction"]).collect()] == ["Friction", None, None]


def test_dense_grid_equals_a_plain_search(spark):
    import numpy as np

    from quirework.operators import retrieval as rt

    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 6))
    df = spark.createDataFrame([(i, i // 3, [float(x) for x in v[i]]) for i in range(200)] + [(900, 300, None), (901, 301, [1.0])], "vec_id long, chunk_id long, embedding array<float>").repartition(5)
    q = df.where("vec_id % 9 = 0 AND vec_id < 200").select(F.col("vec_id").alias("query_id"), "embedding")
    v = v.astype(np.float32).astype(float)
    want = set()
    for i in range(0, 200, 9):
        d = np.round(np.sqrt(((v - v[i]) ** 2).sum(axis=1)), 6)
        best: dict = {}
        for j in np.lexsort((np.arange(200), d))[:12]:
            best.setdefault(int(j) // 3, float(d[j]))
        want |= {(i, c, x, r) for r, (c, x) in enumerate(sorted(best.items(), key=lambda t: (t[1], t[0]))[:4], 1)}
    for options in ({}, {"rows": 7, "query_rows": 3, "group_bytes": 200}):
        assert {tuple(r) for r in rt.dense(df, q, 4, **options).collect()} == want
    assert rt.dense(df, q.limit(0), 4).count() == 0


def test_answers_stand_only_with_a_marker_that_names_a_source(spark):
    from quirework.config import Gates
    from quirework.operators import answering

    q = spark.createDataFrame([(i, f"q{i}") for i in range(1, 7)], "query_id int, question string")
    long = "A sentence that is long enough to be factual."
    hits = spark.createDataFrame([(1, 1, 4.0, -2.0, "P 1", long), (1, 2, 3.0, None, "P 2", "y"), (2, 1, 1.0, None, "P 1", long), (3, 1, 5.0, None, "P 1", "short"), (4, 1, 5.0, None, "P 4", "fails"), (5, 1, 5.0, None, "P 5", "uncited")], "query_id int, rank int, rerank_score double, bm25_score double, citation string, text string")
    made = answering.assembled(q, hits)

    def generator(prompt, sources):
        t = F.get(sources, 0)["text"]
        return F.when(t == "fails", F.lit(None)).when(t == "uncited", long).otherwise(answering.extractive(prompt, sources))

    got = {r.query_id: (r.reason, r.answer, r.cited) for r in answering.answer(made, generator, Gates(score=3.0)).collect()}
    assert got == {1: (None, f"{long} [1]", ["P 1"]), 2: ("low_retrieval_score", None, None), 3: ("model_declined", None, None), 4: ("model_unavailable", None, None), 5: ("uncited_answer", None, None), 6: ("no_results", None, None)}
    rescued = answering.answer(made.where("query_id = 1"), answering.extractive, Gates(score=4.5, rescue=1.5)).first()
    assert rescued.reason is None


def test_refused_batches_are_halved_and_texts_shortened():
    from quirework.operators import scoring as sc

    sizes = []

    def call(texts):
        sizes.append(len(texts))
        if len(texts) > 2 or any(len(t) > 600 for t in texts):
            raise sc.Refused
        return [(i, len(t)) for i, t in reversed(list(enumerate(texts)))]

    out, cut = sc.embed_all(["a", "bb", "c" * 1000, "dddd", "e"], call)
    assert out == [1, 2, 500, 4, 1] and cut == {2: 500} and sizes[0] == 5
    assert sc.embed_all([], call) == ([], {})
    with pytest.raises(sc.Refused):
        sc.embed_all(["x" * 400], lambda t: (_ for _ in ()).throw(sc.Refused()))
    tried = []

    def rank(query, docs):
        tried.append(max(map(len, docs)))
        if tried[-1] > 200:
            raise sc.Refused
        return [(1, 2.0), (0, 1.0)]

    assert sc.rerank_scores("q", ["a" * 900, "b"], rank) == [1.0, 2.0] and tried == [700, 350, 175] and sc.rerank_scores("q", [], rank) == []


def test_settings_file(tmp_path):
    from quirework import config

    (tmp_path / "a.json").write_text('{"search": {"final_k": 5}, "gates": {"score": null}}')
    search, gates = config.load(str(tmp_path / "a.json"))
    assert (search.final_k, search.bm25_k, gates.score) == (5, 50, None)
    (tmp_path / "b.json").write_text('{"gates": {"scores": 1}}')
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "b.json"))


def test_lines_are_appended_once(spark, tmp_path):
    from quirework.streaming import sinks

    rows = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    for k in range(2):
        rows.withColumn("x", F.col("x") + 10 * k).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        sinks.append_lines(stream, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True).awaitTermination(120)
    got = src.json_lines(spark, str(tmp_path / "out"), rows.schema).collect()
    assert sorted((r.x, r.y) for r in got) == [(1, "a"), (2, None), (11, "a"), (12, None)]
