"""Cases that a plausible reading gets wrong: traps, grids, learners' states, furniture, short names, phrases."""

import random
import sqlite3
import statistics

from pyspark.sql import functions as F

from quirework.functions import maths
from quirework.functions import text as tx
from quirework.operators import evaluation as ev
from quirework.operators import language as lg
from quirework.operators import layout as lay
from quirework.operators import learning as lr
from quirework.operators import lexical as lx
from quirework.operators import records as rec
from quirework.operators import retrieval as rt
from quirework.sources import shared

RECORD = "id int, kind string, expects boolean, top_score double, min_support double, n_claims int, declined boolean, error string, pub_id string"


def _records(n=240):
    rng = random.Random(9)
    return [(i, rng.choice(["in", "out"]), rng.random() < 0.4, None if rng.random() < 0.1 else round(rng.uniform(-5, 5), 3), None if rng.random() < 0.2 else round(rng.random(), 2), rng.randrange(3), rng.random() < 0.1, "timeout" if rng.random() < 0.05 else None, f"p{i % 3}") for i in range(n)]


def test_rounding_is_of_the_binary_value(spark):
    rng = random.Random(3)
    xs = [2.675, 1.115, 0.285, 1.005, -2.675, 0.125, 0.375, -0.5, 0.0, 1e6 + 0.005] + [rng.randrange(-10**6, 10**6) / 1000 for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", maths.round_exact(F.col("x"), 2).alias("y"), maths.round_exact(F.col("x") / 7, 3).alias("z"))
    assert all(r.y == round(r.x, 2) and r.z == round(r.x / 7, 3) for r in df.collect())


def test_traps_are_no_false_answers_and_the_grid_is_21_by_20(spark):
    rows = _records()
    df = spark.createDataFrame(rows, RECORD)
    ok = [r for r in rows if r[7] is None]
    grid = [None] + [round(x, 2) for x in [min(r[3] for r in ok if r[3] is not None) - 1] + statistics.quantiles([r[3] for r in ok if r[3] is not None], n=20)]
    supports = [None] + [round(x, 3) for x in statistics.quantiles([r[4] for r in ok if r[4] is not None], n=20)]
    swept = ev.sweep(df, ev.quantile_grid(df.where("error IS NULL"), "top_score"), ev.quantile_grid(df.where("error IS NULL"), "min_support", below=False, places=3))
    got = {(r.g1, r.g2): r for r in swept.collect()}
    assert len(got) == 21 * 20 and [got[i, 0].score_thr for i in range(21)] == grid and [got[0, j].support_thr for j in range(20)] == supports

    def answers(r, s, u):
        return not r[6] and (s is None or (r[3] is not None and r[3] >= s)) and (u is None or r[5] == 0 or (r[4] is not None and r[4] >= u))

    best = []
    for i, s in enumerate(grid):
        for j, u in enumerate(supports):
            inside, out, traps = [r for r in ok if r[1] == "in"], [r for r in ok if r[1] == "out" and not r[2]], [r for r in ok if r[1] == "out" and r[2]]
            refused, false, missed = sum(not answers(r, s, u) for r in inside), sum(answers(r, s, u) for r in out), sum(not answers(r, s, u) for r in traps)
            g = got[i, j]
            assert (g.n_in, g.n_out, g.n_traps, g.refused, g.false_answers, g.trap_missed) == (len(inside), len(out), len(traps), refused, false, missed)
            best.append((false / len(out) + refused / len(inside), missed, i, j))
    top = ev.best_point(swept).first()
    assert (top.g1, top.g2) == min(best)[2:]


def test_every_learner_sees_new_sections_and_own_calibration(spark):
    track = spark.createDataFrame([("p", "a", 1), ("p", "a", 2), ("p", "b", 3), ("q", "c", 4)], "pub_id string, section string, item_id int")
    scores = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 1.0), ("y", 1, 0.0), ("y", 9, 1.0)], "learner string, item_id int, score double")
    got = {(r.learner, r.section): (r.state, r.attempted) for r in lr.progress(scores, track, track.where("item_id <> 4")).collect()}
    assert got == {("x", "a"): ("mastered", 2), ("x", "b"): ("new", 0), ("y", "a"): ("shaky", 1), ("y", "b"): ("new", 0)}
    pubs = {(r.learner, r.pub_id): (r.n_items, r.attempted, r.pct) for r in lr.rolled_up(lr.progress(scores, track), ["learner", "pub_id"]).collect()}
    assert pubs == {("x", "p"): (3, 2, 67), ("x", "q"): (1, 0, 0), ("y", "p"): (3, 1, 33), ("y", "q"): (1, 0, 0)}
    over = {r.section: (r.attempts, r.mastered, r.pct) for r in lr.class_overview(scores, track).collect()}
    assert over == {"a": (3, 2, 67), "b": (0, 0, 0), "c": (0, 0, 0)}
    attempts = spark.createDataFrame([("x", 4, 0.0), ("x", 4, 0.5), ("x", 1, 1.0), ("y", 4, 1.0), ("y", None, 0.0)], "learner string, confidence int, score double")
    c = lr.calibration(attempts)
    assert {(r.learner, r.confidence): r.gap for r in c.collect()} == {("x", 4): -0.75, ("x", 1): 1.0, ("y", 4): 0.0}
    assert {tuple(r) for r in lr.overconfidence(c).collect()} == {("x", 3, 0.667, 4), ("y", 1, 0.0, 4)}


def test_next_item_goes_as_far_as_unseen_items_can_lie(spark):
    items = spark.createDataFrame([(i, i) for i in range(1, 8)], "item_id int, pos int")
    sched = spark.createDataFrame([("a", i, 1, 100) for i in (1, 2, 3)] + [("b", i, 1, 100) for i in range(1, 8)] + [("c", 2, 3, 5)], "learner string, item_id int, streak int, due long")
    last = spark.createDataFrame([("a", 4), ("b", 1), ("c", 9)], "learner string, item_id int")
    assert {tuple(r) for r in lr.next_item(sched, items, last, 50).collect()} == {("a", 5, 2), ("b", 2, 3), ("c", 2, 1)}


def test_furniture_is_of_one_document_and_the_margins(spark):
    line = lambda d, p, y, t: (d, p, y, t, y, 100)
    rows = [line(1, p, 2, f"Title  page {p}") for p in range(3)] + [line(1, p, 50, "middle") for p in range(5)] + [line(d, 0, 95, "foot") for d in range(5)] + [line(1, p, 97, str(p)) for p in range(4)] + [line(1, 9, 40, "Title page 77")]
    lines = spark.createDataFrame(rows, "doc int, page int, line_no int, text string, y int, height int")
    found = lay.furniture(lines)
    assert [tuple(r) for r in found.collect()] == [(1, "Title page #", 3)]
    kept = lay.body_lines(lines, found).where("doc = 1").groupBy("text").count().collect()
    assert {r.text: r["count"] for r in kept} == {"middle": 5, "foot": 1}


def test_short_loaded_names_count_both_ways(spark):
    named = spark.createDataFrame([("FM 3-0",), ("JP 1",), ("MCDP 1",), ("X",)], "pub string")
    loaded = spark.createDataFrame([("FM",), ("MCDP 1-3",), ("Q",)], "pub string")
    assert {r.pub for r in rec.missing_publications(named, loaded).collect()} == {"JP 1", "X"}
    assert rec.missing_publications(named, loaded.limit(0)).count() == 4


def test_item_ids_keep_the_publications_case(spark):
    got = spark.range(1).select(tx.item_id(F.lit("MCDP 1-3"), F.lit(2), F.lit("a  b"), F.lit(0)).alias("x")).first().x
    assert got.startswith("MCDP13-c2-") and got.endswith("-0")


def test_lexical_search_equals_the_standard_full_text_engine(spark, tmp_path):
    rng = random.Random(4)
    bank = "MCDP 1 0 MCWP 3-11.3 chapter 5 Étude étude running runs run ran relational naïve Straße Ünïted p. logistics analogies possibly ibly 12th foo_bar -- war's".split()
    docs = [(i, " ".join(rng.choice(bank) for _ in range(rng.randrange(1, 40)))) for i in range(300)] + [(900, ""), (901, "漢字 ëë")]
    asked = [(i, " ".join(rng.choice(bank) for _ in range(rng.randrange(1, 8)))) for i in range(40)] + [(77, "?!"), (78, "MCDP 1-0"), (79, "chapter 5 chapter 5")]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.executemany("insert into t(rowid, x) values (?, ?)", docs)
    path = str(tmp_path / "docs")
    spark.createDataFrame(docs, "d long, text string").write.parquet(path)
    table = spark.read.parquet(path)
    index = lx.index_of(table, "d")
    assert lx.index_of(spark.read.parquet(path), "d") is index
    got: dict = {}
    for r in lx.bm25(index, spark.createDataFrame(asked, "q long, text string"), 10, "q").collect():
        got.setdefault(r.query_id, []).append((r.score, r.d))
    for q, t in asked:
        expr = " OR ".join(f'"{" ".join(p)}"' for p in lg.phrases(t))
        want = [(round(s, 6), d) for d, s in con.execute("select rowid, bm25(t) from t where t match ? order by bm25(t), rowid limit 10", (expr,))] if expr else []
        assert [round(s, 5) for s, _ in sorted(got.get(q, []))] == [round(s, 5) for s, _ in sorted(want)]


def test_rerank_keeps_the_scorers_best(spark):
    rows = [(1, 1, "a b", "a"), (1, 2, "a b", "a b"), (1, 3, "a b", "b a"), (2, 1, "c", "x")]
    c = spark.createDataFrame(rows, "query_id int, fused_rank int, question string, document string")
    score = lambda q, d: tx.overlap(tx.tokens(d), tx.tokens(q))
    assert [(r.query_id, r.fused_rank, r["rank"]) for r in rt.rerank(c, score, 2).orderBy("query_id", "rank").collect()] == [(1, 2, 1), (1, 3, 2), (2, 1, 1)]


def test_no_local_folder_on_a_cluster(monkeypatch):
    import pytest

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://a:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        shared.folder(Session())
