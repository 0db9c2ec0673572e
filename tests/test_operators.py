"""Operators on small fixtures: nulls, empties, ties."""

from pyspark.sql import functions as F

from quirework.functions import maths
from quirework.functions import text as tx
from quirework.operators import evaluation as ev
from quirework.operators import gates
from quirework.operators import layout as lay
from quirework.operators import learning as lr
from quirework.operators import lexical as lx
from quirework.operators import records as rec
from quirework.operators import retrieval as rt
from quirework.sources import tables as src


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_header_forms(spark):
    rows = [("A 1", "A 1", 2, "Fire", "Smoke", "body"), ("A 1", "Title", None, "Fire", None, None), ("A 1", None, None, None, None, "")]
    df = spark.createDataFrame(rows, "p string, t string, c int, ct string, s string, b string")
    h = tx.retrieval_header("p", "t", "c", "ct", "s")
    got = [r.x for r in df.select(tx.retrieval_text(h, F.col("b")).alias("x")).collect()]
    assert got == ["A 1 | Chapter 2: Fire | Smoke\nbody", "A 1, Title | Fire\n", "A 1\n"]


def test_citation_and_usable_section(spark):
    c = lambda *a: one(spark, tx.citation(*[F.lit(x) for x in a]).alias("x")).x
    assert c("P 1", "1997", "Chapter 5", 5, "Friction", 3, "7-7") == 'P 1, (1997), Ch 5, "Friction", para 3, p.7-7'
    assert c("P 1", "", "War", 1, "1234 56", 2, "") == "P 1, Ch 1: War, para 2"


def test_windows_and_quantiles(spark):
    t = "x" * 1151
    w = one(spark, tx.windows(F.lit(t)).alias("w")).w
    assert [(x.start, len(x.text)) for x in w] == [(0, 1000), (800, 351)]
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8, 16)], "v double")
    g = [r.v for r in ev.quantile_grid(df, "v").orderBy("grid_no").collect()]
    assert g[0] is None and g[1] == 0.0 and round(g[2], 6) == 0.3


def test_intervals_and_epoch(spark):
    day = lambda s, v, c: one(spark, maths.interval_days(F.lit(s), F.lit(v), F.lit(c).cast("int")).alias("d")).d
    assert [day(1, "incorrect", 3), day(0, "incorrect", None), day(4, "partial", 4), day(9, "correct", 4), day(9, "correct", None), day(0, "correct", 2)] == [0, 1, 1, 60, 3, 1]
    e = lambda s: one(spark, maths.epoch(F.lit(s).cast("string")).alias("e")).e
    assert e("1970-01-02T00:00:00Z") == 86400.0
    assert [e(x) for x in (None, "", "1970-01-02 00:00:00Z", "1970-13-02T00:00:00Z", "soon")] == [0.0] * 5


def test_schedule_is_the_fold(spark):
    import random

    rng = random.Random(4)
    rows = [(s, rng.randrange(3), rng.randrange(4), rng.choice(["correct", "correct", "partial", "incorrect"]), rng.choice([None, 1, 2, 3, 4]), 1000 + s) for s in range(300)]
    df = spark.createDataFrame(rows, "seq long, learner int, item_id int, verdict string, confidence int, at long")
    want = {}
    for _, l, i, v, _, _ in rows:
        want[l, i] = want.get((l, i), 0) + 1 if v == "correct" else 0
    assert {(r.learner, r.item_id): r.streak for r in lr.schedule(df).collect()} == want


def test_score_gate_nulls_and_rescue(spark):
    df = spark.createDataFrame([(0, 9.0, None), (1, None, None), (1, 2.0, -9.0), (1, 2.0, -1.0), (1, 4.0, None)], "n int, s double, b double")
    got = [r.x for r in df.select(gates.score_gate(F.col("n"), F.col("s"), 3.0, F.col("b"), 5.0).alias("x")).collect()]
    assert got == ["no_results", "low_retrieval_score", None, "low_retrieval_score", None]


def test_cite_or_refuse(spark):
    long_ = "This sentence is surely long enough to be factual"
    df = spark.createDataFrame([(f"{long_}.", 2), (f"{long_} [2].", 2), (f"{long_} [3].", 2), ("Short one.", 2), ("NOT_IN_SOURCES", 2)], "a string, n int")
    got = [r.x for r in df.select(gates.cite_or_refuse(F.col("a"), F.col("n"), "NOT_IN_SOURCES").alias("x")).collect()]
    assert got == ["uncited_answer", None, "uncited_answer", None, "model_declined"]


def test_three_valued_flags(spark):
    df = spark.createDataFrame([(None,), ([],), (["SHAPE"],)], "f array<string>")
    assert [r.x for r in df.select(lr.bulk_decision(F.col("f")).alias("x")).collect()] == ["unchecked", "approve", "flagged"]


def test_upsert_and_insert_missing(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, note string")
    new = spark.createDataFrame([("b", 3, None), ("c", 4, "z")], "k string, n int, note string")
    got = {tuple(r) for r in src.upsert(old, new, ["k"], ["note"]).collect()}
    assert got == {("a", 1, "x"), ("b", 3, "y"), ("c", 4, "z")}
    assert src.insert_missing(old, new, ["k"]).count() == 3


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "id long, t string")
    src.write_json_lines(df, str(tmp_path / "j"))
    back = src.json_lines(spark, str(tmp_path / "j"), df.schema)
    assert [tuple(r) for r in back.collect()] == [(1, "é", None)]


def test_bundle_is_signed():
    b = rec.signed_bundle([{"seq": 2, "id": 1}, {"seq": 1, "id": 9}], b"k")
    assert rec.verified(b, b"k") and not rec.verified(b, b"other") and b["payload"].startswith('[{"id":9')


def test_sequence_goes_on(spark):
    old, new = spark.createDataFrame([(5,)], "seq long"), spark.createDataFrame([("b",), ("a",)], "x string")
    assert {(r.x, r.seq) for r in rec.with_seq(new, old, ["x"]).collect()} == {("a", 6), ("b", 7)}
    assert rec.with_seq(new, old.limit(0), ["x"]).agg(F.max("seq")).first()[0] == 2


def test_screening_case(spark):
    df = spark.createDataFrame([(1, "TOP SECRET plan"), (2, "a secret"), (3, "open")], "doc_id int, text string")
    got = {(r.doc_id, r.mark_no, r.exact, r.loose) for r in lay.screen(df, "doc_id").collect()}
    assert got == {(1, 5, 1, 1), (1, 7, 1, 1), (2, 5, 0, 1)}


def test_short_carry_drops_the_tail(spark):
    rows = [(1, 0, "a"), (1, 1, "b" * 80), (1, 2, "c"), (2, 0, "d")]
    got = [tuple(r) for r in lay.carry_short(spark.createDataFrame(rows, "doc int, pos int, text string")).select("doc", "text").collect()]
    assert got == [(1, "a " + "b" * 80)]


def test_bm25_empty_and_ties(spark):
    docs = spark.createDataFrame([(2, "cat dog"), (1, "cat dog"), (3, "")], "d int, text string")
    q = spark.createDataFrame([(7, "cat"), (8, "bird"), (9, "")], "q int, text string")
    got = [(r.query_id, r.d, r["rank"]) for r in lx.bm25(lx.build(docs, "d"), q, 5, "q").orderBy("rank").collect()]
    assert got == [(7, 1, 1), (7, 2, 2)]


def test_reconcile_by_missed_list_and_verdict(spark):
    points = ["alpha bravo", "charlie delta", "echo foxtrot", "alpha golf", "of it"]
    cases = [(["said alpha bravo"], "partial"), ([], "incorrect"), ([], "correct"), (None, None), (["zulu"], "partial"), (["charlie delta", "echo"], "correct")]
    df = spark.createDataFrame([(i, points, m, v) for i, (m, v) in enumerate(cases)], "i int, points array<string>, missed array<string>, verdict string")
    got = [r.r for r in df.select("i", lr.reconcile_missed(F.col("points"), F.col("missed"), F.col("verdict")).alias("r")).orderBy("i").collect()]
    want = [[points[0], points[3]], points, [], points, points, points[1:3]]
    assert [r.missed for r in got] == want and [r.covered for r in got] == [[p for p in points if p not in m] for m in want]


def test_seq_over_many_ranges_without_one_window(spark):
    new = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 5000).alias("x")).repartition(7)
    out = rec.with_seq(new, spark.createDataFrame([(10,)], "seq long"), ["x"])
    assert {(r.x, r.seq) for r in out.collect()} == {(i, 11 + i) for i in range(5000)}
    rows = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in rows and "_n" in rows
