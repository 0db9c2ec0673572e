"""References, page structure, manifest and tuning on small fixtures."""

from pyspark.sql import functions as F

from quirework.operators import evaluation as ev
from quirework.operators import layout as lay
from quirework.operators import learning as lr
from quirework.operators import records as rec
from quirework.operators import references as ref
from quirework.sources import manifest as mf
from quirework.plans.catalog import QUERIES
from quirework.streaming import windows as win

from .conftest import SF

PROSE = "All actions take place in an atmosphere of uncertainty, which nobody who has been there will forget."


def test_notes_leave_the_head_only(spark):
    cases = {
        "7. Ibid., p. 1-6. " + PROSE: PROSE,
        "6. War, pp. 4-21 and p. 30. 18. Tempo is often held for speed. " + PROSE: "Tempo is often held for speed. " + PROSE,
        "7. Learning (New York: Cambridge Books, 1975). " + PROSE: PROSE,
        "1. Orient the map. " + PROSE: "1. Orient the map. " + PROSE,
        "3-67. Move, p. 3. " + PROSE: "3-67. Move, p. 3. " + PROSE,
        "7. Ibid., p. 6. 8. Ibid., p. 9.": "7. Ibid., p. 6. 8. Ibid., p. 9.",
        "7. Ibid., p. 6. " + PROSE + " 9. Smith, p. 4.": "7. Ibid., p. 6. " + PROSE + " 9. Smith, p. 4.",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = [r.x for r in df.select("i", ref.without_head("t").alias("x")).orderBy("i").collect()]
    assert got == list(cases.values())
    again = spark.createDataFrame([(t,) for t in got], "t string").select((ref.without_head("t").eqNullSafe(F.col("t"))).alias("same"))
    assert all(r.same for r in again.collect())


def test_apparatus_order_and_borders(spark):
    cases = ["see C-11. Move, p. 3", "11. Move, p. 3", "(Paris: Press, 1992) and ibid. too", "(Paris: Press, 92)", "principal sources consulted", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = [r.x for r in df.select("i", ref.apparatus("t").alias("x")).orderBy("i").collect()]
    assert got == [None, "11. Move, p. 3", "ibid.", None, "principal sources consulted", None]


def test_printed_contents_keep_the_longer_entry(spark):
    text = "Chapter 1. \nThe Nature\nFriction—Fluidity — x\nChapter 2.\n  Theory \nLevels--of--War"
    rows = [(1, 0, text), (1, 3, "Chapter 1.\nOther\nOne part—Two parts—Three parts"), (1, 30, "Chapter 9.\nLate\nNever read"), (2, 0, None), (2, 1, "no contents")]
    got = lay.printed_contents(spark.createDataFrame(rows, "doc int, page int, text string")).orderBy("chapter").collect()
    assert [(r.chapter, r.title, r.sections) for r in got] == [(1, "Other", ["One part", "Two parts", "Three parts"]), (2, "Theory", ["Levels", "War"])]


def test_page_statistics_ties_and_defaults(spark):
    rows = [(1, 0, i, 10.4, float(y), 9.0 + i, f) for i, (y, f) in enumerate([(0, "A"), (12, "A"), (24, "A"), (200, "B")])] + [(2, 0, 0, 2.5, 1.0, 8.0, "A")]
    got = {r.doc: r for r in lay.page_statistics(spark.createDataFrame(rows, "doc int, page int, line_no int, x double, y double, size double, font string")).collect()}
    assert (got[1].leading, got[1].body_size, got[1].body_font, got[1].margin) == (12.0, 10.5, "A", 10.0)
    assert (got[2].leading, got[2].body_font, got[2].margin) == (12.0, None, 2.0)


def test_headings(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["C0MMAND  AND CONTROL'S", "01 May 2026", "Fire", "12", None])], "i int, t string")
    got = df.select("i", lay.clean_heading("t").alias("h"), lay.heading_noise("t").alias("n")).orderBy("i").collect()
    assert [r.h for r in got] == ["Command And Control'S", "01 May 2026", "Fire", "12", None]
    assert [r.n for r in got] == [False, True, False, True, None]


def test_manifest_and_flags(spark):
    df = spark.createDataFrame([(1, False, True, 0), (0, True, True, 0), (0, False, None, 0), (0, False, True, 2), (0, None, True, 0), (None, None, None, None)], "b int, r boolean, s boolean, p int")
    got = [r.f for r in df.select(mf.screening_flag(F.col("b"), F.col("r"), F.col("s"), F.col("p")).alias("f")).collect()]
    assert got == ["BLOCKED", "BLOCKED", "REVIEW", "CLEAR (with blind spots)", "CLEAR", "REVIEW"]
    assert mf.totals(spark.createDataFrame([], "cleared boolean, pages long")).first().asDict() == {"documents": 0, "blocked": 0, "cleared": 0, "pages": 0}


def test_undone_and_labels_with_nulls(spark):
    s = spark.createDataFrame([("A", None, "x"), ("A", 1, "x"), ("A", 1, None)], "pub_id string, chapter int, section string")
    assert [tuple(r) for r in lr.undone(s, s.where("chapter IS NULL OR section IS NULL")).collect()] == [("A", 1, "x")]
    hits = spark.createDataFrame([(1, "A", " FIRE"), (1, "A", None), (1, "B", "fire"), (2, "A", "fire")], "query_id int, pub_id string, section string")
    labels = spark.createDataFrame([(1, "A", "Fire "), (1, "A", "fire")], "query_id int, pub_id string, section string")
    got = sorted((r.query_id, r.pub_id, r.section or "", r.relevant, r.cited_relevant) for r in ev.label_match(hits, labels).collect())
    assert got == [(1, "A", "", False, True), (1, "A", " FIRE", True, True), (1, "B", "fire", False, False), (2, "A", "fire", False, None)]


def test_best_threshold_outside_the_grid(spark):
    rows = spark.createDataFrame([("in", 9.0), ("in", 2.2), ("out", -9.0), ("out", 1.9), ("in", None)], "kind string, value double")
    assert ev.best_threshold(rows).first().asDict() == {"threshold": 2.0, "false_answers": 0, "over_refusals": 0}
    assert ev.best_threshold(rows.where("kind = 'in'")).count() == 0


def test_gap_report_and_canonical(spark):
    g = spark.createDataFrame([(i, "CORPUS", ["B", "A"]) for i in range(20)] + [(99, "DOCTRINAL", [])], "id int, kind string, missing array<string>")
    got = {r.kind: r for r in rec.gap_report(g).collect()}
    assert got["CORPUS"].n == 20 and got["CORPUS"].first_ids == list(range(12)) and got["CORPUS"].missing == ["A", "B"] and got["DOCTRINAL"].missing == []
    c = rec.canonical(spark.createDataFrame([(1, None, "x")], "b int, a string, c string"), ["c", "b", "a"]).first().canonical
    assert c == '{"a":null,"b":1,"c":"x"}'


def test_tumbling_stream_equals_table(spark, tmp_path):
    e = spark.range(200).select(F.timestamp_seconds(F.col("id") * 97).alias("at"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    e.write.parquet(str(tmp_path / "in"))
    stream = win.tumbling(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "at", "k", "v")
    q = stream.writeStream.format("memory").queryName("tumbling_test").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("tumbling_test")) == key(win.tumbling(e, "at", "k", "v"))


def test_prompts_hold_whole_texts_of_the_hits(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    hits: dict = {}
    for r in QUERIES["hybrid_search"](spark, SF).orderBy("query_id", "rank").collect():
        hits.setdefault(r.query_id, []).append(f"[{r.rank}] {r.source}\n{text[r.doc_id]}")
    got = {r.item_id: r.prompt for r in QUERIES["prompt_from_hits"](spark, SF).collect()}
    assert got.keys() == hits.keys() and all(got[q].startswith("SOURCES:\n\n" + "\n\n".join(h) + "\n\n\nQUESTION: ") for q, h in hits.items())
