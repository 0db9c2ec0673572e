from pyspark.sql import functions as F

from quirework.functions import text as tx
from quirework.operators import grounding as gr
from quirework.operators import specifics as sp
from quirework.operators import verification as vf
from quirework.sources import tables as src


def kinds(text):
    return [(k, raw) for k, raw, _ in sp.specifics(text)]


def test_kinds_by_priority():
    assert kinds("See pages 12-14 of the 1990 3rd edition.") == [("page", "pages 12-14"), ("year", "1990"), ("ordinal", "3rd")]
    assert kinds("The third of twenty-one phases, 007 [4]") == [("ordinal", "third"), ("cardinal", "twenty-one"), ("cardinal", "007")]
    assert kinds("General Alfred M. Gray of the Corps wrote it") == [("proper_noun", "General Alfred M. Gray of the Corps")]
    assert kinds("The Marine Corps") == [] and kinds("NATO") == [] and kinds("") == [] and kinds(None) == []


def test_keys():
    assert [sp.number(w) for w in ("seven", "twenty-one", "one hundred seven", "hundred")] == [7, 21, 107, 100]
    assert sp.digits("007") == "7" and sp.digits("0") == "0" and sp.digits("9" * 5000) == "9" * 5000
    assert sp.specifics("pp. 3-5")[0][2] == ["page:3", "page:5", "page:3-5"]
    assert sp.name_keys("Alfred M. Gray of") == ["alfred m gray", "gray"] and sp.name_keys("Gray") == []


def test_verdict(spark):
    rows = [
        (1, "There are 7 phases.", "How many phases?", ["it has seven phases"]),
        (2, "There are 8 phases.", "How many phases?", ["it has seven phases"]),
        (3, "There are 8 phases.", "What is it?", [None, "seven"]),
        (4, "Alfred Gray said it.", "Who said it?", ["by A. Gray"]),
        (5, "Alfred Grey said it.", "Who said it?", []),
        (6, None, None, None),
        (7, "On page 4.", "Which page?", ["see pp. 3-4"]),
    ]
    df = spark.createDataFrame(rows, "id int, a string, q string, s array<string>")
    got = {r.id: (len(r.v.unsupported), r.v.refuse) for r in df.select("id", sp.specifics_verdict("a", "q", "s").alias("v")).collect()}
    assert got == {1: (0, False), 2: (1, True), 3: (1, False), 4: (0, False), 5: (1, True), 6: (0, False), 7: (0, False)}
    assert [f["kind"] for f in df.where("id = 7").select(sp.extract("a").alias("x")).first().x] == ["page"]


def test_citation_edges(spark):
    words = [f"w{i}" for i in range(30)]
    pages = spark.createDataFrame([("d", 1, 5, " ".join(words[:15])), ("d", 2, 6, " ".join(words[15:])), ("d", 3, 7, None)], "doc string, page int, label int, text string")
    chunks = spark.createDataFrame([(1, "d", 5, " ".join(words)), (2, "d", 6, " ".join(words)), (3, "d", 9, "x"), (4, "d", 5, "w1 w2"), (5, "d", 5, None), (6, "d", 7, "w1")], "id int, doc string, label int, text string")
    got = {r.id: (r.n_probes, r.hits, r.verdict) for r in vf.check(chunks, pages).collect()}
    assert got == {1: (3, 3, "PASS"), 2: (3, 1, "PARTIAL"), 3: (1, 0, "NO_PAGE"), 4: (1, 0, "FAIL"), 5: (0, 0, "PASS"), 6: (1, 0, "FAIL")}


def test_grounding(spark):
    s = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 1, [1.0, 0.0])], "query_id int, sent_no int, vec array<double>")
    c = spark.createDataFrame([(1, 1, [2.0, 0.0]), (1, 2, [3.0, 0.0])], "query_id int, chunk_no int, vec array<double>")
    sup = gr.supports(s, c)
    assert sorted((r.query_id, r.sent_no, r.support, r.best) for r in sup.collect()) == [(1, 1, 1.0, 1), (1, 2, 0.0, 1), (2, 1, 0.0, None)]
    act = lambda **k: {r.query_id: (r.unsupported, r.action) for r in gr.actions(sup, **k).collect()}
    assert act(threshold=0.5) == {1: (1, "mark"), 2: (1, "ungrounded_answer")} and act(threshold=None) == {1: (0, None), 2: (0, None)}
    said = sup.withColumn("sentence", F.concat(F.lit("S"), "sent_no"))
    assert {r.query_id: r.answer for r in gr.rewritten(said, 0.5).collect()} == {1: "S1 S2 [UNSUPPORTED]", 2: "S1 [UNSUPPORTED]"}
    assert {r.query_id: r.answer for r in gr.rewritten(said, 0.5, strip=True).collect()} == {1: "S1", 2: ""}


def test_noisy_items_and_reports(spark):
    rows = [("x {\"question\": \"what is friction in war?\", \"key_points\": [\" a \", \"\"]} y",), ("{broken",), ("{\"question\": \"short\", \"key_points\": [\"a\"]}",), ("{\"question\": \"what is friction in war?\", \"key_points\": []}",), (None,)]
    got = [r.i for r in spark.createDataFrame(rows, "t string").select(tx.item_json("t").alias("i")).collect()]
    assert (got[0].question, got[0].key_points) == ("what is friction in war?", ["a"]) and got[1:] == [None] * 4
    assert src.markdown_table([{"a": 1, "b": None}, {"b": "x|y"}], ["a", "b"]) == "| a | b |\n| --- | --- |\n| 1 | — |\n| — | x\\|y |"
