"""Findings of a review, each with a case that failed before."""

from pyspark.sql import functions as F

from quirework.functions import maths
from quirework.operators import lexical as lx
from quirework.operators import retrieval as rt


def test_rounding_keeps_the_sign_of_zero(spark):
    values = [-0.004, -0.0, 0.0, 0.004, -0.005, -0.006, 0.125, -0.125, -2.675, 2.675]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r.t for r in df.select("i", maths.round_exact(F.col("x"), 2).cast("string").alias("t")).orderBy("i").collect()]
    assert got == [str(round(v, 2)) for v in values]


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_lexical_search_exchanges_best_rows_alone(spark):
    docs = spark.createDataFrame([(i, f"red fox {i} runs" if i % 3 else "blue fox") for i in range(60)], "d long, text string")
    found = lx.bm25(lx.build(docs, "d"), spark.createDataFrame([(1, "blue fox"), (2, "red fox 7")], "q long, text string"), 3, "q")
    assert _exchanges(found) == 1
    assert [(r.query_id, r.d) for r in found.orderBy("query_id", "rank").collect()] == [(1, 0), (1, 3), (1, 6), (2, 7), (2, 1), (2, 2)]


def test_word_overlap_exchanges_best_rows_alone_and_a_repeated_key_counts_a_term_once(spark):
    docs = spark.createDataFrame([(1, "red fox"), (1, "red dog"), (2, "red"), (3, None), (4, "cat")], "d long, text string")
    asked = spark.createDataFrame([(9, "red fox dog"), (8, "cat a")], "q long, text string")
    found = rt.overlap_list(docs, asked, 5, "d", "q")
    assert sorted((r.query_id, r.d, r.score, r["rank"]) for r in found.collect()) == [(8, 4, 1.0, 1), (9, 1, 1.0, 1), (9, 2, 0.333333, 2)]


def test_several_passes_over_the_queries_give_what_one_gives(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"red fox {i % 7} runs {i % 3}") for i in range(50)], "d long, text string")
    asked = spark.createDataFrame([(i, f"fox {i % 7} runs") for i in range(9)], "q long, text string")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    index = lx.build(docs, "d")
    once = got(lx.bm25(index, asked, 4, "q")), got(rt.overlap_list(docs, asked, 4, "d", "q"))
    monkeypatch.setattr(rt.passes, "__defaults__", (2,))
    assert once == (got(lx.bm25(index, asked, 4, "q")), got(rt.overlap_list(docs, asked, 4, "d", "q")))


def test_joining_lines_is_linear_and_equals_joining_them_one_by_one(spark):
    import random
    import re
    import time

    from quirework.functions import text as tx

    def plain(lines):
        out = ""
        for x in lines:
            out = x if out == "" else re.sub("-$", "", out) + x if re.search(r"(^|[^-])-$", out) and x[:1].islower() else f"{out} {x}"
        return out

    rng = random.Random(5)
    cases = [[rng.choice(["", "-", "--", "wo-", "rd", "Rd", "a -", " ", "\u00e9t-"]) for _ in range(rng.randrange(0, 7))] for _ in range(500)] + [["wo-", "rd " * 10] * 15_000]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, ls array<string>")
    began = time.time()
    got = {r.i: r.t for r in df.select("i", tx.dehyphenated(F.col("ls")).alias("t")).collect()}
    assert got == {i: plain(c) for i, c in enumerate(cases[:-1])} | {500: ("wo" + "rd " * 10 + " ") * 14_999 + "wo" + "rd " * 10}
    assert time.time() - began < 15


def test_item_shape_cuts_each_text_once(spark):
    from quirework.operators import learning as lr

    rows = [(1, "Explain the fox and its den today", ["fox den", "x"]), (2, "What does the quick fox see here?", ["hounds running home"]), (3, None, []), (4, "Which fox is it that runs there?", ["fox runs"])]
    df = spark.createDataFrame(rows, "i int, q string, p array<string>").select("i", lr.shape_flags(F.col("q"), F.col("p")).alias("f"))
    assert {r.i: r.f for r in df.collect()} == {1: ["SHAPE", "ANSWER_LEAKED"], 2: [], 3: ["SHAPE"], 4: ["ANSWER_LEAKED"]}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
