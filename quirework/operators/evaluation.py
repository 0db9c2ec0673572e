"""Evaluation and tuning over records (id, kind, expects, top_score, min_support, n_claims, declined, error, pub_id, latency)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths


def would_answer(score_thr: Column, support_thr: Column) -> Column:
    """Replay of the gates; a null threshold is off, a null score fails one that is on."""
    score = score_thr.isNull() | F.coalesce(F.col("top_score") >= score_thr, F.lit(False))
    support = support_thr.isNull() | (F.col("n_claims") == 0) | F.coalesce(F.col("min_support") >= support_thr, F.lit(False))
    return F.col("error").isNull() & ~F.col("declined") & score & support


def _outcomes(n) -> list[Column]:
    """Counts of outcomes; ``n``: (name, condition over kind, expects, answered) -> a counting column."""
    inside, answered, expects = F.col("kind") == "in", F.col("answered"), F.col("expects")
    out = F.col("kind") == "out"
    return [
        n("n_in", inside), n("n_out", out & ~expects), n("n_traps", out & expects),
        n("refused", inside & ~answered), n("false_answers", out & ~expects & answered), n("trap_missed", out & expects & ~answered),
    ]


def _rates(counts: DataFrame) -> DataFrame:
    """+ over_refusal and false_answer: shares of what can be refused or answered wrongly; an empty side gives 0."""
    share = lambda a, n: F.col(a) / F.greatest(n, F.lit(1))
    return counts.withColumn("over_refusal", share("refused", "n_in")).withColumn("false_answer", share("false_answers", "n_out"))


def confusion(records: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of a replay with threshold columns ``score_thr`` and ``support_thr``; records with an error are left out.

    A question outside the corpus is a trap if an answer is expected all the same (``expects``): answering it is
    right, refusing it misses the trap, and it is no part of the false answers.
    """
    replayed = records.where("error IS NULL").withColumn("answered", would_answer(F.col("score_thr"), F.col("support_thr"))).withColumn("expects", F.coalesce("expects", F.lit(False)))
    return _rates(replayed.groupBy(*by).agg(*_outcomes(lambda name, c: F.count_if(c).alias(name))))


def at_ranks(df: DataFrame, value: str, ranks: dict[str, Column]) -> DataFrame:
    """One row: n and the values at 1-based ranks, each a column expression over ``n``.

    Works on counts of distinct values: what is ordered in one place is values, not rows, and no array of all
    values is built.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    cum = v.withColumn("upto", F.sum("k").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(v.agg(F.sum("k").alias("n"))))
    return cum.agg(F.max("n").alias("n"), F.min("v").alias("least"), *[F.min(F.when(F.col("upto") >= r, F.col("v"))).alias(name) for name, r in ranks.items()])


def nearest_ranks(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """sorted[min(n - 1, int(share * n))] for each share."""
    n = F.col("n")
    got = at_ranks(df, value, {name: F.least(n, F.floor(F.lit(s) * n) + 1) for name, s in shares.items()})
    return got.select("n", *shares)


def quantile_grid(records: DataFrame, value: str, n: int = 20, below: bool = True, places: int = 2) -> DataFrame:
    """Threshold grid (grid_no, value): off, with ``below`` one under all values, then n - 1 exclusive quantiles, which extrapolate past the ends."""
    m = F.col("n") + 1
    j = lambda i: F.greatest(F.lit(1), F.least(F.floor(i * m / n), F.col("n") - 1))
    ranks = {f"{side}{i}": j(i) + int(side == "b") for i in range(1, n) for side in "ab"}
    row = at_ranks(records, value, ranks)
    delta = lambda i: i * m - j(i) * n
    cuts = [(F.col(f"a{i}") * (n - delta(i)) + F.col(f"b{i}") * delta(i)) / n for i in range(1, n)]
    first = [F.lit(None).cast("double"), *([F.col("least") - 1] if below else [])]
    points = row.select(F.concat(F.array(*first), F.when(F.col("n") > 1, F.array(*cuts)).otherwise(F.array().cast("array<double>"))).alias("p"))
    return points.select(F.posexplode("p").alias("grid_no", value)).withColumn(value, maths.round_exact(F.col(value), places))


def sweep(records: DataFrame, scores: DataFrame, supports: DataFrame) -> DataFrame:
    """Every pair of thresholds (g1, score_thr, g2, support_thr) judged in one pass over the records.

    A record passes a threshold or not, and thresholds that it passes are the lowest ones: so it falls in one of few
    cells (how many of each grid it passes), counted before the shuffle, and the grid is judged on cells.  The two
    grids (ascending, off first) are some forty numbers and come to the driver.
    """
    s, u = ([r[0] for r in g.orderBy("grid_no").select(v).collect()] for g, v in ((scores, "top_score"), (supports, "min_support")))
    array = lambda xs: F.array(*[F.lit(x) for x in xs if x is not None]).cast("array<double>")
    passes = lambda v, xs: F.size(F.filter(array(xs), lambda t: F.coalesce(F.col(v) >= t, F.lit(False))))
    ok = records.where("error IS NULL")
    spot = ok.select("kind", F.coalesce("expects", F.lit(False)).alias("expects"), "declined", passes("top_score", s).alias("s"), F.when(F.col("n_claims") == 0, F.size(array(u))).otherwise(passes("min_support", u)).alias("u"))
    cells = spot.groupBy("kind", "expects", "declined", "s", "u").agg(F.count(F.lit(1)).alias("n"))
    points = lambda xs, g, t, need: F.array(*[F.struct(F.lit(i).alias(g), F.lit(x).cast("double").alias(t), F.lit(sum(y is not None for y in xs[: i + 1]) if x is not None else 0).alias(need)) for i, x in enumerate(xs)])
    judged = cells.select("*", F.inline(points(s, "g1", "score_thr", "need_s"))).select("*", F.inline(points(u, "g2", "support_thr", "need_u")))
    judged = judged.withColumn("answered", ~F.col("declined") & (F.col("s") >= F.col("need_s")) & (F.col("u") >= F.col("need_u")))
    return _rates(judged.groupBy("g1", "score_thr", "g2", "support_thr").agg(*_outcomes(lambda name, c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name))))


def distribution(records: DataFrame, offs: DataFrame | None = None, kind: str = "in", by: str = "pub_id") -> DataFrame:
    """Each group's number of records of one kind, lowest, middle and highest score, its offset (0 without one) and the middle after it."""
    g = records.where(f"error IS NULL AND top_score IS NOT NULL AND {by} IS NOT NULL").where(F.col("kind") == kind).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("top_score").alias("lo"), F.median("top_score").alias("m"), F.max("top_score").alias("hi"))
    g = g.withColumn("offset", F.lit(0.0)) if offs is None else g.join(offs.select(by, F.col("offset").alias("_o")), by, "left").withColumn("offset", F.coalesce("_o", F.lit(0.0)))
    two = lambda c: maths.round_exact(c, 2)
    return g.select(by, "n", two(F.col("lo")).alias("lo"), two(F.col("m")).alias("mid"), two(F.col("hi")).alias("hi"), "offset", two(F.col("m") + F.col("offset")).alias("mid_after"))


def offsets(records: DataFrame, least: int, share: float = 0.5, by: str = "pub_id", reference: str = "median") -> DataFrame:
    """pub, n, location, offset that moves each location (the ``share`` percentile) to the median, mean or max of all; groups under ``least`` are skipped."""
    loc = records.where(f"error IS NULL AND kind = 'in' AND top_score IS NOT NULL AND {by} IS NOT NULL").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile("top_score", F.lit(share)).alias("loc"))
    middle = {"median": F.median, "mean": F.avg, "max": F.max}[reference]
    ref = loc.where(F.col("n") >= least).agg(middle("loc").alias("ref"))
    ok = F.col("n") >= least
    return loc.crossJoin(F.broadcast(ref)).select(by, "n", F.round("loc", 6).alias("location"), F.when(ok, maths.round_exact(F.col("ref") - F.col("loc"), 3)).alias("offset"), (~ok).alias("skipped"))


def calibrated(records: DataFrame, offs: DataFrame, by: str = "pub_id") -> DataFrame:
    """A group without an offset keeps its score; a null score stays null."""
    return records.join(offs.select(by, "offset"), by, "left").withColumn("effective", F.col("top_score") + F.coalesce("offset", F.lit(0.0)))


def rescue_curve(refused: DataFrame) -> DataFrame:
    """threshold, fixed, broken: refused in-corpus rows that a rescue at this value would answer, and rightly refused rows it would break.

    ``refused``: kind, expects, value.  Traps (out, an answer expected) are neither, but their values are thresholds too.
    Counts per value first, then one cumulative window over the distinct values.
    """
    trap = (F.col("kind") == "out") & F.coalesce("expects", F.lit(False))
    per = refused.where("value IS NOT NULL").groupBy(maths.round_exact(F.col("value"), 3).alias("threshold"), "value").agg(F.count_if(F.col("kind") == "in").alias("i"), F.count_if((F.col("kind") == "out") & ~trap).alias("o"))
    # a value counts for every threshold that it reaches, and rounding can put its own threshold above it
    t, w = per.select("threshold").distinct(), Window.orderBy(F.desc("at"), F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)
    marks = per.select(F.col("value").alias("at"), F.lit(1).alias("mark"), "i", "o").unionByName(t.select(F.col("threshold").alias("at"), F.lit(0).alias("mark"), F.lit(0).alias("i"), F.lit(0).alias("o")))
    summed = marks.groupBy("at", "mark").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return summed.select("at", "mark", F.sum("i").over(w).alias("fixed"), F.sum("o").over(w).alias("broken")).where("mark = 0").select(F.col("at").alias("threshold"), "fixed", "broken")


def best_rescue(curve: DataFrame) -> DataFrame:
    """The threshold that breaks nothing and fixes most (ties: the lowest); no row if nothing can be fixed for free."""
    return curve.where("broken = 0 AND fixed > 0").orderBy(F.desc("fixed"), "threshold").limit(1)


def answer_metrics(rows: DataFrame) -> DataFrame:
    """One row of counts over answered questions: kind (in, out), expects_answer, abstained, cited_relevant (null: not scored), has_citation.

    over_refusal of in; false_answer of out that expects none; traps_kept of out that expects an answer.
    """
    inside, answered = F.col("kind") == "in", ~F.col("abstained")
    expects = F.coalesce("expects_answer", F.lit(False))
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.agg(
        n(inside, "n_in"), n(inside & ~answered, "over_refusal"), n(~inside & ~expects, "n_out"), n(~inside & ~expects & answered, "false_answer"),
        n(~inside & expects, "n_traps"), n(~inside & expects & answered, "traps_kept"), n(inside & answered & F.col("cited_relevant").isNotNull(), "cite_scored"),
        n(inside & answered & F.col("cited_relevant"), "cite_correct"), n(inside & answered & F.col("has_citation"), "with_citation"),
    )


def best_point(swept: DataFrame) -> DataFrame:
    """The pair of thresholds with the least sum of both rates, then fewest traps missed, then first in the grid."""
    return swept.withColumn("total", F.col("false_answer") + F.col("over_refusal")).orderBy("total", "trap_missed", "g1", "g2").limit(1)


def signal_ranges(rows: DataFrame) -> DataFrame:
    """Least, middle and highest value by kind."""
    return rows.where("value IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 6).alias("lo"), F.round(F.median("value"), 6).alias("mid"), F.round(F.max("value"), 6).alias("hi"))


def best_threshold(rows: DataFrame, lo: float = -8.0, hi: float = 8.0, step: float = 0.5) -> DataFrame:
    """threshold, false_answers, over_refusals: the least sum of both shares over lo, lo + step .. hi (ties: the lowest).

    Rows are counted by the last threshold that they reach, so the grid is judged on a few dozen counts.
    """
    reach = F.greatest(F.lit(lo - step), F.least(F.lit(hi), F.floor(F.col("value") / step) * step))
    per = rows.where("value IS NOT NULL").groupBy(reach.alias("r")).agg(F.count_if(F.col("kind") == "in").alias("i"), F.count_if(F.col("kind") == "out").alias("o"))
    packed = per.agg(F.collect_list(F.struct("r", "i", "o")).alias("c"), F.sum("i").alias("n_in"), F.sum("o").alias("n_out")).where("n_in > 0 AND n_out > 0")
    steps = round((hi - lo) / step)
    grid = packed.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.lit(lo) + k * F.lit(step))).alias("threshold"))
    above = lambda f: F.aggregate(F.filter("c", lambda x: x["r"] >= F.col("threshold")), F.lit(0).cast("long"), lambda a, x: a + x[f])
    judged = grid.select("threshold", above("o").alias("false_answers"), (F.col("n_in") - above("i")).alias("over_refusals"), "n_in", "n_out")
    return judged.orderBy(F.round(F.col("false_answers") / F.col("n_out") + F.col("over_refusals") / F.col("n_in"), 9), "threshold").limit(1).drop("n_in", "n_out")


def label_match(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """``hits`` (query_id, pub_id, section, …) + relevant (publication and section, by letters alone) + cited_relevant (publication; null without labels)."""
    key = F.lower(F.trim("section"))
    both = labels.select("query_id", "pub_id", key.alias("_s"), F.lit(True).alias("_both")).distinct()
    pubs = labels.select("query_id", "pub_id", F.lit(True).alias("_pub")).distinct()
    known = labels.select("query_id", F.lit(True).alias("_known")).distinct()
    met = hits.withColumn("_s", key).join(both, ["query_id", "pub_id", "_s"], "left").join(pubs, ["query_id", "pub_id"], "left").join(known, "query_id", "left")
    return met.select(*hits.columns, F.coalesce("_both", F.lit(False)).alias("relevant"), F.when(F.col("_known"), F.coalesce("_pub", F.lit(False))).alias("cited_relevant"))


def scored_questions(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions that retrieval is scored on, ids that are skipped): marked for it and with at least one label."""
    ok = F.coalesce("score_retrieval", F.lit(False)) & (F.coalesce(F.size("labels"), F.lit(0)) > 0)
    return questions.where(ok), questions.where(~ok).select("query_id")


def probes(questions: DataFrame, decisions: DataFrame, signals: DataFrame) -> DataFrame:
    """id, kind, expects, abstained, value of questions that an earlier run decided (others are left out), with their best lexical signal or null."""
    met = questions.join(decisions.select("id", "abstained"), "id").join(signals.groupBy("id").agg(F.max("bm25").alias("value")), "id", "left")
    trap = (F.col("kind") == "out") & F.coalesce("expects", F.lit(False))
    return met.select("id", "kind", trap.alias("expects"), F.coalesce("abstained", F.lit(False)).alias("abstained"), "value")


def bag(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """Questions of both sets with their kind."""
    return inside.withColumn("kind", F.lit("in")).unionByName(outside.withColumn("kind", F.lit("out")))
