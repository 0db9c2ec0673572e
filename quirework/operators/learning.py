"""The learning loop over attempts (learner, item_id, seq, verdict, confidence, score, at): schedule, queue, progress, calibration, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths
from ..functions import text as tx
from .references import apparatus

KEY = ["learner", "item_id"]


def latest(attempts: DataFrame, value: str = "score", keys: list[str] = KEY) -> DataFrame:
    """Last value per key by (seq, value): an aggregate, so partial results combine before the shuffle."""
    return attempts.groupBy(*keys).agg(F.max_by(value, F.struct("seq", value)).alias(value), F.count(F.lit(1)).alias("attempts"))


def schedule(attempts: DataFrame) -> DataFrame:
    """learner, item_id, streak, due (epoch seconds) after the last attempt.

    The streak is how many correct answers end the history: attempts after the last one that was not correct.
    """
    last_miss = attempts.groupBy(*KEY).agg(F.max(F.when(F.col("verdict") != "correct", F.col("seq"))).alias("miss"), F.max(F.struct("seq", "verdict", "confidence", "at")).alias("last"))
    runs = attempts.join(last_miss, KEY).groupBy(*KEY).agg(F.sum(((F.col("verdict") == "correct") & (F.col("miss").isNull() | (F.col("seq") > F.col("miss")))).cast("int")).alias("streak"), F.first("last").alias("last"))
    days = maths.interval_days(F.col("streak"), F.col("last.verdict"), F.col("last.confidence"))
    return runs.select(*KEY, F.col("streak").cast("int").alias("streak"), (F.col("last.at") + days * 86400).cast("bigint").alias("due"))


def due_counts(sched: DataFrame, items: DataFrame, now: int) -> DataFrame:
    """learner, due, scheduled, unseen, next_due."""
    n = items.select("item_id").distinct().agg(F.count(F.lit(1)).alias("n_items"))
    per = sched.join(items.select("item_id").distinct(), "item_id", "left_semi").groupBy("learner").agg(F.count_if(F.col("due") <= now).alias("due"), F.count_if(F.col("due") > now).alias("scheduled"), F.count(F.lit(1)).alias("seen"), F.min(F.when(F.col("due") > now, F.col("due"))).alias("next_due"))
    return per.crossJoin(F.broadcast(n)).select("learner", "due", "scheduled", (F.col("n_items") - F.col("seen")).alias("unseen"), "next_due")


def next_item(sched: DataFrame, items: DataFrame, last_served: DataFrame, now: int) -> DataFrame:
    """learner, item_id, tier: the most overdue item, else the first unseen in track order, else the weakest; never the last served.

    Unseen items are looked for only for learners without anything overdue, and of these only as far as two of
    them can lie: a learner with n seen items has two unseen ones among the first n + 2 of the track.
    """
    learners = sched.select("learner").distinct()
    last = last_served.select("learner", F.col("item_id").alias("_last"))
    seen = sched.join(items, "item_id").select("learner", "item_id", "pos", "streak", "due").join(last, "learner", "left").where(F.col("_last").isNull() | (F.col("_last") != F.col("item_id"))).drop("_last")
    overdue = seen.where(F.col("due") <= now).select("learner").distinct()
    open_ = learners.join(overdue, "learner", "left_anti").join(sched.groupBy("learner").agg(F.count(F.lit(1)).alias("_n")), "learner")
    track = items.select("pos", "item_id").withColumn("_at", F.row_number().over(Window.orderBy("pos", "item_id")))  # one row an item of the bank
    near = open_.withColumn("_at", F.explode(F.sequence(F.lit(1), (F.col("_n") + 2).cast("int")))).join(track, "_at").select("learner", "pos", "item_id")
    fresh = near.join(sched.select("learner", "item_id"), ["learner", "item_id"], "left_anti").join(last, "learner", "left").where(F.col("_last").isNull() | (F.col("_last") != F.col("item_id")))
    first = fresh.groupBy("learner").agg(F.min(F.struct("pos", "item_id")).alias("x")).select("learner", F.col("x.item_id").alias("item_id"), F.col("x.pos").alias("pos"), F.lit(None).cast("int").alias("streak"), F.lit(None).cast("bigint").alias("due"))
    pool = seen.unionByName(first).withColumn("tier", F.when(F.col("due").isNull(), 2).when(F.col("due") <= now, 1).otherwise(3))
    best = F.struct("tier", F.when(F.col("tier") == 1, F.col("due")).alias("d1"), F.when(F.col("tier") == 3, F.col("streak")).alias("s3"), F.when(F.col("tier") == 3, F.col("due")).alias("d3"), "pos", "item_id")
    return pool.groupBy("learner").agg(F.min(best).alias("b")).select("learner", F.col("b.item_id").alias("item_id"), F.col("b.tier").alias("tier"))


def _servable(track: DataFrame, servable: DataFrame | None) -> DataFrame:
    """The track's items (pub_id, section, item_id, …) that may be served; all of them where no list of such items is given."""
    return track if servable is None else track.join(servable.select("item_id").distinct(), "item_id", "left_semi")


def progress(scores: DataFrame, track: DataFrame, servable: DataFrame | None = None) -> DataFrame:
    """learner, pub_id, section, n_items, attempted, mastered, state: every section with servable items for every learner of ``scores`` (latest scores).

    state: mastered (all items), shaky (some attempt) or new (none).  A row a learner and section is the result
    itself; what is done is counted by key before it meets the sections.
    """
    own = _servable(track, servable)
    sections = own.groupBy("pub_id", "section").agg(F.count(F.lit(1)).alias("n_items"))
    done = scores.join(own, "item_id").groupBy("learner", "pub_id", "section").agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("score") >= 1.0).alias("m"))
    every = scores.select("learner").distinct().crossJoin(sections)
    zero = lambda c: F.coalesce(c, F.lit(0))
    met = every.join(done, ["learner", "pub_id", "section"], "left").select("learner", "pub_id", "section", "n_items", zero("a").alias("attempted"), zero("m").alias("mastered"))
    return met.withColumn("state", F.when(F.col("mastered") == F.col("n_items"), "mastered").when(F.col("attempted") > 0, "shaky").otherwise("new"))


def rolled_up(sections: DataFrame, by: list[str]) -> DataFrame:
    """Items, attempts, mastered items and the share attempted of :func:`progress` rows by ``by``: (learner, pub_id), or learner for the whole track."""
    g = sections.groupBy(*by).agg(F.sum("n_items").alias("n_items"), F.sum("attempted").alias("attempted"), F.sum("mastered").alias("mastered"))
    return g.withColumn("pct", F.bround(100.0 * F.col("attempted") / F.col("n_items")).cast("int"))


def class_overview(scores: DataFrame, track: DataFrame, servable: DataFrame | None = None, least_learners: int = 0) -> DataFrame:
    """Per section, over all learners: items, latest scores, mastered ones, share.  No learner leaves; small cells can be held back.

    Sections that nobody attempted stay, with zeros.
    """
    own = _servable(track, servable)
    per = scores.groupBy("item_id").agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("score") >= 1.0).alias("m"))
    sections = own.join(per, "item_id", "left").groupBy("pub_id", "section").agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum("a"), F.lit(0)).alias("attempts"), F.coalesce(F.sum("m"), F.lit(0)).alias("mastered"))
    out = _mastery(sections)
    if least_learners:
        who = scores.join(own, "item_id").groupBy("pub_id", "section").agg(F.countDistinct("learner").alias("_l"))
        out = out.join(who, ["pub_id", "section"], "left").where(F.coalesce("_l", F.lit(0)) >= least_learners).drop("_l")
    return out


def _mastery(counts: DataFrame) -> DataFrame:
    return counts.withColumn("pct", F.when(F.col("attempts") == 0, 0).otherwise(F.bround(100.0 * F.col("mastered") / F.col("attempts"))).cast("int"))


def class_totals(scores: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: learners (a count), and the sums of :func:`class_overview`."""
    n = scores.agg(F.count_distinct("learner").alias("n_learners"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return _mastery(n.crossJoin(F.broadcast(sections.agg(zero("n_items"), zero("attempts"), zero("mastered")))))


def calibration(attempts: DataFrame) -> DataFrame:
    """learner, confidence, n, stated, actual, gap: each learner's stated against actual success by confidence 1 to 4."""
    g = attempts.where("confidence IS NOT NULL").groupBy("learner", "confidence").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("a"))
    stated = (F.col("confidence") - 1) / 3
    three = lambda c: maths.round_exact(c, 3)
    return g.select("learner", "confidence", "n", three(stated).alias("stated"), three(F.col("a")).alias("actual"), three(F.col("a") - stated).alias("gap"))


def overconfidence(buckets: DataFrame, least_gap: float = -0.15) -> DataFrame:
    """learner, n, overconfident_share (of attempts in buckets of :func:`calibration` below ``least_gap``), worst_confidence (lowest gap, then lowest confidence)."""
    g = buckets.groupBy("learner").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("gap") < least_gap, F.col("n"))), F.lit(0)).alias("o"), F.min(F.struct("gap", "confidence")).alias("w"))
    return g.select("learner", "n", maths.round_exact(F.col("o") / F.col("n"), 3).alias("overconfident_share"), F.col("w.confidence").alias("worst_confidence"))


def history(attempts: DataFrame, items: DataFrame, reviews: DataFrame, n: int) -> DataFrame:
    """Each learner's last ``n`` attempts with the item's question as a reviewer edited it; unknown items keep null."""
    recent = attempts.withColumn("r", F.row_number().over(Window.partitionBy("learner").orderBy(F.desc("seq")))).where(F.col("r") <= n)
    return recent.join(edited(items, reviews), "item_id", "left")


def edited(items: DataFrame, reviews: DataFrame) -> DataFrame:
    e = reviews.select("item_id", F.nullif("edited_question", F.lit("")).alias("_q"))
    return items.join(e, "item_id", "left").withColumn("question", F.coalesce("_q", "question")).drop("_q")


def review_stats(reviews: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    n = reviews.agg(F.count(F.lit(1)).alias("total"), one("pending"), one("approved"), one("rejected"))
    return n.withColumn("reviewed_pct", F.when(F.col("total") == 0, 0).otherwise(F.bround(100.0 * (F.col("total") - F.col("pending")) / F.col("total"))).cast("int"))


def severity(flags: Column) -> Column:
    """2 for an ungrounded key point, 1 for any flag, else 0; never checked (null) is 0."""
    return F.when(F.array_contains(flags, "UNGROUNDED_KEY_POINT"), 2).when(F.size(flags) > 0, 1).otherwise(0)


def bulk_decision(flags: Column) -> Column:
    """Never checked is not checked clean."""
    return F.when(flags.isNull(), "unchecked").when(F.size(flags) == 0, "approve").otherwise("flagged")


#: Fixed value: verbs that make an instruction without a question mark.
IMPERATIVE = r"(?i)^\s*(describe|explain|list|name|identify|state|define|compare|contrast|summari[sz]e|outline|discuss|give|provide|distinguish)"


def shape_flags(question: Column, points: Column) -> Column:
    q = F.coalesce(question, F.lit(""))
    imperative = q.rlike(IMPERATIVE)
    once = lambda x, use: F.transform(F.array(x), use)[0]  # noqa: E731  every text is cut into tokens once
    each = lambda asked, own: F.struct((tx.overlap(asked, own) >= 0.60).alias("leaked"), (F.size(own) < 2).alias("thin"))
    judged = once(tx.content_tokens(q), lambda asked: F.transform(points, lambda p: once(tx.content_tokens(p), lambda own: each(asked, own))))
    shape = lambda js: (F.length(F.trim(q)) < 25) | (~q.contains("?") & ~imperative) | (F.size(points) == 0) | F.exists(js, lambda j: j["thin"])
    return once(judged, lambda js: F.array_compact(F.array(F.when(shape(js), F.lit("SHAPE")), F.when(F.exists(js, lambda j: j["leaked"]), F.lit("ANSWER_LEAKED")))))


def _found(points: Column, claims: Column) -> Column:
    """One boolean a point: some claim has at least half of its tokens.  Every text is cut into tokens once."""
    has = lambda own, theirs: F.exists(theirs, lambda t: tx.overlap(t, own) >= 0.5)
    each = lambda p, theirs: F.transform(F.array(tx.grading_tokens(p)), lambda own: has(own, theirs))[0]
    return F.transform(F.array(F.transform(claims, tx.grading_tokens)), lambda theirs: F.transform(points, lambda p: each(p, theirs)))[0]


def reconcile_missed(points: Column, missed: Column, verdict: Column) -> Column:
    """struct<covered, missed>: all of a key point's text is in one of them, by the grader's ``missed`` list and verdict.

    What was not called missed is credited; nothing missed and a verdict other than ``correct`` is all missed.
    """
    none = F.array().cast("array<string>")
    called = F.coalesce(F.transform(F.arrays_zip(points.alias("p"), _found(points, F.coalesce(missed, none)).alias("hit")), lambda x: F.when(x["hit"], x["p"])), none)
    called = F.filter(called, lambda p: p.isNotNull())
    of = lambda c: F.when((F.size(c) == 0) & ~verdict.eqNullSafe(F.lit("correct")), points).otherwise(F.filter(points, lambda p: F.array_contains(c, p)))
    split = lambda m: F.struct(F.filter(points, lambda p: ~F.array_contains(m, p)).alias("covered"), m.alias("missed"))
    return F.transform(F.transform(F.array(called), of), split)[0]


def teachable(chunks: DataFrame, least_chars: int, least_chunks: int = 2) -> DataFrame:
    """Sections with enough chunks of which one is long, without front matter or un-chaptered parts of chaptered publications."""
    g = chunks.where("section IS NOT NULL").groupBy("pub_id", "chapter", "section").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("n_chars") >= least_chars).cast("int")).alias("big"), F.min("id").alias("ord"))
    g = g.where((F.col("n") >= least_chunks) & (F.col("big") >= 1) & ~F.col("section").rlike(tx.JUNK_SECTION))
    numbered = chunks.groupBy("pub_id").agg(F.max(F.col("chapter").isNotNull().cast("int")).alias("numbered"))
    return g.join(numbered, "pub_id").where("chapter IS NOT NULL OR numbered = 0").drop("numbered")


def longest(chunks: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("pub_id", "chapter", "section").orderBy(F.desc("n_chars"), "id")
    return chunks.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)


def precheck(question: Column, points: Column, source: Column) -> Column:
    """Flags of a new item: its shape, an answer that it gives away, a source that is reference apparatus."""
    flags = shape_flags(question, F.coalesce(points, F.array().cast("array<string>")))
    return F.concat(flags, F.array_compact(F.array(F.when(apparatus(source).isNotNull(), F.lit("SOURCE_NOT_TEACHABLE")))))


def undone(sections: DataFrame, done: DataFrame, keys: list[str] = ("pub_id", "chapter", "section")) -> DataFrame:
    """Sections that a run which goes on has still to do; a null chapter equals a null chapter."""
    s, d = sections.alias("s"), done.alias("d")
    return s.join(d, [F.col(f"s.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys], "left_anti")


def served(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """What a learner sees of the approved items: no source, no key points, and the edited question where there is one."""
    approved = reviews.where("status = 'approved'").select("item_id", F.nullif("edited_question", F.lit("")).alias("_q"))
    return items.join(approved, "item_id").select("pub_id", "section", "item_id", F.coalesce("_q", "question").alias("question"))
