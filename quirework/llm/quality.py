"""Quality rules by weak supervision, in SQL functions alone.

Each rule votes good or bad or abstains.  What a bad vote is worth is not set by hand: each rule has a bad
class of its own, and expectation-maximisation over the vote patterns of all documents estimates the class's
share against the good documents' and both rates of bad votes.  A document is kept if its posterior
probability of being in any bad class is under one half (and the base rules do not fail it).  An objection
that hardly any document draws counts as a false alarm; how often another rule objects does not matter.

The patterns' table has at most 3 ** rules rows whatever the corpus, so estimation runs in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Name -> (score over the features, bad above, good up to); between the two the rule abstains.
RULES: dict[str, tuple[str, float, float]] = {
    "symbols": ("n_symbols / n_words", 0.10, 0.02),
    "repeats": ("n_repeat_words / n_words", 0.30, 0.15),
    "lines": ("n_dup_lines / n_lines", 0.50, 0.20),
    "capitals": ("n_upper / word_chars", 0.30, 0.15),
    "exclamations": ("n_exclaim / n_words", 0.20, 0.05),
    "digits": ("n_digits / word_chars", 0.30, 0.15),
    "word_length": ("abs(word_chars / n_words - 6.5)", 5.5, 3.5),
}

#: Rates of bad votes for bad and for good documents and the share of bad documents: weight-one priors, then ranges.
START_BAD, START_GOOD, START_SHARE = 0.25, 0.005, 0.15
RANGE_BAD, RANGE_GOOD, RANGE_SHARE = (0.05, 0.95), (0.0005, 0.01), (0.01, 0.5)
ROUNDS = 25
#: First posterior of documents with a bad vote and of the others: from here no kind of bad document starts as good.
FIRST = 0.9, 0.05
#: A good document's rate of bad votes before any is seen, and how many times the good documents that counts: its
#: weight grows with the corpus, so an objection that well under one document in a thousand draws is a false alarm.
PRIOR_GOOD, PRIOR_WEIGHT = 0.0005, 9.0


def _let(value: str, body: str, name: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Words that lie in a 3-word window found twice or more in the text.
_COVERED = "size(array_distinct(flatten(transform(p, i -> array(i, i + 1, i + 2)))))"
_TWICE = "filter(transform(s, (x, k) -> if(get(s, k - 1).h = x.h OR get(s, k + 1).h = x.h, x.i, null)), i -> i IS NOT NULL)"
_SORTED = "sort_array(transform(hs, (h, i) -> named_struct('h', h, 'i', i)))"
_REPEATS = f"if(size(array_distinct(hs)) = size(hs), 0, {_let(_SORTED, _let(_TWICE, _COVERED, 'p'), 's')})"
_WINDOWS = "transform(sequence(2, size(w) - 1), i -> xxhash64(w[i - 2], w[i - 1], w[i]))"
_WORDS = rf"regexp_extract_all(coalesce(`{{text}}`, ''), '{common.WORD}', 0)"
_COUNTS = f"named_struct('n', size(w), 'r', if(size(w) < 4, 0, {_let(_WINDOWS, _REPEATS, 'hs')}))"
_LINES = r"filter(split(coalesce(`{text}`, ''), '\n'), l -> l rlike '[^\x20\x09-\x0D]')"


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the counts that rules look at, of every whole text (null: no words)."""
    sql = lambda s: F.expr(s.replace("\\", "\\\\").replace("{text}", text))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = F.char_length(t)
    first = docs.select(
        *[f"`{c}`" for c in keep],
        sql(_let(_WORDS, _COUNTS, "w")).alias("_words"),
        sql(_let(_LINES, "named_struct('n', size(l), 'd', size(l) - size(array_distinct(l)))", "l")).alias("_lines"),
        _without(t, SPACES).cast("long").alias("word_chars"),
        (size - _without(t, SYMBOLS)).cast("long").alias("n_symbols"),
        (size - _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ")).cast("long").alias("n_upper"),
        (size - _without(t, "!")).cast("long").alias("n_exclaim"),
        (size - _without(t, "0123456789")).cast("long").alias("n_digits"),
    )
    part = lambda c, f, n: F.col(c)[f].cast("long").alias(n)
    return first.select(*[f"`{c}`" for c in keep], part("_words", "n", "n_words"), "word_chars", "n_symbols", part("_lines", "d", "n_dup_lines"), part("_words", "r", "n_repeat_words"), part("_lines", "n", "n_lines"), "n_upper", "n_exclaim", "n_digits")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _safe(score: str) -> str:
    """Null, and so an abstention, where the score has no value."""
    a, b = score.split(" / ")
    below = b.split(" ")[0]
    return f"{a} / nullif({below}, 0){b[len(below):]}"


SCORES = {name: _safe(s) for name, (s, _, _) in RULES.items()}


def vote_sql() -> list[str]:
    """Each rule's vote as SQL over the features."""
    return [f"CASE WHEN {SCORES[n]} > {bad} THEN 2 WHEN {SCORES[n]} <= {good} THEN 1 ELSE 0 END" for n, (_, bad, good) in RULES.items()]


def estimate(feats: DataFrame):
    """Row of odds (of a document in each rule's bad class against good ones), bad and good (rates of bad votes in either), from all rows of ``feats`` that pass the base rules.

    What the base rules fail is decided and left out.  Each rule has a bad class of its own, held against the good
    documents alone, so how often one rule objects says nothing about another's objections.
    """
    m = len(RULES)
    pats = feats.where(~base_failed()).groupBy(F.expr(f"array({', '.join(vote_sql())})").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    row = pats.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("ps"))
    arr = lambda x: f"array_repeat({x}D, {m})"
    clamp = lambda x, r: f"least({r[1]}D, greatest({r[0]}D, {x}))"
    each = f"sequence(0, {m - 1})"
    first = f"transform({each}, j -> if(p.v[j] = 2, {FIRST[0]}D / size(filter(p.v, x -> x = 2)), 0D))"
    odds = f"transform({each}, j -> st.odds[j] * if(p.v[j] = 2, st.bad[j] / st.good[j], (1 - st.bad[j]) / (1 - st.good[j])))"
    shares = _let(odds, "transform(r, x -> x / (1 + aggregate(r, 0D, (a, y) -> a + y)))", "r")
    post = f"transform(ps, p -> {_let(f'if(k = 1, {first}, {shares})', 'struct(q AS q, 1 - aggregate(q, 0D, (a, x) -> a + x) AS ok)', 'q')})"
    total = lambda w: f"aggregate(zip_with(ps, g, (p, e) -> p.n * ({w})), 0D, (a, x) -> a + x)"
    ok = total("e.ok")
    weight = f"(1D + {PRIOR_WEIGHT}D * {ok})"
    class_of = f"transform({each}, j -> {clamp(f'({START_SHARE}D / {m} + {total("e.q[j]")}) / (1D + {ok})', (0.0, 1.0))})"
    bad = f"transform({each}, j -> {clamp(f'({START_BAD}D + {total("if(p.v[j] = 2, e.q[j], 0D)")}) / (1D + {total("e.q[j]")})', RANGE_BAD)})"
    good = f"transform({each}, j -> ({PRIOR_GOOD}D * {weight} + {total('if(p.v[j] = 2, e.ok, 0D)')}) / ({weight} + {ok}))"
    new = f"named_struct('odds', {class_of}, 'bad', {bad}, 'good', {good})"
    em = f"aggregate(sequence(1, {ROUNDS}), named_struct('odds', {arr(START_SHARE)}, 'bad', {arr(START_BAD)}, 'good', {arr(PRIOR_GOOD)}), (st, k) -> {_let(post, new, 'g')})"
    return row.select(F.coalesce("ps", F.array().cast("array<struct<v:array<int>,n:double>>")).alias("ps")).select(F.expr(em).alias("st")).select("st.*").first()


def fit(feats: DataFrame) -> tuple[list[float], list[float]]:
    """(odds of bad by each rule's bad vote, by its other votes)."""
    st = estimate(feats)
    each = list(zip(st.odds, st.bad, st.good, strict=True))
    return [o * b / g for o, b, g in each], [o * (1 - b) / (1 - g) for o, b, g in each]


def report(feats: DataFrame) -> list[dict]:
    """Each rule's fitted class share, rates of bad votes and whether the rate in its bad class stands at an end of its range."""
    st = estimate(feats)
    return [{"rule": n, "share": o / (1 + sum(st.odds)), "bad": b, "good": g, "at_bound": min(abs(b - RANGE_BAD[0]), abs(b - RANGE_BAD[1])) < 1e-9} for n, o, b, g in zip(RULES, st.odds, st.bad, st.good, strict=True)]


def p_bad(model: tuple[list[float], list[float]]) -> Column:
    """Posterior probability that the document with these features is bad in any rule's way."""
    terms = [f"CASE {v} WHEN 2 THEN {b!r}D ELSE {g!r}D END" for v, b, g in zip((f"({v})" for v in vote_sql()), *model, strict=True)]
    return F.expr(f"1 - 1 / (1 + {' + '.join(terms)})")


def judge(feats: DataFrame) -> DataFrame:
    """``feats`` + p_bad, base_failed, kept."""
    return feats.withColumn("p_bad", p_bad(fit(feats))).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("p_bad") < 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The kept documents, all columns as they were.  Null and short texts fail the base rules and go.

    Repeated rows are judged alike; an empty table gives none.  Counts are made once and written beside the rows;
    estimation reads the counts alone.
    """
    sub = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    feats = common.saved(features(sub, ["_row"]), "features")
    model = fit(feats.drop("_row"))
    return feats.where(~base_failed() & (p_bad(model) < 0.5)).select("_row.*")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept, p_bad of every row; null and empty texts have no words and fail.

    Repeated rows are judged alike; an empty table gives none.
    """
    feats = common.saved(features(docs, ["doc_id"]), "features")
    return judge(feats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_bad", 6).alias("p_bad"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.documents(spark, sf_dir)).drop("p_bad")


def _oracle() -> str:
    """The same in DuckDB: counts by lists, expectation-maximisation by a recursive table."""
    m = len(RULES)
    arr = "[" + ", ".join(vote_sql()) + "]"
    js = f"range({m})"
    logit = f"ln(e.share / (1 - e.share)) + list_sum(list_transform({js}, lambda j: CASE p.v[j + 1] WHEN 2 THEN ln(e.bad[j + 1] / e.good[j + 1]) WHEN 1 THEN ln((1 - e.bad[j + 1]) / (1 - e.good[j + 1])) ELSE 0 END))"
    # one aggregate row an iteration: sums over patterns, rule by rule
    sums = lambda w, v: ", ".join(f"sum(CASE WHEN v[{j + 1}] {v} THEN n * ({w}) ELSE 0 END)" for j in range(m))
    rate = lambda w, start, r: f"list_transform(list_zip([{sums(w, '= 2')}], [{sums(w, '> 0')}]), lambda x: least({r[1]}, greatest({r[0]}, ({start} + x[1]) / (1 + x[2]))))"
    return rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS MATERIALIZED (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: [w[i], w[i + 1], w[i + 2]]) AS g FROM w),
u AS (SELECT rowid AS r, unnest(g) AS h, generate_subscripts(g, 1) AS i FROM (SELECT row_number() OVER () AS rowid, g FROM (SELECT doc_id, g FROM l ORDER BY doc_id))),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS k FROM u) WHERE k > 1),
k AS (SELECT r, count(DISTINCT i + j) AS n FROM c, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
f AS MATERIALIZED (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(k.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
  length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ', '')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_exclaim,
  length(t) - length(translate(t, '0123456789', '')) AS n_digits
  FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM l) x LEFT JOIN k USING (r)),
p AS MATERIALIZED (SELECT {arr} AS v, CAST(count(*) AS DOUBLE) AS n FROM f WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) GROUP BY 1),
em AS (
  SELECT 0 AS it, CAST({START_SHARE} AS DOUBLE) AS share, CAST([{', '.join([str(START_BAD)] * m)}] AS DOUBLE[]) AS bad, CAST([{', '.join([str(START_GOOD)] * m)}] AS DOUBLE[]) AS good
  UNION ALL
  SELECT it + 1, least({RANGE_SHARE[1]}, greatest({RANGE_SHARE[0]}, ({START_SHARE} + sum(n * q)) / (1 + sum(n)))), {rate('q', START_BAD, RANGE_BAD)}, {rate('1 - q', START_GOOD, RANGE_GOOD)}
  FROM (SELECT it, n, v, CASE WHEN it > 0 THEN 1 / (1 + exp(-({logit}))) WHEN list_contains(p.v, 2) THEN {FIRST[0]} ELSE {FIRST[1]} END AS q FROM em e, p WHERE it < {ROUNDS}) GROUP BY it)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 1 / (1 + exp(-({logit}))) < 0.5 AS kept
FROM (SELECT *, {arr} AS v FROM f) p, (SELECT * FROM em WHERE it = {ROUNDS}) e
"""


OP6_SQL = _oracle()
