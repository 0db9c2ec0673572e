"""Numbers, ranks and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LADDER = [1, 3, 7, 21, 60]  # fixed: days to the next review after 1, 2, ... correct answers


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def round_exact(x: Column, places: int) -> Column:
    """``x`` to so many places, half to even, as its binary value stands: 2.675 is below the half and gives 2.67.

    Spark's own rounding takes the shortest decimal form for the value.  The product with 10 ** places is
    made exact as a sum of two doubles (Dekker's splitting), and the half is looked for in both.  What rounds to
    zero keeps its sign, as it does in printed form.
    """
    by = float(10**places)
    c = x * F.lit(134217729.0)
    hi = c - (c - x)
    p = x * by
    rest = (hi * by - p) + (x - hi) * by
    low = F.floor(p).cast("double")
    over = (p - low - 0.5) + rest
    up = (over > 0) | ((over == 0) & (F.pmod(low, F.lit(2.0)) == 1.0))
    return F.abs((low + F.when(up, 1.0).otherwise(0.0)) / by) * F.signum(x)


def interval_days(streak: Column, verdict: Column, confidence: Column) -> Column:
    ladder = F.element_at(F.array(*[F.lit(d) for d in LADDER]), F.least(F.greatest(streak, F.lit(1)), F.lit(len(LADDER))).cast("int"))
    unsure = confidence.isNull() | (confidence <= 1)
    return F.when(verdict == "incorrect", F.when(confidence >= 3, 0).otherwise(1)).when(verdict == "partial", 1).when(unsure, F.least(ladder, F.lit(3))).otherwise(ladder).cast("int")


def verdict_score(verdict: Column) -> Column:
    return F.when(verdict == "correct", 1.0).when(verdict == "incorrect", 0.0).otherwise(0.5)


def epoch(text: Column) -> Column:
    """Seconds of a strict yyyy-MM-ddTHH:mm:ssZ text, else 0."""
    strict = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return F.when(strict, F.coalesce(F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))).cast("double"), F.lit(0.0))).otherwise(0.0)


def epoch_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clock_trusted(at: Column) -> Column:
    """A clock before 2020 was never set."""
    return F.coalesce(at > F.lit("2020-01-01").cast("timestamp_ntz"), F.lit(False))


def percent_text(part: Column, whole: Column) -> Column:
    """Share as text with one place, ``n/a`` of nothing."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, "n/a").otherwise(F.format_string("%.1f%%", round_exact(100.0 * part / whole, 1)))
