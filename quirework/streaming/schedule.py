"""Streaming twins: the review schedule as keyed state, and the latest sample per source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.maths import LADDER

OUT = "learner long, item_id int, streak int, due long"


def _days(streak: int, verdict: str, confidence: int | None) -> int:
    if verdict == "incorrect":
        return 0 if confidence is not None and confidence >= 3 else 1
    if verdict == "partial":
        return 1
    d = LADDER[min(max(streak, 1), len(LADDER)) - 1]
    return min(d, 3) if confidence is None or confidence <= 1 else d


def schedule_stream(attempts: DataFrame) -> DataFrame:
    """Attempts (learner, item_id, seq, verdict, confidence, at) to schedule updates; state is (streak, last seq) per key.

    Attempts at or before a key's last seq are repeats and change nothing.  The last update of a key equals
    the batch schedule.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak, last = state.get if state.exists else (0, -1)
        due = None
        rows = pd.concat(list(frames)).sort_values("seq")
        for r in rows.itertuples(index=False):
            if r.seq <= last:
                continue
            streak, last = (streak + 1 if r.verdict == "correct" else 0), int(r.seq)
            due = int(r.at) + 86400 * _days(streak, r.verdict, None if pd.isna(r.confidence) else int(r.confidence))
        if due is not None:
            state.update((streak, last))
            yield pd.DataFrame({"learner": [key[0]], "item_id": [key[1]], "streak": [streak], "due": [due]})

    return attempts.groupBy("learner", "item_id").applyInPandasWithState(update, OUT, "streak int, last long", "update", "NoTimeout")


def latest_samples(samples: DataFrame, source: str, at: str, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Last sample of each source per window; an extension over event time with a watermark."""
    return samples.withWatermark(at, late).groupBy(F.window(at, window), source).agg(F.max_by("value", at).alias("value"), F.max(at).alias("at"))
