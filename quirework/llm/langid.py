"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (n = 1, 2, 3; words in lower case, with a mark at
both ends) in falling frequency, ties by code points.  A document's profile is compared to each language's:
each of its n-grams costs the difference of its two ranks, or the profile's length where the language does
not have it; the language with the least sum wins (ties: the smaller name).

An n-gram is one integer of three code points, so counting is sorting integers; no n-gram string is made.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MARK = ord("_")
SIZE = 300
_alpha: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Table over code points: letter or not."""
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _alpha


def grams(text: str | None) -> np.ndarray:
    """All n-grams of a text as integers, with repeats; empty if it has no letter."""
    if not text:
        return np.zeros(0, np.int64)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[cp]
    if not letter.any():
        return np.zeros(0, np.int64)
    # each run of non-letters becomes one mark; one mark at either end
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    s = np.where(letter, cp, MARK)[keep].astype(np.int64)
    s = np.concatenate([[MARK], s] if s[-1] == MARK else [[MARK], s, [MARK]])
    if not letter[0] and len(s) > 1 and s[1] == MARK:
        s = s[1:]
    word = s != MARK
    one = s[word] << 42
    two = (s[:-1] << 42) | (s[1:] << 21)
    three = (s[:-2] << 42) | (s[1:-1] << 21) | s[2:]
    return np.concatenate([one, two, three[word[1:-1]]])


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes (ties: the smaller code) in order; ``codes`` ascending."""
    if len(codes) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    """Each learned n-gram's languages and ranks, ready for lookups: entries ``starts[i]`` to ``starts[i + 1]`` are those of ``codes[i]``.

    There are ``size`` entries a language, whatever the corpus.
    """

    size: int
    languages: list[str]
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ranks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def build(cls, lists: dict[str, list[int]], size: int) -> Profiles:
        """From each language's n-grams in falling frequency."""
        langs = sorted(lists)
        grams_, of, ranks = (np.array([x for j, name in enumerate(langs) for x in pick(j, lists[name])], np.int64) for pick in (lambda j, g: g, lambda j, g: [j] * len(g), lambda j, g: range(len(g))))
        order = np.argsort(grams_, kind="stable")
        codes, counts = np.unique(grams_, return_counts=True)
        return cls(size, langs, codes, np.concatenate([[0], np.cumsum(counts)]), of[order], ranks[order])

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of the ranked n-grams ``own`` to each language."""
        total = np.full(len(self.languages), self.size * len(own), np.int64)
        at = np.minimum(np.searchsorted(self.codes, own), max(len(self.codes) - 1, 0))
        here = np.flatnonzero(self.codes[at] == own) if len(self.codes) else np.zeros(0, np.int64)
        first, n = self.starts[at[here]], self.starts[at[here] + 1] - self.starts[at[here]]
        entry = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(here) else here
        saved = self.size - np.abs(self.ranks[entry] - np.repeat(here, n))
        return total - np.bincount(self.of[entry], saved, len(self.languages)).astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language or ``und``, 1 - distance / largest possible distance)."""
        own = top(*np.unique(grams(text), return_counts=True), self.size)
        if not len(own) or not self.languages:
            return "und", 0.0
        d = self.distances(own)
        best = int(np.argmin(d))
        return self.languages[best], 1.0 - float(d[best]) / (self.size * len(own))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 3, is 1 (false for a null doc_id)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, size: int = SIZE, lang: str = "lang", text: str = "text", hold: int = 250_000) -> Profiles:
    """Profiles of all whole texts of ``docs`` with a language; null texts and null languages teach nothing.

    Repeated rows count each time; an empty table gives profiles without a language, which find ``und`` alone.
    Only each language's ``size`` most frequent n-grams come to the driver.  A task holds about ``hold`` counts
    and hands them on when there are more.
    """
    common.small_batches(docs.sparkSession)

    def run(batches):
        held: dict[str, list] = {}
        waiting = 0

        def merged(parts):
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        def out():
            for name, parts in held.items():
                codes, counts = merged(parts)
                for a in range(0, len(codes), 50_000):
                    c = codes[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(c)), pa.array(c), pa.array(counts[a : a + 50_000])], names=["lang", "gram", "n"])
            held.clear()

        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.unique(grams(t), return_counts=True)
                held.setdefault(name, []).append(part)
                waiting += len(part[0])
                if waiting > hold:
                    held = {name: [merged(parts)] for name, parts in held.items()}
                    waiting = sum(len(p[0][0]) for p in held.values())
                    if waiting > hold // 2:
                        yield from out()
                        waiting = 0
        yield from out()

    parts = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(run, "lang string, gram long, n long")
    counts = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))  # limited before its exchange
    lists: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        lists.setdefault(r.lang, []).append(r.gram)
    return Profiles.build(lists, size)


def predictor(profiles: Profiles):
    """Arrow function text -> (lang_pred, score): Python gets the texts alone, and other columns stay where they are."""

    def run(text: pa.Array) -> pa.Array:
        got = [profiles.predict(t) for t in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["lang_pred", "score"])

    return F.arrow_udf(run, "lang_pred string, score double")


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` + ``lang_pred``, ``score``: from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0.  Repeated rows are judged alike, and an empty
    table gives none.  Columns of ``docs`` with these names are replaced.
    """
    common.small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    own = common.unused("_found", docs.columns)
    found = docs.select(*[f"`{c}`" for c in names], predictor(profiles)(F.col(f"`{text}`")).alias(own))
    return found.select(*[f"`{c}`" for c in names], f"{own}.lang_pred", f"{own}.score")


def cuts(docs: DataFrame, profiles: Profiles, share: float = 0.5) -> dict[str, float]:
    """Least score of each language: ``share`` of the median over all of ``docs`` (lang, text) that are found to be in their own language.

    A median, as some training texts can be gibberish under a wrong label; these score far below it.
    """
    own = identify(docs.where("lang IS NOT NULL").select("lang", "text"), profiles).where("lang = lang_pred")
    return {r.lang: share * r.m for r in own.groupBy("lang").agg(F.percentile_approx("score", 0.5).alias("m")).collect()}


def keep_languages(docs: DataFrame, languages: list[str] | None = None, least: float = 0.02) -> DataFrame:
    """Documents in one of ``languages`` (all learned ones by default), all columns as they were.

    Learned from the documents that are not held out; rejected are ``und`` (null texts and texts without a letter
    too), scores under the language's cut from these documents' own scores and, whatever the cut, scores under
    ``least``.  Repeated rows share a verdict; an empty table gives none.  Other columns never reach Python.
    """
    common.small_batches(docs.sparkSession)
    known = docs.where("doc_id IS NOT NULL").where(~held_out())
    profiles = train(known)
    low = cuts(known, profiles)

    def run(text: pa.Array) -> pa.Array:
        found = [profiles.predict(t) for t in text.to_pylist()]
        return pa.array([name != "und" and score >= max(least, low.get(name, least)) and (languages is None or name in languages) for name, score in found], pa.bool_())

    return docs.where(F.arrow_udf(run, "boolean")(F.col("text")))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    profiles = train(docs.where("doc_id IS NOT NULL").where(~held_out()))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
