"""Numbers, years, ordinals, pages and names that an answer asserts, held against what the sources say.

A plain function per step with one pandas UDF around the verdict.  Kinds are found in order of priority; what
one kind takes is blanked out, so that a later kind cannot read it again.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number words, ordinal words and words that do not make a name.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split()
NOT_NAMES = frozenset(
    """the this that these those there here it in on at a an and or but if when while for from with by as to of all each both per see note however
    marine corps united states tactical combat casualty care field manual department defense committee guidelines guideline army navy air force joint
    publication headquarters section chapter appendix table figure annex enclosure phase phases step steps principle principles doctrine edition page pages
    tccc mccmos usmc warfighting general colonel major captain president committee's""".split()
)
PARTICLES = "of the von van de del la".split()

#: What a reader is told of each kind.
LABELS = {"cardinal": "figure", "ordinal": "rank in an order", "year": "date", "page": "place in print", "proper_noun": "person or body"}

_WORD_VALUE = {w: n for n, w in enumerate(UNITS)} | {w: 10 * n for n, w in enumerate(TENS, 2)}
_ANY_NUMBER = "|".join(sorted([*_WORD_VALUE, "hundred"], key=len, reverse=True))
#: Kind -> pattern, by priority.
_PATTERNS = [
    ("page", re.compile(r"\b(?:pp?\.?|pages?)\s*(\d+)\s*(?:[-‐-―]\s*(\d+))?", re.I)),
    ("year", re.compile(r"\b(?:1\d{3}|20\d{2})\b")),
    ("ordinal", re.compile(r"\b(\d+)(?:st|nd|rd|th)\b", re.I)),
    ("ordinal", re.compile(rf"\b(?:{'|'.join(ORDINALS)})\b", re.I)),
    ("cardinal", re.compile(rf"\b(?:{_ANY_NUMBER})(?:[\s-]+(?:{_ANY_NUMBER}))*\b", re.I)),
    ("cardinal", re.compile(r"\b\d+\b")),
]
_MARKER = re.compile(r"\[\d+\]")
_CAPITALS = re.compile(rf"\b[A-Z][A-Za-z]*\.?(?:\s+(?:[A-Z][A-Za-z]*\.?|{'|'.join(PARTICLES)}))*")
#: Kinds that a question asks for.
_ASKS = [
    ("cardinal", re.compile(rf"\bhow many\b|\bnumber of\b|\bhow much\b|\bthe\s+(?:{'|'.join(UNITS + TENS)}|\d+)\s+\w+", re.I)),
    ("page", re.compile(r"\bpages?\b|\bpp?\.", re.I)),
    ("year", re.compile(r"\bedition\b|\bwhat year\b|\bwhich year\b|\b(?:1\d{3}|20\d{2})\b", re.I)),
    ("proper_noun", re.compile(r"\bwho\b|\bwhom\b|\bcredit(?:s|ed)?\b|\battribut(?:e|es|ed|ion)\b|\bquot(?:e|es|ed|ation)\b|\bwrote\b|\bauthor(?:ed|s)?\b|\bsaid\b|\bnamed?\b", re.I)),
]


def blanked(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: " " * len(m.group()), text)


def number(words: str) -> int:
    """Value of a spelled-out run such as "one hundred seven"."""
    total = 0
    for w in re.split(r"[\s-]+", words.lower()):
        total = (total or 1) * 100 if w == "hundred" else total + _WORD_VALUE[w]
    return total


def digits(s: str) -> str:
    """Digits of any script without leading zeros; runs of any length."""
    return "".join(str(int(d)) for d in s).lstrip("0") or "0"


def keys_of(kind: str, m: re.Match) -> list[str]:
    """Forms under which a match is looked up."""
    if kind == "page":
        a, b = m.group(1), m.group(2)
        return [f"page:{a}"] + ([f"page:{b}", f"page:{a}-{b}"] if b else [])
    if kind == "ordinal":
        return [f"ord:{digits(m.group(1)) if m.re.groups else ORDINALS.index(m.group().lower()) + 1}"]
    word = m.group()
    return [f"num:{digits(word) if word[0].isdigit() else number(word)}"]


def name_keys(run: str) -> list[str]:
    """[whole name, surname] of a run of capitalised words; [] unless two of them can belong to a name."""
    words = run.split()
    while words and words[-1].lower() in PARTICLES:
        words.pop()
    bare = [w.rstrip(".") for w in words]
    full = [b.lower() for w, b in zip(words, bare, strict=True) if re.fullmatch(r"[A-Z][a-z]+", b) and b.lower() not in NOT_NAMES]
    initials = [b for w, b in zip(words, bare, strict=True) if re.fullmatch(r"[A-Z]\.?", w) and b.lower() not in NOT_NAMES]
    return [" ".join(b.lower() for b in bare if b), full[-1]] if full and len(full) + len(initials) >= 2 else []


def specifics(text: str | None) -> list[tuple[str, str, list[str]]]:
    """(kind, raw, keys) of everything specific in a text, markers left out."""
    clean = blanked(text or "", _MARKER)
    out, rest = [], clean
    for kind, pattern in _PATTERNS:
        out += [(kind, m.group().strip(), keys_of(kind, m)) for m in pattern.finditer(rest)]
        rest = blanked(rest, pattern)
    return out + [("proper_noun", m.group().strip(), k) for m in _CAPITALS.finditer(clean) if (k := name_keys(m.group()))]


class Sources:
    """What spans say: every number in any form, all words, and the running text.  Here kinds do not exclude each other."""

    def __init__(self, spans: list[str]):
        blob = blanked("  ".join(s for s in spans if s), _MARKER)
        self.keys = {k for kind, p in _PATTERNS for m in p.finditer(blob) for k in keys_of(kind, m)}
        self.words = {w.lower() for w in re.findall(r"[A-Za-z]+", blob)}
        self.text = re.sub(r"\s+", " ", blob.replace(".", " ")).lower()

    def say(self, kind: str, keys: list[str]) -> bool:
        if kind == "proper_noun":
            return keys[0] in self.text or keys[1] in self.words
        return any(k in self.keys for k in keys)


def verdict(answer: str | None, question: str | None, spans: list[str]) -> dict:
    """unsupported (kind, raw), refuse, reason: refused only if an unsupported kind is one that the question asks for."""
    src = Sources(spans)
    missing = [(k, raw) for k, raw, keys in specifics(answer) if not src.say(k, keys)]
    asked = {k for k, p in _ASKS if p.search(question or "")}
    bearing = [(k, raw) for k, raw in missing if k in asked]
    named = ", ".join(sorted({raw for _, raw in bearing or missing}))
    if bearing:
        reason = f"asked for a {LABELS[bearing[0][0]]}; no source has: {named}"
    else:
        reason = f"in no source, but not asked for: {named}" if missing else "all specifics are in the sources"
    return {"unsupported": [{"kind": k, "raw": r} for k, r in missing], "refuse": bool(bearing), "reason": reason}


_FOUND = T.StructType([T.StructField("kind", T.StringType()), T.StructField("raw", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType()))])
_VERDICT = T.StructType([T.StructField("unsupported", T.ArrayType(T.StructType(_FOUND.fields[:2]))), T.StructField("refuse", T.BooleanType()), T.StructField("reason", T.StringType())])


@F.pandas_udf(T.ArrayType(_FOUND))
def extract(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [{"kind": k, "raw": r, "keys": ks} for k, r, ks in specifics(t)])


@F.pandas_udf(_VERDICT)
def specifics_verdict(answer: pd.Series, question: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = [verdict(a, q, [] if s is None else list(s)) for a, q, s in zip(answer, question, spans, strict=True)]
    return pd.DataFrame(rows, columns=["unsupported", "refuse", "reason"])
