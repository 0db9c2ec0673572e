"""Text scalars as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LIMITS

# Lists that results depend on.
REVIEW_STOP = "a an and are as at be by for from has have how in is it its of on or that the their they this to was were what when where which who why will with you your does do".split()
GRADING_STOP = ["the", "and", "for", "that", "with", "his", "her", "its", "are", "was", "not", "but", "can", "our", "war", "from", "this", "into", "than"]
NAV_TITLES = ["table of contents", "contents", "glossary", "index", "references", "bibliography", "list of figures", "list of tables", "abbreviations"]
JUNK_SECTION = r"(?i)^(mcd|mcdp|distribution|foreword|preface|notes?|conclusion notes)"
PUB_MENTION = r"(?i)\b((?:JP|MCDP|MCWP|MCRP|MCTP|ADP|ATP|FM|TC|MCO|NTTP|AFDP)\s?[\d]+(?:[-.][\dA-Za-z]+)*)\b"
DOT_LEADER = r"\.{4,}|\. \. \. \."


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x) -> Column:
    return F.nullif(c(x), F.lit(""))


def collapse(x) -> Column:
    return F.trim(F.regexp_replace(c(x), r"(?U)\s+", " "))


def tokens(x) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(c(x)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def retrieval_header(pub_id, title, chapter, chapter_title, section) -> Column:
    pub, title, chapter, ct, section = c(pub_id), c(title), c(chapter), blank_to_null(chapter_title), blank_to_null(section)
    first = F.when(title.isNull() | (title == "") | (title == pub), pub).otherwise(F.concat_ws(", ", pub, title))
    second = F.when(chapter.isNotNull() & (chapter != 0) & ct.isNotNull(), F.concat(F.lit("Chapter "), chapter.cast("string"), F.lit(": "), ct)).otherwise(ct)
    return F.concat_ws(" | ", blank_to_null(first), second, section)


def retrieval_text(header: Column, body: Column) -> Column:
    body = F.coalesce(body, F.lit(""))
    return F.when(header == "", body).otherwise(F.concat(header, F.lit("\n"), body))


def sentences(x) -> Column:
    """Pieces between white space that follows . ! ? and stands before A-Z or 0-9."""
    return F.split(F.trim(c(x)), r"(?<=[.!?])\s+(?=[A-Z0-9])")


def markers(x) -> Column:
    return F.transform(F.regexp_extract_all(c(x), F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda s: s.cast("int"))


def ocr_letters(x) -> Column:
    return collapse(F.translate(c(x), "0158", "OISB"))


def font_family(x) -> Column:
    """Lower-case family of a font name: no subset prefix, nothing from the first hyphen or comma on."""
    return F.lower(F.regexp_extract(c(x), r"^(?:[^+]*\+)?([^-,]*)", 1))


def item_json(x) -> Column:
    """struct<question, key_points> from noisy model text, or null: a question of 15 characters and up to three non-empty points."""
    raw = F.from_json(F.regexp_extract(c(x), r"(?s)\{.*\}", 0), "question string, key_points array<string>")
    made = F.struct(F.trim(raw["question"]).alias("question"), F.slice(F.filter(F.transform(raw["key_points"], lambda k: F.trim(k)), lambda k: k != ""), 1, 3).alias("key_points"))
    return F.when((F.length(made["question"]) >= 15) & (F.size(made["key_points"]) > 0), made)


def compact(x) -> Column:
    return F.regexp_replace(F.lower(c(x)), "[^a-z0-9]", "")


def content_tokens(x) -> Column:
    """Review tokens: a-z0-9 runs longer than 2, no stop words."""
    stop = F.array(*[F.lit(w) for w in REVIEW_STOP])
    return F.filter(F.regexp_extract_all(F.lower(c(x)), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def grading_tokens(x) -> Column:
    stop = F.array(*[F.lit(w) for w in GRADING_STOP])
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c(x)), F.lit("([a-z]{3,})"), F.lit(1)), lambda t: ~F.array_contains(stop, t)))


def overlap(a: Column, b: Column) -> Column:
    """Share of b's distinct tokens that a has; 0 if either is empty."""
    n = F.size(F.array_distinct(b))
    return F.when((F.size(a) == 0) | (n == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def usable_section(x) -> Column:
    """At least 4 letters, at most 15 % digits, no word that starts with "distribut"."""
    s = c(x)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    digits = F.length(F.regexp_replace(s, r"[^0-9]", ""))
    return F.coalesce((letters >= 4) & (digits / F.greatest(F.length(s), F.lit(1)) <= 0.15) & ~F.lower(s).rlike(r"(^|\s)distribut"), F.lit(False))


def citation(pub_id, edition, chapter_title, chapter, section, ordinal, page) -> Column:
    ct = F.when(F.trim(c(chapter_title)).rlike(r"(?i)^chap(ter)?\s*\d+$"), None).otherwise(blank_to_null(chapter_title))
    ch = F.when(c(chapter) != 0, c(chapter)).cast("string")
    place = F.when(ct.isNotNull() & ch.isNotNull(), F.concat(F.lit("Ch "), ch, F.lit(": "), ct)).when(ct.isNotNull(), ct).when(ch.isNotNull(), F.concat(F.lit("Ch "), ch))
    sec = F.when(usable_section(section), F.concat(F.lit('"'), c(section), F.lit('"')))
    return F.concat_ws(", ", c(pub_id), F.when(blank_to_null(edition).isNotNull(), F.concat(F.lit("("), c(edition), F.lit(")"))), place, sec, F.concat(F.lit("para "), c(ordinal).cast("string")), F.when(blank_to_null(page).isNotNull(), F.concat(F.lit("p."), c(page))))


def navigation(text, chapter_title, section) -> Column:
    """Front or back matter: a navigation title, two dot leaders, or under 75 % letters and white space."""
    t = c(text)
    titled = F.coalesce(F.lower(F.trim(c(chapter_title))).isin(NAV_TITLES), F.lit(False)) | F.coalesce(F.lower(F.trim(c(section))).isin(NAV_TITLES), F.lit(False))
    alpha = F.length(F.regexp_replace(t, r"(?U)[^\p{L}\s]", ""))
    return titled | (F.regexp_count(t, F.lit(DOT_LEADER)) >= 2) | ((F.length(t) > 0) & (alpha / F.length(t) < 0.75))


def pub_mentions(x) -> Column:
    found = F.regexp_extract_all(c(x), F.lit(PUB_MENTION), F.lit(1))
    return F.array_distinct(F.transform(found, lambda p: collapse(F.translate(F.upper(p), ".", "-"))))


def item_id(pub_id, chapter, source_text, ordinal) -> Column:
    digest = F.substring(F.sha2(collapse(source_text), 256), 1, 10)
    return F.concat_ws("-", F.regexp_replace(c(pub_id), "[^A-Za-z0-9]", ""), F.concat(F.lit("c"), F.coalesce(c(chapter), F.lit(0)).cast("string")), digest, c(ordinal).cast("string"))


def support_label(x) -> Column:
    """One-word verdicts, failing closed."""
    u = F.upper(F.coalesce(c(x), F.lit("")))
    return F.when(u.contains("NOT SUPPORTED") | u.contains("NOT_SUPPORTED") | u.contains("UNSUPPORTED"), "NOT_SUPPORTED").when(u.contains("CONTRADICT"), "CONTRADICTED").when(u.contains("SUPPORTED"), "SUPPORTED").otherwise("NOT_SUPPORTED")


def learner_id(x) -> Column:
    """Normalised id, or null if it is not valid."""
    n = F.lower(F.trim(c(x)))
    return F.when(n.rlike(r"^[a-z0-9][a-z0-9._-]{0,63}$"), n)


def dehyphenated(lines: Column) -> Column:
    """Lines joined by spaces; a line that ends in a single hyphen is glued to a next one in lower case."""
    # empty lines at the head give nothing; each line then ends by what the next one is, so no text is gone over twice
    first = F.array_position(F.transform(lines, lambda l: l != ""), True).cast("int")
    own = F.slice(lines, F.when(first > 0, first).otherwise(F.size(lines) + 1), F.size(lines))
    ended = F.zip_with(own, F.slice(own, F.lit(2), F.size(own)), lambda l, n: F.when(n.isNull(), l).when(l.rlike(r"(^|[^-])-$") & n.rlike(r"^\p{Ll}"), F.regexp_replace(l, "-$", "")).otherwise(F.concat(l, F.lit(" "))))
    return F.when(~F.exists(lines, lambda l: l.isNull()), F.array_join(ended, ""))


def windows(text, size: int = 1000, step: int = 800, single: int = 1150) -> Column:
    """array<struct<start, text>> of overlapping character windows; short texts are one window."""
    t = c(text)
    last = F.ceil((F.length(t) - size) / step) * step
    starts = F.when(F.length(t) <= single, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), last, F.lit(step).cast("bigint")))
    width = F.when(F.length(t) <= single, F.lit(single)).otherwise(F.lit(size))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), t.substr((s + 1).cast("int"), width).alias("text")))


def source_sentences(x) -> Column:
    """Pieces after . ! ? and white space that are longer than 25 characters; the whole text if there is none."""
    t = F.coalesce(c(x), F.lit(""))
    parts = F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 25)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(t))


def limited(x, what: str) -> Column:
    """At most as many characters as the limit of that name allows."""
    return F.left(c(x), F.lit(LIMITS[what]))


def event_frame(event, data) -> Column:
    """One server-sent event; every line of ``data`` is a data line of its own."""
    return F.concat(F.lit("event: "), c(event), F.lit("\ndata: "), F.regexp_replace(c(data), r"\r?\n", "\ndata: "), F.lit("\n\n"))
