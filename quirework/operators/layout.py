"""Layout to paragraphs: furniture, gaps and islands, short-text carry, as-of outline, navigation and screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths
from ..functions import text as tx

#: Screening marks.
MARKS = [
    r"\bCUI\b",
    r"CONTROLLED\s+UNCLASSIFIED",
    r"\bFOUO\b",
    r"FOR\s+OFFICIAL\s+USE\s+ONLY",
    r"\bNOFORN\b",
    r"\bSECRET\b",
    r"\bCONFIDENTIAL\b",
    r"\bTOP\s+SECRET\b",
    r"LAW\s+ENFORCEMENT\s+SENSITIVE",
    r"EXPORT\s+CONTROL",
    r"\bITAR\b",
]


def line_pattern(x) -> Column:
    """A line with single blanks and each number as one mark, so that a running foot is one pattern on all pages."""
    return F.trim(F.regexp_replace(tx.collapse(x), r"\d+", "#"))


def furniture(lines: DataFrame, least: int = 3, band: float = 0.15) -> DataFrame:
    """doc, norm, n: line patterns that stand at least ``least`` times in the top or bottom ``band`` of a document's pages.

    ``lines``: doc, text, y, height (of the page).  A bare number is no furniture; it is the page's label.
    """
    edge = (F.col("y") < F.col("height") * F.lit(band)) | (F.col("y") > F.col("height") * F.lit(1 - band))
    g = lines.where(edge).select("doc", line_pattern("text").alias("norm")).where("norm NOT IN ('', '#')").groupBy("doc", "norm").agg(F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= least)


def body_lines(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``lines`` (doc, page, line_no, text, …) without page numbers and without the document's :func:`furniture`, wherever on the page it stands."""
    number = F.coalesce(F.trim("text").rlike(PAGE_NUMBER), F.lit(False))
    own = lines.where(~number).withColumn("_norm", line_pattern(F.trim("text")))
    return own.join(found.select("doc", F.col("norm").alias("_norm")), ["doc", "_norm"], "left_anti").select(*lines.columns)


def paragraphs(lines: DataFrame, factor: float = 1.45) -> DataFrame:
    """doc, para, first_line, n_lines: a line starts a paragraph if it is a heading or its gap to the line before on its page is large.

    ``lines``: doc, page, line_no, y, leading, heading.  Heading lines are consumed; pages do not break.
    """
    page = Window.partitionBy("doc", "page").orderBy("line_no")
    gap = F.col("y") - F.lag("y").over(page)
    before = F.lag("heading").over(Window.partitionBy("doc").orderBy("page", "line_no"))
    start = F.col("heading") | F.coalesce(before, F.lit(False)) | F.coalesce(gap > factor * F.col("leading"), F.lit(False))
    flagged = lines.withColumn("_s", start.cast("int"))
    run = Window.partitionBy("doc").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    return flagged.withColumn("para", F.sum("_s").over(run)).where(~F.col("heading")).groupBy("doc", "para").agg(F.min(F.struct("page", "line_no")).alias("f"), F.count(F.lit(1)).alias("n_lines")).select("doc", "para", F.col("f.page").alias("page"), F.col("f.line_no").alias("first_line"), "n_lines")


def carry_short(parts: DataFrame, least: int = 80) -> DataFrame:
    """doc, island, pos, text: texts under ``least`` characters prefix the next long one; what is left at the end goes."""
    long_ = (F.length("text") >= least).cast("int")
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marked = parts.withColumn("_l", long_).withColumn("island", F.coalesce(F.sum("_l").over(before), F.lit(0)))
    g = marked.groupBy("doc", "island").agg(F.max("_l").alias("has"), F.max("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    return g.where("has = 1").drop("has")


def ordinals(parts: DataFrame) -> DataFrame:
    """Counter per (doc, chapter, section) in reading order; null keys group together."""
    return parts.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc", "chapter", "section").orderBy("pos")))


def section_counter(parts: DataFrame, by_chapter: bool) -> DataFrame:
    """``parts`` (doc, chapter, section, pos) + section_seq: how often the section has changed so far, from the first line on; anew in each chapter if asked.

    Two nulls are no change; a first section that is not null is one.
    """
    keys = ["doc", "chapter"] if by_chapter else ["doc"]
    w = Window.partitionBy(*keys).orderBy("pos")
    changed = (~F.col("section").eqNullSafe(F.lag("section").over(w))).cast("int")
    return parts.withColumn("_c", changed).withColumn("section_seq", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def clean_outline(entries: DataFrame) -> DataFrame:
    """doc, start, level, title of an outline as read (doc, page from 1, level, title): entries without a page go, pages count from 0, blanks are single."""
    return entries.where(F.col("page") >= 1).select("doc", (F.col("page") - 1).alias("start"), "level", tx.collapse("title").alias("title"))


def outline_asof(points: DataFrame, outline: DataFrame) -> DataFrame:
    """Each point (doc, pos) with the last outline entry (doc, start, level, title) at or before it and its chapter (last level 1).

    A section with the chapter's own title is null.  Union and last-non-null window, no range join.
    """
    a = outline.select("doc", F.col("start").alias("pos"), F.lit(0).alias("kind"), "level", "title")
    b = points.select("doc", "pos", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title"))
    w = Window.partitionBy("doc").orderBy("pos", "kind", "level").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("section", F.last("title", True).over(w)).withColumn("chapter", F.last(F.when(F.col("level") == 1, F.col("title")), True).over(w))
    return both.where("kind = 1").select("doc", "pos", "chapter", F.when(~F.col("section").eqNullSafe(F.col("chapter")), F.col("section")).alias("section"))


def screen(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, mark_no, exact, loose: hits in capitals and hits in any case of each mark; rows with hits only.

    One pattern of all marks is tried first; only texts that it hits are counted mark by mark.
    """
    hit = docs.where(F.col(text).rlike("(?i)" + "|".join(MARKS)))
    marks = F.array(*[F.struct(F.lit(i).alias("mark_no"), F.regexp_count(text, F.lit(p)).alias("exact"), F.regexp_count(text, F.lit("(?i)" + p)).alias("loose")) for i, p in enumerate(MARKS)])
    return hit.select(key, F.inline(marks)).where("loose > 0")


def clearance(docs: DataFrame, findings: DataFrame, adjudicated: DataFrame, key: str) -> DataFrame:
    """key, cleared, blocked_by: positive evidence and no blocking finding that nobody has adjudicated (key, mark_no, exact)."""
    open_ = findings.where("exact > 0").join(adjudicated, [key, "mark_no", "exact"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("blocked_by"))
    b = F.coalesce("blocked_by", F.lit(0))
    return docs.select(key, "evidence", "restricted").join(open_, key, "left").select(key, (F.col("evidence") & ~F.col("restricted") & (b == 0)).alias("cleared"), b.alias("blocked_by"))


def heading(text: Column, size: Column, bold: Column, font: Column, body_size: Column, body_font: Column) -> Column:
    """Whether a line is a heading: short, no closing mark, three letters, and set apart by weight, font or capitals."""
    t = F.trim(text)
    letters = F.regexp_replace(tx.ocr_letters(t), r"[^\p{L}]", "")
    n = F.length(letters)
    capitals = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) / F.greatest(n, F.lit(1)) >= 0.75
    shape = F.length(t).between(3, 90) & ~t.rlike("[.,;:]$") & (n >= 3)
    larger = bold & (size >= 1.15 * body_size)
    other = bold & (tx.font_family(font) != tx.font_family(body_font)) & (size >= body_size)
    yes = lambda x: F.coalesce(x, F.lit(False))
    return yes(shape & (yes(larger) | yes(other) | (~yes(size < 0.95 * body_size) & capitals)))


def reading_order(lines: DataFrame, width: float, least_share: float = 0.2, gutter: float = 0.06, most_straddling: float = 0.15) -> DataFrame:
    """``lines`` (doc, page, line_no, text, x, x1, y) + two_columns, position: left column first where a page has two.

    Two columns: at least 8 lines over 20 characters, each half with its share of them, few across the gutter.
    """
    mid, band = width / 2, width * gutter / 2
    page = Window.partitionBy("doc", "page")
    told = F.length("text") > 20
    count = lambda c: F.count_if(told & c).over(page)
    n, left = count(F.lit(True)), count(F.col("x") < mid)
    across = count((F.col("x") < mid - band) & (F.col("x1") > mid + band))
    two = (n >= 8) & (F.least(left, n - left) / F.greatest(n, F.lit(1)) >= least_share) & (across <= most_straddling * n)
    side = F.when(F.col("two_columns"), (F.col("x") >= mid).cast("int")).otherwise(0)
    return lines.withColumn("two_columns", two).withColumn("position", F.row_number().over(page.orderBy(side, "y", "x", "line_no")))


# Whole lines that are page numbers, headings that say nothing.
PAGE_NUMBER = r"^(?:[A-Z]{1,2}-\d{1,3}|\d{1,2}-\d{1,3}|\d{1,4})$"
DATE_LIKE = r"(?U)^[\dOoIl]{1,2}\s+\w{3,9}\s+[\dOoIl]{4}$"
EMPTY_HEADINGS = ["and", "or", "note", "notes", "continued"]


def page_numbers(lines: DataFrame) -> DataFrame:
    """doc, page, label, n_body: the first line that is a page number, and how many lines are none."""
    number = F.coalesce(F.trim("text").rlike(PAGE_NUMBER), F.lit(False))
    first = F.min(F.when(number, F.struct("line_no", F.trim("text").alias("label"))))
    return lines.groupBy("doc", "page").agg(first.alias("_f"), F.count_if(~number).alias("n_body")).select("doc", "page", F.col("_f.label").alias("label"), "n_body")


def page_statistics(lines: DataFrame, least_share: float = 0.6) -> DataFrame:
    """doc, page, leading, body_size, body_font, margin of the lines (doc, page, line_no, x, y, size, font).

    leading: median of the gaps between 0 and 60, 12 without any.  body_font: the commonest, if it is one of
    several and has its share.  margin: the commonest whole x.  Ties go to the line that comes first.  One
    exchange by page serves all of it.
    """
    page = Window.partitionBy("doc", "page")
    named = lines.withColumn("font", F.nullif("font", F.lit(""))).withColumn("_x", F.bround("x"))
    common = lambda c: F.struct(F.count(c).over(Window.partitionBy("doc", "page", c)).alias("n"), (-F.min("line_no").over(Window.partitionBy("doc", "page", c))).alias("first"), F.col(c).alias("value"))
    gap = F.col("y") - F.lag("y").over(page.orderBy("line_no"))
    marked = named.withColumn("_gap", gap).withColumn("_font", common("font")).withColumn("_margin", common("_x"))
    g = marked.groupBy("doc", "page").agg(
        F.median(F.when((F.col("_gap") > 0) & (F.col("_gap") < 60), F.col("_gap"))).alias("leading"), F.median("size").alias("body_size"),
        F.max("_font").alias("_font"), F.count_distinct("font").alias("_fonts"), F.count(F.lit(1)).alias("_n"), F.max("_margin").alias("_margin"),
    )
    font = F.when((F.col("_font.n") >= least_share * F.col("_n")) & (F.col("_fonts") > 1), F.col("_font.value"))
    return g.select("doc", "page", F.coalesce("leading", F.lit(12.0)).alias("leading"), "body_size", font.alias("body_font"), F.col("_margin.value").alias("margin"))


def outline_levels(outline: DataFrame) -> DataFrame:
    """doc, has_sections: whether an outline names more sections than chapters."""
    return outline.groupBy("doc").agg((F.count_if(F.col("level") >= 2) > F.count_if(F.col("level") == 1)).alias("has_sections"))


def printed_contents(pages: DataFrame, most_pages: int = 25) -> DataFrame:
    """doc, chapter, title, sections from the contents printed on a document's first pages (doc, page from 0, text).

    Of several entries of a chapter the one with most sections stays, then the first.
    """
    head = r"Chapter\s+(\d+)\.?\s*\n\s*([^\n]{3,80})\n"
    found = F.regexp_extract_all("text", F.lit(rf"((?s){head}.*?(?=Chapter\s+\d+\.|\z))"), F.lit(1))
    e = pages.where((F.col("page") < most_pages) & F.contains("text", F.lit("Chapter"))).select("doc", "page", F.posexplode(found).alias("at", "e"))
    flat = F.trim(F.regexp_replace(F.regexp_replace("e", f"^{head}", ""), r"\s*\n\s*", " "))
    names = F.transform(F.split(flat, r"\s*[—–]+\s*|\s*-{2,}\s*"), lambda s: F.trim(tx.collapse(s), F.lit(" .-—")))
    entry = e.select("doc", "page", "at", F.regexp_extract("e", head, 1).cast("int").alias("chapter"), F.trim(F.regexp_extract("e", head, 2)).alias("title"), F.filter(names, lambda s: F.length(s).between(3, 69)).alias("sections"))
    best = entry.groupBy("doc", "chapter").agg(F.max(F.struct(F.size("sections"), -F.col("page"), -F.col("at"), "title", "sections")).alias("b"))
    return best.select("doc", "chapter", "b.title", "b.sections")


def clean_heading(x) -> Column:
    """A heading in capitals is mended and set in title case; any other keeps its letters."""
    t = tx.collapse(x)
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    capitals = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", ""))
    runs = F.regexp_extract_all(F.lower(tx.ocr_letters(t)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    title = F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substring(r, 2, 1 << 30))), "")
    return F.when((F.length(letters) > 0) & (capitals >= 0.75 * F.length(letters)), title).otherwise(t)


def heading_noise(x) -> Column:
    """Headings that name nothing: dates, under 4 characters, no letter, a few empty words."""
    t = F.trim(tx.c(x))
    return t.rlike(DATE_LIKE) | (F.length(t) < 4) | ~t.rlike(r"\p{L}") | F.lower(t).isin(EMPTY_HEADINGS)


def chunk_report(chunks: DataFrame, first: int = 8) -> DataFrame:
    """Each publication's chunks: shares with a page, with a section and across pages, the whole median length, the first unmatched headings.

    ``chunks``: pub_id, n_chars, has_page, has_section, spans, unmatched (null: matched).
    """
    pct = lambda c: maths.round_exact(100 * F.avg(F.coalesce(c, F.lit(False)).cast("int")), 1)
    w = Window.partitionBy("pub_id").orderBy("unmatched")
    odd = chunks.where("unmatched IS NOT NULL").select("pub_id", "unmatched").distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= first)
    names = odd.groupBy("pub_id").agg(F.array_sort(F.collect_list("unmatched")).alias("unmatched"))
    g = chunks.groupBy("pub_id").agg(F.count(F.lit(1)).alias("chunks"), pct(F.col("has_page")).alias("pct_with_page"), pct(F.col("has_section")).alias("pct_with_section"), pct(F.col("spans")).alias("pct_spanning"), F.floor(F.median("n_chars")).cast("int").alias("median_chars"))
    return g.join(names, "pub_id", "left")
