"""Journal issues: contents tables into entries, printed page numbers into file pages, articles into texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapse, strip

#: Words that head a section of a contents table, and credentials that follow an author's name.
SECTION_LABELS = (
    "CONTENTS", "ARTICLES", "ARTICLE", "COMMENTARY", "BRIEF REPORTS", "BRIEF REPORT", "BOOK REVIEWS", "BOOK REVIEW", "FROM THE ARCHIVES",
    "FACULTY CASE CONFERENCE", "REFERENCES", "INDEX", "IN MEMORIAM", "INTRODUCTION TO CONFERENCE", "FROM THE EDITOR", "FROM THE GUEST EDITOR",
)
PANEL = "(?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH) PANEL OF PRESENTATIONS"
CREDENTIALS = ("PhD", "MD", "MSW", "LCSW", "LMFT", "LCPC", "LICSW", "PsyD", "EdD", "MA", "MS", "MEd", "RN", "DMin", "MDiv", "JD", "MFT", "MSN", "MSSW", "MSAT")
_CREDENTIAL = r"\b(?:" + "|".join(CREDENTIALS) + r")\b"
_REVIEWER = r"^(?:Reviewed by|Review|Reviewer)(?::| )"
_PREFIX = r"^(?:Reviewed by:? ?|Review: ?|Reviewer: ?|Presenter: ?|Introduction by:? ?|Introduction: ?)"


#: A name with credentials after a comma. As a title it is the editor's, whose piece bears no title of its own.
_EDITOR = rf"^[A-Z][a-z]+(?: [A-Z]\.)?(?: [A-Z][a-z]+)+ *, *(?:.*\b)?(?:{'|'.join(CREDENTIALS)})\b"
EDITORIAL = "FROM THE EDITOR"


def is_section_label(text: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether a line is the heading of a section; ``more`` are the labels of single issues, in capitals."""
    label = F.upper(strip(text))
    return label.isin(*SECTION_LABELS, *more) | label.rlike(f"^{PANEL}$")


def page_number(text: Column) -> Column:
    """The number of a line that is nothing but one to four digits, else null."""
    digits = F.regexp_extract(strip(text), "^([0-9]{1,4})$", 1)
    return F.when(digits != "", digits.cast("int"))


def has_credentials(text: Column) -> Column:
    return text.rlike(_CREDENTIAL)


def has_reviewer_prefix(text: Column) -> Column:
    return strip(text).rlike(_REVIEWER)


def last_name(text: Column) -> Column:
    """The last word of an author's line without role, credentials and further authors; ``Unknown`` if nothing is left."""
    one = F.substring_index(F.regexp_replace(strip(text), _PREFIX, ""), " and ", 1)
    bare = collapse(F.regexp_replace(F.regexp_replace(one, rf",?\s*{_CREDENTIAL}", ""), r"[,;\s]+$", ""))
    word = F.regexp_replace(F.element_at(F.split(bare, " "), -1), r"^[.,;]+|[.,;]+$", "")
    return F.when(word == "", "Unknown").otherwise(word)


def article_file_name(journal: str, issue: Column, author: Column, title: Column) -> Column:
    """``journal issue author`` and the first five words of the title without a leading article, as a file name."""
    words = F.filter(F.split(title, " "), lambda w: w != "")
    words = F.when(F.lower(F.get(words, F.lit(0))).isin("a", "an", "the", "on"), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))).otherwise(words)
    raw = F.concat_ws(" ", F.lit(journal), issue, author, F.array_join(F.slice(words, 1, 5), " "))
    return collapse(F.regexp_replace(F.concat(raw, F.lit(".txt")), r"[<>:\"/\\|?*\x00-\x1F'‘’]", ""))


def toc_tokens(df: DataFrame, key: str, text: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """``key, pos, type, text_val, page_val``: the lines of a contents table as tokens.

    ``PAGE`` is a line of digits, ``HEADER`` a section label, ``TAB`` a line that ends with a tab, ``TEXT`` any other.
    A page number that follows a tab on the same line is a token of its own. Blank lines are skipped; a line that
    contains one of ``stop`` ends the table.
    """
    lines = F.split(F.regexp_replace(text, r"\t([0-9]{1,4})(?=\n|$)", "\t\n$1"), "\n")
    rows = df.select(key, F.posexplode(lines).alias("pos", "line")).where(strip(F.col("line")) != "")
    if stop:
        ends = F.lit(False)
        for s in stop:
            ends = ends | F.contains(F.lower("line"), F.lit(s.lower()))
        cut = rows.where(ends).groupBy(key).agg(F.min("pos").alias("_cut"))
        rows = rows.join(cut, key, "left").where(F.col("_cut").isNull() | (F.col("pos") < F.col("_cut"))).drop("_cut")
    line, content = F.col("line"), strip(F.col("line"))
    kind = F.when(page_number(line).isNotNull(), "PAGE").when(is_section_label(line), "HEADER").when(line.endswith("\t"), "TAB").otherwise("TEXT")
    return rows.select(key, "pos", kind.alias("type"), F.when(kind == "HEADER", F.upper(content)).when(kind != "PAGE", content).alias("text_val"), page_number(line).alias("page_val"))


def toc_entries(tokens: DataFrame, key: str) -> DataFrame:
    """``key, ord, title, author, page``: the entries of contents tables, from their tokens.

    An entry begins at a ``TAB`` whose next token but ``TEXT`` is a ``PAGE``. Until the next entry or label, further ``TAB``
    lines before the author continue the title. The author is the first reviewer's line, else the first line with
    credentials, else the first plain ``TEXT``; without any it is ``Unknown``. A ``TAB`` that is a name with credentials
    directly before its page is the editor's piece, titled ``FROM THE EDITOR``.
    """
    by_pos = Window.partitionBy(key).orderBy("pos")
    solid = F.when(F.col("type") != "TEXT", F.struct("type", "page_val"))
    after = F.first(solid, ignorenulls=True).over(by_pos.rowsBetween(1, Window.unboundedFollowing))
    marked = tokens.withColumn("at_page", F.coalesce(F.lead("type").over(by_pos) == "PAGE", F.lit(False))).withColumn("next", after).withColumn("starts", (F.col("type") == "TAB") & (F.col("next.type") == "PAGE"))
    marked = marked.withColumn("block", F.sum((F.col("starts") | (F.col("type") == "HEADER")).cast("int")).over(by_pos))
    in_block = Window.partitionBy(key, "block").orderBy("pos")
    marked = marked.withColumn("opens", F.first("starts").over(in_block)).where("opens")
    rank = F.when(has_reviewer_prefix(F.col("text_val")), 0).when(has_credentials(F.col("text_val")), 1).when(F.col("type") == "TEXT", 2)
    marked = marked.withColumn("as_author", F.when(~F.col("starts") & F.col("type").isin("TAB", "TEXT"), rank))
    blocks = marked.withColumn("author_at", F.min(F.when(F.col("as_author").isNotNull(), F.struct("as_author", "pos", "text_val"))).over(Window.partitionBy(key, "block")))
    titled = (F.col("type") == "TAB") & (F.col("as_author").isNull()) & (F.col("pos") < F.coalesce(F.col("author_at.pos"), F.lit(1 << 30)))
    found = blocks.groupBy(key, "block").agg(
        F.min("pos").alias("pos"),
        F.min(F.when(F.col("starts") & F.col("at_page") & F.col("text_val").rlike(_EDITOR), F.col("text_val"))).alias("editor"),
        collapse(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(titled, F.struct("pos", "text_val")))), lambda x: x["text_val"]), " ")).alias("title"),
        F.first("author_at").alias("a"),
        F.min(F.when(F.col("starts"), F.col("next.page_val"))).alias("page"),
    )
    kept = found.where(F.col("editor").isNotNull() | (F.col("title") != "") & ~is_section_label(F.col("title")))
    title, author = F.when(F.col("editor").isNotNull(), EDITORIAL).otherwise(F.col("title")), F.coalesce("editor", "a.text_val")
    return kept.select(key, F.row_number().over(Window.partitionBy(key).orderBy("pos")).alias("ord"), title.alias("title"), F.coalesce(last_name(author), F.lit("Unknown")).alias("author"), "page")


def page_map(pages: DataFrame, issue: str, pdf_page: str, text: str) -> DataFrame:
    """``issue, journal_page, pdf_page``: which file page bears which printed number.

    Of the first six non-blank lines of a page the first counts that is a number, begins with a number and a tab or
    bar, or ends with a bar and a number; else the first line of the page that is a number. The earliest page wins.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")

    def number(line: Column, *patterns: str) -> Column:
        found = [F.regexp_extract(line, p, 1) for p in patterns]
        return F.coalesce(*(F.when(x != "", x.cast("int")) for x in found))

    near = F.transform(F.slice(lines, 1, 6), lambda x: number(x, "^([0-9]{1,4})$", "^([0-9]{1,4})(?:\t| *\\|)", "\\| *([0-9]{1,4})$"))
    far = F.transform(lines, lambda x: number(x, "^([0-9]{1,4})$"))
    first = F.coalesce(F.get(F.filter(near, lambda x: x.isNotNull()), F.lit(0)), F.get(F.filter(far, lambda x: x.isNotNull()), F.lit(0)))
    return pages.select(F.col(issue).alias("issue"), first.alias("journal_page"), F.col(pdf_page).alias("pdf_page")).where("issue is not null and journal_page is not null").groupBy("issue", "journal_page").agg(F.min("pdf_page").alias("pdf_page"))


def nearest_pages(asked: DataFrame, mapped: DataFrame, reach: int = 7) -> DataFrame:
    """``asked (issue, page)`` with ``pdf_page``: the mapped page, else the nearest within ``reach``, the lower of two equally
    near; null without one. The offsets are exploded, so the join is one on equality."""
    tries = asked.select("issue", "page").distinct().withColumn("d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("journal_page", F.col("page") + F.col("d"))
    found = tries.join(mapped, ["issue", "journal_page"]).groupBy("issue", "page").agg(F.min_by("pdf_page", F.struct(F.abs("d"), "d")).alias("pdf_page"))
    return asked.join(found, ["issue", "page"], "left")


def article_extents(starts: DataFrame, mapped: DataFrame, reach: int = 7, longest: int = 30, strict: bool = True) -> DataFrame:
    """``issue, ord, start_page, end_page, start_pdf, end_pdf`` of the articles ``starts (issue, ord, page)``.

    An article ends before the next one, the last with the issue's last mapped page below 1000. An end that can't be
    mapped, or comes before the start, is ``longest`` pages after it (with ``strict`` off: the start itself), at most
    the last file page. Articles whose start can't be mapped are left out.
    """
    content = mapped.where("journal_page < 1000")
    last = content.groupBy("issue").agg(F.max("journal_page").alias("_last"), F.max("pdf_page").alias("_pages"))
    ends = F.coalesce(F.lead("page").over(Window.partitionBy("issue").orderBy("ord")) - 1, F.col("_last"))
    rows = starts.join(last, "issue").select("issue", "ord", F.col("page").alias("start_page"), ends.alias("end_page"), "_pages")
    begun = nearest_pages(rows.withColumnRenamed("start_page", "page"), content, reach).withColumnRenamed("page", "start_page").withColumnRenamed("pdf_page", "start_pdf")
    both = nearest_pages(begun.withColumnRenamed("end_page", "page"), content, reach).withColumnRenamed("page", "end_page").withColumnRenamed("pdf_page", "end_pdf")
    fallback = F.col("start_pdf") + (longest if strict else 0)
    end = F.when(F.col("end_pdf") >= F.col("start_pdf"), F.col("end_pdf")).otherwise(fallback)
    return both.where("start_pdf is not null").select("issue", "ord", "start_page", "end_page", "start_pdf", F.least(end, F.col("_pages")).alias("end_pdf"))


def article_texts(extents: DataFrame, pages: DataFrame, issue: str, pdf_page: str, text: str) -> DataFrame:
    """``issue, ord, pages, text``: the non-blank pages of every article in order, soft hyphens dropped."""
    each = extents.withColumn("pdf_page", F.explode(F.sequence("start_pdf", "end_pdf")))
    own = pages.select(F.col(issue).alias("issue"), F.col(pdf_page).alias("pdf_page"), F.regexp_replace(text, "\xad", "").alias("text")).where(strip(F.col("text")) != "")
    return each.join(own, ["issue", "pdf_page"]).groupBy("issue", "ord").agg(F.count("*").alias("pages"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pdf_page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def ocr_entries(df: DataFrame, key: str, text: str, years: tuple[int, int] = (1990, 2029)) -> DataFrame:
    """``key, page, title, author``: entries of badly recognised contents tables.

    Every line that is a number and no year is an entry. Its title is the nearest of up to four lines above that is
    longer than two characters, no label and not beyond another number; its author stands in the up to five lines
    below, before another number or label, and has credentials or a reviewer's mark.
    """
    rows = df.select(key, F.posexplode(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")).alias("pos", "line"))
    number = F.when(~page_number(F.col("line")).between(*years), page_number(F.col("line")))
    rows = rows.select(key, "pos", "line", number.alias("n"), is_section_label(F.regexp_replace("line", "_+$", "")).alias("label"))
    near = Window.partitionBy(key).orderBy("pos")
    item = F.struct("pos", "line", "n", "label")
    placed = rows.withColumn("above", F.reverse(F.collect_list(item).over(near.rowsBetween(-4, -1)))).withColumn("below", F.collect_list(item).over(near.rowsBetween(1, 5))).where("n is not null")

    def until_stop(items: Column) -> Column:
        stops = F.transform(items, lambda x: x["n"].isNotNull() | x["label"])
        at = F.array_position(stops, True)
        return F.when(at > 0, F.slice(items, F.lit(1), (at - 1).cast("int"))).otherwise(items)

    title = F.get(F.filter(until_stop(F.col("above")), lambda x: (F.length(x["line"]) > 2) & ~x["line"].startswith("-")), F.lit(0))["line"]
    author = F.get(F.filter(until_stop(F.col("below")), lambda x: has_credentials(x["line"]) | has_reviewer_prefix(x["line"])), F.lit(0))["line"]
    cleaned = F.regexp_replace(F.regexp_replace(title, "^['\"]+", ""), "_+$", "")
    return placed.select(key, F.col("n").alias("page"), strip(cleaned).alias("title"), F.coalesce(last_name(author), F.lit("Unknown")).alias("author")).where("title != ''")


def corrected_entries(entries: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """``entries (key, page, title, author)`` with the rows of ``corrections`` in place of those of the same key and page, and
    those that recognition missed added. Of several corrections of a page the least title counts."""
    once = corrections.groupBy(key, "page").agg(F.min(F.struct("title", "author")).alias("c")).select(key, "page", "c.title", "c.author")
    return entries.select(key, "page", "title", "author").join(once.select(key, "page"), [key, "page"], "left_anti").unionByName(once)


def issue_contents(issues: DataFrame, pages: DataFrame, issue: str, pdf_page: str, text: str) -> DataFrame:
    """``issue, toc_format, text``: the contents table of every issue of ``issues (issue, toc_pages array<int>, toc_format, skip)``
    that isn't skipped, its pages in the order of the list. Pages that don't exist are left out, issues without any too."""
    listed = issues.where(~F.coalesce("skip", F.lit(False))).select("issue", "toc_format", F.posexplode("toc_pages").alias("n", "pdf_page"))
    own = pages.select(F.col(issue).alias("issue"), F.col(pdf_page).alias("pdf_page"), F.col(text).alias("text")).where("text is not null")
    found = listed.join(own, ["issue", "pdf_page"]).groupBy("issue", "toc_format").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("t"))
    return found.select("issue", "toc_format", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def article_records(articles: DataFrame, extents: DataFrame, texts: DataFrame, journal: str) -> DataFrame:
    """``issue, ord, file_name, record, warning`` of ``articles (issue, ord, title, author)``: each article's text below four
    lines that say where it stands, what it is called, who wrote it and on which pages.

    ``warning`` is ``unmapped`` for an article whose start has no page in the file (its record is null) and ``empty`` for
    one without text; else null.
    """
    rows = articles.join(extents.select("issue", "ord", "start_page", "end_page"), ["issue", "ord"], "left").join(texts.select("issue", "ord", "text"), ["issue", "ord"], "left")
    pages = F.concat(F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string"))
    head = F.concat(F.lit(f"{journal} Vol. "), F.col("issue"), F.lit("\nTitle: "), F.col("title"), F.lit("\nAuthor: "), F.col("author"), F.lit("\nPages: "), pages, F.lit("\n\n"))
    warning = F.when(F.col("start_page").isNull(), "unmapped").when(strip(F.coalesce("text", F.lit(""))) == "", "empty")
    name = article_file_name(journal, F.col("issue"), F.col("author"), F.col("title"))
    return rows.select("issue", "ord", name.alias("file_name"), F.concat(head, F.coalesce("text", F.lit(""))).alias("record"), warning.alias("warning"))
