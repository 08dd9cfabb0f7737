"""Column expressions over texts. All stay in the JVM except ``nfkc``, for which Spark has no function."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The white space of Unicode text patterns, spelled out because regex dialects differ in ``\\s``.
SPACE = r"[ \t\n\r\f\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
#: What separates words: everything but letters, numbers and the underscore.
NOT_WORD = r"[^\p{L}\p{N}_]+"

#: Words that retrieval leaves out. Domain words are added by the caller.
STOP_WORDS = tuple(
    "the and for are but not you all can had her was one our out day get has him his how man new now old see two way "
    "who boy did its let put say she too use what with this that have from they will been more when than them were "
    "said each which about there their would make like into time look just come could also some then these many well "
    "only over such after most very even back any good know same tell does think people things".split()
)


def strip(text: Column) -> Column:
    """``text`` without white space at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def tokens(text: Column, stop_words=STOP_WORDS, least: int = 3) -> Column:
    """Lower-cased words of at least ``least`` characters that are no stop words, in order; none for a null text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop_words) if stop_words else F.length(w) >= least)


def with_bigrams(words: Column) -> Column:
    """The words followed by all pairs of neighbours, joined by a space."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def stems(word: Column) -> Column:
    """The word and its variants without common endings. The rules are independent of each other."""

    def cut(n: int, tail: str = "") -> Column:
        return F.concat(word.substr(F.lit(1), F.length(word) - n), F.lit(tail))

    rules = [("ing", 5, 3, ""), ("ed", 4, 2, ""), ("ed", 4, 1, ""), ("ies", 4, 3, "y"), ("es", 4, 2, ""), ("s", 3, 1, "")]
    made = [F.when(word.endswith(end) & (F.length(word) > longer), cut(n, tail)) for end, longer, n, tail in rules]
    return F.array_distinct(F.filter(F.array(word, *made), lambda w: w.isNotNull()))


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` stands in ``text`` without overlap; 0 for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def excerpt(text: Column, n: int) -> Column:
    """The first ``n`` characters with white space collapsed."""
    return collapse(F.substring(text, 1, n))


def format_chunk(text: Column, title: Column) -> Column:
    """A chunk as readable paragraphs: one leading ``[title]`` dropped, lines unwrapped, blank paragraphs left out."""
    head = F.concat(F.lit("["), title, F.lit("]\n\n"))
    body = F.when((F.coalesce(title, F.lit("")) != "") & text.startswith(head), text.substr(F.length(head) + 1, F.length(text))).otherwise(text)
    paragraphs = F.transform(F.split(body, "\n{2,}"), lambda p: strip(F.regexp_replace(F.regexp_replace(p, "\n", " "), " {2,}", " ")))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def shown_number(x: Column) -> Column:
    """A multiplier as text, whole numbers without a decimal point."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def percent(score: Column) -> Column:
    """A share as whole per cent, halves to the even number."""
    return F.concat(F.bround(score * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def score_label(mode: Column, score: Column, boost: Column) -> Column:
    """The label shown beside a hit: hits for keyword search, two decimals for BM25, else per cent; a star where boosted."""
    star = F.when(boost > 1, F.lit(" ★")).otherwise("")
    times = F.when(boost > 1, F.concat(F.lit(" ×"), shown_number(boost), F.lit(" ★"))).otherwise("")
    hits = F.concat(F.bround(score / boost, 0).cast("bigint").cast("string"), F.lit(" hits"), times)
    return F.when(mode == "keyword", hits).when(mode == "bm25", F.concat(F.format_number(score, 2), star)).otherwise(F.concat(percent(score), star))


def score_color(mode: Column, score: Column) -> Column:
    """Colour class of a hit."""
    return F.when(mode == "keyword", "violet").when(score > 0.4, "green").when(score > 0.15, "amber").otherwise("grey")


def position_badge(page: Column, pos: Column, count: Column) -> Column:
    """``p.N`` for a chunk with a page, else its position in the document in per cent; null for a lone chunk."""
    share = F.concat(F.lit("~"), F.bround(pos / count * 100, 0).cast("bigint").cast("string"), F.lit("%"))
    return F.when(page.isNotNull(), F.concat(F.lit("p."), page.cast("string"))).when((pos > 0) & (count > 1), share)


def frontmatter(text: Column) -> Column:
    """The ``key: value`` lines of a leading block between ``---`` lines as a map; empty without such a block."""
    block = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)^---\n(.*?)\n---\n", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(":") & ~x.startswith(" "))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(strip(x.substr(F.instr(x, ":") + 1, F.length(x))), '^"+|"+$', "").alias("v")))
    # The last of several equal keys counts.
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])
    return F.map_from_arrays(keys, values)


def body_after_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^---\n.*?\n---\n", "")


def has_sections(text: Column) -> Column:
    """Whether a line begins a numbered section."""
    return F.coalesce(text.rlike("(?m)^## Section [0-9]+"), F.lit(False))


def safe_filename(name: Column) -> Column:
    """``name`` without characters that file systems refuse, at most 200 characters."""
    return F.substring(collapse(F.regexp_replace(name, r'[<>:"/\\|?*]', "")), 1, 200)


def transcript_name(meta: Column, stem: Column) -> Column:
    """Title, presenter and date of a transcript; a placeholder date is left out, a missing title replaced by ``stem``."""

    def filled(key: str) -> Column:
        value = F.element_at(meta, F.lit(key))
        return F.when(value != "", value)

    date = filled("Lecture date")
    return F.concat_ws(" - ", F.coalesce(F.element_at(meta, F.lit("Title")), stem), filled("Presenter"), F.when(date != "1980-01-01", date))


def clean_transcript(body: Column) -> Column:
    """A transcript's body without separator lines, time stamps and superfluous blank lines."""
    out = F.regexp_replace(strip(body), "\n---\n", "\n\n")
    out = F.regexp_replace(out, rf"{SPACE}*\(\[[0-9:]+\]\)", "")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def is_skipped(name: Column) -> Column:
    """Whether an import leaves a file out by its name."""
    return name.rlike("(?i)test") | name.contains("HIPAA-Safe-Harbor")


def section_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?m)^## Section [0-9]+"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))


@F.pandas_udf(StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility-composed text without soft hyphens; null stays null."""
    for batch in texts:
        yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).replace("\xad", ""))
