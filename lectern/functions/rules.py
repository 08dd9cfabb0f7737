"""Ordered pattern rules over document names: the first pattern contained in the name, whatever its case, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules become one expression, so their number is bounded.
MOST_RULES = 2_000


def rule_list(rules: DataFrame, value: str) -> list[tuple[str, object]]:
    """The rules ``(pattern, value)`` in the order of column ``ord``. Rules without pattern or value are left out."""
    rows = rules.where(F.col("pattern").isNotNull() & F.col(value).isNotNull()).orderBy("ord").select("pattern", value).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [(r[0], r[1]) for r in rows]


def first_match(name: Column, rules: list[tuple[str, object]], default: object) -> Column:
    """The value of the first rule whose pattern the name contains; ``default`` without one or for a null name."""
    low, out = F.lower(name), F
    for pattern, value in rules:
        out = out.when(F.contains(low, F.lit(pattern.lower())), F.lit(value))
    return out.otherwise(F.lit(default)) if rules else F.lit(default)


def named(docs: DataFrame, tiers: list | None = None, authors: list | None = None) -> DataFrame:
    """``doc_name, boost, author`` of the distinct names of ``docs``; the rules are applied once a name, not once a row."""
    names = docs.select("doc_name").where("doc_name is not null").distinct()
    return names.select("doc_name", first_match(F.col("doc_name"), tiers or [], 1.0).cast("double").alias("boost"), first_match(F.col("doc_name"), authors or [], "Unknown").alias("author"))


def known_authors(rules: DataFrame) -> DataFrame:
    """``author, ord``: every author once, with the place of their first rule."""
    return rules.where("author is not null").groupBy("author").agg(F.min("ord").alias("ord"))
