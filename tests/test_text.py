from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.functions import text as X


def one(spark, expression, *values, schema="a string"):
    return spark.createDataFrame([tuple(values)], schema).select(expression.alias("x")).first()["x"]


def test_stems(spark):
    assert sorted(one(spark, X.stems(F.col("a")), "families")) == ["famili", "familie", "families", "family"]
    assert sorted(one(spark, X.stems(F.col("a")), "walked")) == ["walk", "walke", "walked"]
    assert one(spark, X.stems(F.col("a")), "as") == ["as"]


def test_occurrences(spark):
    assert one(spark, X.occurrences(F.col("a"), F.lit("aa")), "aaaa") == 2
    assert one(spark, X.occurrences(F.col("a"), F.lit("")), "aaaa") == 0


def test_badge_rounds_half_to_even(spark):
    assert one(spark, X.position_badge(F.lit(None).cast("int"), F.lit(1), F.lit(8)), "") == "~12%"
    assert one(spark, X.position_badge(F.lit(4), F.lit(1), F.lit(8)), "") == "p.4"
    assert one(spark, X.position_badge(F.lit(None).cast("int"), F.lit(1), F.lit(1)), "") is None


def test_frontmatter_and_name(spark):
    text = '---\nTitle: "A: B"\nPresenter: P\nLecture date: 1980-01-01\n x: indented\nTitle: "T"\n---\n## Section 1 – A\nb'
    meta = X.frontmatter(F.col("a"))
    assert one(spark, meta, text) == {"Title": "T", "Presenter": "P", "Lecture date": "1980-01-01"}
    assert one(spark, X.transcript_name(meta, F.lit("stem")), text) == "T - P"
    assert one(spark, X.transcript_name(meta, F.lit("stem")), "no block") == "stem"
    assert one(spark, X.frontmatter(F.col("a")), None) == {}
    assert one(spark, X.is_skipped(F.col("a")), "latest-yaml.md") is True


def test_clean_and_safe(spark):
    assert one(spark, X.clean_transcript(F.col("a")), "\n\nA ([00:00:00])\n---\nB\n\n\n\nC ") == "A\n\nB\n\nC"
    assert one(spark, X.safe_filename(F.col("a")), 'a<b>:"c  d|?*') == "abc d"
    assert one(spark, X.nfkc("a"), "ﬁ\xadx") == "fix"


def test_format_chunk(spark):
    assert one(spark, X.format_chunk(F.col("a"), F.lit("T")), "[T]\n\na\nb  c\n\n\n\n \n\nd") == "a b c\n\nd"


def test_first_rule_wins(spark):
    expression = rules.first_match(F.col("a"), [("src1", 3.0), ("src10", 1.3)], 1.0)
    assert one(spark, expression, "SRC10-x") == 3.0
    assert one(spark, expression, None) == 1.0
    table = spark.createDataFrame([(2, "b", 2.0), (1, "a", None), (3, None, 1.0)], "ord int, pattern string, multiplier double")
    assert rules.rule_list(table, "multiplier") == [("b", 2.0)]


def test_labels(spark):
    expression = X.score_label(F.lit("keyword"), F.lit(6.0), F.lit(3.0))
    assert one(spark, expression, "") == "2 hits ×3 ★"
    assert one(spark, X.score_label(F.lit("semantic"), F.lit(0.125), F.lit(1.0)), "") == "12%"
    assert one(spark, X.score_color(F.lit("x"), F.lit(0.2)), "") == "amber"
