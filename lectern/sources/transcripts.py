"""Import of sectioned transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X


def import_transcripts(df: DataFrame, stem: str = "stem", content: str = "content") -> DataFrame:
    """``stem, file_name, text, sections, words``: transcripts with numbered sections, cleaned, under the name made of their
    front matter. Others and null contents are left out."""
    body = X.body_after_frontmatter(F.col(content))
    rows = df.where(F.col(content).isNotNull() & X.has_sections(body)).select(F.col(stem).alias("stem"), X.frontmatter(F.col(content)).alias("m"), X.clean_transcript(body).alias("text"))
    name = F.concat(X.safe_filename(X.transcript_name(F.col("m"), F.col("stem"))), F.lit(".txt"))
    return rows.select("stem", name.alias("file_name"), "text", X.section_count(F.col("text")).alias("sections"), X.word_count(F.col("text")).alias("words"))
