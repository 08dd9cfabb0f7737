"""Sinks: indexes, embeddings, texts and evaluation results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.index import Weighted


#: Parts in which the rows of one term are written, so that no task has all rows of a term that stands everywhere.
TERM_PARTS = 8


def _by_term(rows: DataFrame) -> DataFrame:
    """Rows in files sorted by term, so that a search reads only the row groups of its terms."""
    return rows.repartition("term", F.pmod("id", F.lit(TERM_PARTS))).sortWithinPartitions("term", "id")


def save_index(chunks: DataFrame, models: dict[str, Weighted], path: str, words: DataFrame | None = None) -> None:
    """An index below ``path``: the chunk store, and for each named model its postings, vocabulary and number of chunks; with
    ``words (id, term, tf)`` also the plain postings that keyword search uses. Overwrites what is there."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    for name, model in models.items():
        _by_term(model.weights).write.mode("overwrite").parquet(f"{path}/{name}/weights")
        model.vocabulary.withColumn("n", F.lit(model.n).cast("bigint")).write.mode("overwrite").parquet(f"{path}/{name}/vocabulary")
    if words is not None:
        _by_term(words).write.mode("overwrite").parquet(f"{path}/words")


def build_embeddings(chunks: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> DataFrame:
    """``chunk_id, embedding``: one vector a chunk by a pluggable encoder, which is made once a task."""

    @F.pandas_udf("array<float>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for series in texts:
            values = series.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(values), batch) for v in model(values[i : i + batch])])

    return chunks.select(F.col("id").alias("chunk_id"), encode("text").alias("embedding"))


def text_files(transcripts: DataFrame) -> DataFrame:
    """``file_name, text, copies``: one file a name; of several transcripts with one name the last path counts."""
    return transcripts.groupBy("file_name").agg(F.max_by("text", "path").alias("text"), F.count("*").alias("copies"))


def write_texts(files: DataFrame, path: str, dry_run: bool = False) -> int | None:
    """One text file for each row ``(file_name, text)``, written by the tasks into a folder they share. A dry run writes nothing
    and gives the number of files."""
    if dry_run:
        return files.count()

    def write(rows) -> None:
        import os

        os.makedirs(path, exist_ok=True)
        for r in rows:
            with open(os.path.join(path, r["file_name"]), "w", encoding="utf-8") as f:
                f.write(r["text"] or "")

    files.select("file_name", "text").foreachPartition(write)


def write_results(results: DataFrame, path: str) -> None:
    """Evaluation results as JSON lines."""
    results.write.mode("overwrite").text(path) if results.columns == ["value"] else results.write.mode("overwrite").json(path)
