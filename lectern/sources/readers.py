"""Readers of raw documents, stored tables and rule files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions.text import is_skipped
from lectern.operators.index import Weighted
from lectern.sources import schemas


def decode(data: bytes) -> str:
    """Text of a file whose encoding isn't known: UTF-8, else UTF-16, also damaged if it begins with its mark, else Latin-1."""
    for codec in ("utf-8", "utf-16"):
        try:
            return data.decode(codec)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-16", "replace") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else data.decode("latin-1")


@F.pandas_udf(StringType())
def _decoded(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in contents:
        yield batch.map(lambda b: None if b is None else decode(bytes(b)))


def _files(spark: SparkSession, path: str, glob: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")


def _stem(path: str = "path"):
    return F.regexp_replace(F.url_decode(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\+", "%2B")), r"\.[^.]*$", "")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``kind, path, doc_name, content`` of the ``*.txt`` files of one folder."""
    return _files(spark, path, "*.txt", False).select(F.lit("txt").alias("kind"), "path", _stem().alias("doc_name"), _decoded("content").alias("content"))


def read_pdfs(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """``kind, path, doc_name, content`` of the ``*.pdf`` files of one folder, pages marked ``[PDF_PAGE:n]``.

    ``extract`` gives the texts of a file's pages; no PDF library is bundled. Blank pages are left out, files without
    text too."""

    @F.pandas_udf(StringType())
    def marked(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in contents:
            yield batch.map(lambda b: "\n".join(f"[PDF_PAGE:{n}]{t}" for n, t in enumerate(extract(bytes(b)), 1) if t.strip()))

    rows = _files(spark, path, "*.pdf", False).select(F.lit("pdf").alias("kind"), "path", _stem().alias("doc_name"), marked("content").alias("content"))
    return rows.where("content != ''")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``path, stem, content`` of all ``*yaml.md`` files below a folder but those left out by their names."""
    rows = _files(spark, path, "*yaml.md", True).select("path", _stem().alias("stem"), F.col("content").cast("string").alias("content"))
    return rows.where(~is_skipped(F.element_at(F.split("path", "/"), -1)))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A chunk store, Parquet or a JSON array by its name; fields that an older build lacks are null. A missing path raises."""
    if path.endswith(".json"):
        return spark.read.schema(schemas.CHUNK).json(path, multiLine=True)
    return spark.read.schema(schemas.CHUNK).parquet(path)


def load_model(spark: SparkSession, path: str, name: str) -> Weighted:
    """A model of an index written by ``save_index``. A missing index raises; one of an empty store has no vocabulary and ``n`` 0."""
    vocabulary = spark.read.parquet(f"{path}/{name}/vocabulary")
    first = vocabulary.select("n").first()
    return Weighted(spark.read.parquet(f"{path}/{name}/weights"), vocabulary.drop("n"), first["n"] if first else 0)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk store of an index."""
    return spark.read.parquet(f"{path}/chunks")


def load_words(spark: SparkSession, path: str) -> DataFrame:
    """The plain postings of an index."""
    return spark.read.parquet(f"{path}/words")


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of an ``evals.json`` file."""
    from pyspark.sql.types import ArrayType, StructField, StructType

    wrapped = StructType([StructField("evals", ArrayType(schemas.EVAL_CASE))])
    return spark.read.schema(wrapped).json(path, multiLine=True).select(F.explode("evals").alias("e")).select("e.*")


def parse_rules(text: str, value: str) -> list[dict[str, str]]:
    """The entries of a rule file: a list of ``- pattern: ...`` items with further ``key: value`` lines.

    Comments, quotes and blank lines are understood, nothing else of YAML is. An entry without ``pattern`` or ``value`` raises.
    """
    entries: list[dict[str, str]] = []
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("#") or ":" not in line:
            continue
        new, line = line.startswith("- "), line.removeprefix("- ")
        key, _, rest = line.partition(":")
        rest = rest.strip()
        if rest[:1] in "\"'" and rest[:1] and rest.find(rest[0], 1) > 0:
            rest = rest[1 : rest.find(rest[0], 1)]
        else:
            rest = rest.split(" #")[0].strip()
        if new:
            entries.append({})
        if entries and rest:
            entries[-1][key.strip()] = rest
    for e in entries:
        if "pattern" not in e or value not in e:
            raise ValueError(f"a rule needs pattern and {value}: {e}")
    return entries


def read_rules(spark: SparkSession, path: str, value: str, default: list[tuple[str, object]] = ()) -> DataFrame:
    """``ord, pattern, value`` of a rule file on the driver (a small configuration file); ``default`` where there is none."""
    schema = schemas.TIER if value == "multiplier" else schemas.AUTHOR
    try:
        with open(path, encoding="utf-8") as f:
            rules = [(e["pattern"], e[value]) for e in parse_rules(f.read(), value)]
    except FileNotFoundError:
        rules = list(default)
    cast = float if value == "multiplier" else str
    return spark.createDataFrame([(k, p, cast(v)) for k, (p, v) in enumerate(rules, 1)], schema)
