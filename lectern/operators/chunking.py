"""Documents into chunks: by section where a text has numbered sections, else by packed sentences with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.common import materialize, spread
from lectern.functions.text import NOT_SPACE, SPACE, has_sections, strip

_HEADING = r"\n(## Section [0-9]+ – [^\n]+)\n"


def _sections(text: Column) -> Column:
    """``array<struct<section_title, text, page>>``: a chunk for each section with a body; see ``section_chunks``."""
    parts = F.split(F.regexp_replace(text, _HEADING, "\x01$1\x02"), "\x01")

    def chunk(part: Column) -> Column:
        body = strip(part.substr(F.instr(part, "\x02") + 1, F.length(part)))
        title = F.regexp_replace(F.substring_index(part, "\x02", 1), r"^## Section [0-9]+ – ", "")
        title = F.regexp_replace(strip(F.regexp_replace(title, rf"{SPACE}*\(\[[0-9:]+\]\)", "")), r"\.$", "")
        whole = F.when(body != "", F.concat(F.lit("["), title, F.lit("]\n\n"), body))
        return F.struct(title.alias("section_title"), whole.alias("text"), F.lit(None).cast("int").alias("page"))

    return F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), chunk), lambda c: c["text"].isNotNull())


def section_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, seq, section_title, text``: a chunk for each section with a body, numbered from 0.

    A heading counts if a line break stands before and after it, so text before the first such heading is dropped,
    a heading at the very start is none, and of two headings in a row the second is body of the first. The title is
    the heading without its number, time stamp and final dot. Texts without such headings and null texts give none.
    """
    return df.select(F.col(key), F.posexplode(_sections(F.col(text))).alias("seq", "c")).select(key, "seq", "c.section_title", "c.text")


def sentences(text: Column) -> Column:
    """``array<struct<text, page>>``: the sentences of a text in order, kept as they stand; blank ones are left out.

    ``[PDF_PAGE:n]`` markers begin a page; sentences don't run across them. Text before the first marker has no page.
    """
    marker = r"\[PDF_PAGE:([0-9]+)\]"
    pages = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.lit(marker), F.lit(1)))
    parts = F.arrays_zip(F.split(text, marker).alias("part"), pages.alias("page"))
    split = F.transform(parts, lambda p: F.transform(F.filter(F.split(p["part"], f"(?<=[.!?]){SPACE}+"), lambda s: s.rlike(NOT_SPACE)), lambda s: F.struct(s.alias("text"), p["page"].cast("int").alias("page"))))
    return F.flatten(split)


def packed_intervals(lengths: Column, size: int = 1500, overlap: int = 200) -> Column:
    """``array<struct<s, e>>``: which sentences, given by their lengths, go into each chunk (0-based, inclusive).

    A fold over the lengths. Its state holds the next sentence ``i``, the chunk's first one ``s``, the chunk's size
    so far and the latest lengths that fit the overlap, so the start of the next chunk is known without looking back.
    """

    def fitting(tail: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("go"), F.array().cast("array<int>").alias("kept"))

        def step(acc: Column, n: Column) -> Column:
            ok = acc["go"] & (acc["sum"] + n < overlap)
            return F.struct(F.when(ok, acc["sum"] + n + 1).otherwise(acc["sum"]).alias("sum"), ok.alias("go"), F.when(ok, F.concat(F.array(n), acc["kept"])).otherwise(acc["kept"]).alias("kept"))

        return F.aggregate(F.reverse(tail), start, step)["kept"]

    def merge(acc: Column, n: Column) -> Column:
        full = (acc["i"] > acc["s"]) & (acc["cur"] + n + 1 > size)
        k = F.least(F.size(acc["tail"]), acc["i"] - acc["s"])
        carried = F.slice(acc["tail"], F.size(acc["tail"]) - k + 1, k)
        carried_size = F.aggregate(carried, F.lit(0), lambda a, b: a + b) + k
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(full, acc["i"] - k).otherwise(acc["s"]).alias("s"),
            F.when(full, carried_size + n + 1).otherwise(acc["cur"] + n + F.when(acc["cur"] != 0, 1).otherwise(0)).alias("cur"),
            fitting(F.concat(acc["tail"], F.array(n))).alias("tail"),
            F.when(full, F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), (acc["i"] - 1).alias("e"))))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(0).alias("cur"), F.array().cast("array<int>").alias("tail"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def finish(acc: Column) -> Column:
        return F.when(acc["i"] > acc["s"], F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), (acc["i"] - 1).alias("e"))))).otherwise(acc["out"])

    return F.aggregate(lengths, start, merge, finish)


def _packs(found: Column, size: int, overlap: int) -> Column:
    """``array<struct<section_title, text, page>>`` of packed sentences; see ``sentence_chunks``."""

    def chunk(i: Column) -> Column:
        text = strip(F.array_join(F.transform(F.slice(found, i["s"] + 1, i["e"] - i["s"] + 1), lambda s: s["text"]), " "))
        return F.struct(F.lit("").alias("section_title"), text.alias("text"), F.get(found, i["s"])["page"].alias("page"))

    return F.transform(packed_intervals(F.transform(found, lambda s: F.length(s["text"])), size, overlap), chunk)


def sentence_chunks(df: DataFrame, key: str, text: str, size: int = 1500, overlap: int = 200) -> DataFrame:
    """``key, seq, text, page``: packs of whole sentences of about ``size`` characters that share up to ``overlap``
    characters of whole sentences with the pack before. A longer sentence is a chunk of its own. The page is that
    of the first sentence. Null, empty and blank texts give no chunk."""
    rows = df.select(key, sentences(F.col(text)).alias("_s")).where(F.size("_s") > 0)
    return rows.select(key, F.posexplode(_packs(F.col("_s"), size, overlap)).alias("seq", "c")).select(key, "seq", "c.text", "c.page")


def chunk_arrays(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1500, overlap: int = 200) -> DataFrame:
    """``key, chunks array<struct<section_title, text, page>>``: every document with its chunks, by section if it has one,
    else by sentences. A text whose only headings lack the dash after the number counts as sectioned and has no chunk."""
    sectioned = has_sections(F.col(text))
    rows = spread(df).select(key, F.when(sectioned, _sections(F.col(text))).alias("_sections"), F.when(~sectioned, sentences(F.col(text))).alias("_s"))
    return rows.select(key, F.coalesce("_sections", _packs(F.col("_s"), size, overlap), F.array().cast("array<struct<section_title:string,text:string,page:int>>")).alias("chunks"))


def chunk_documents(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1500, overlap: int = 200) -> DataFrame:
    """``key, seq, section_title, text, page``: the chunks of ``chunk_arrays``, one row each, numbered from 0."""
    return chunk_arrays(df, key, text, size, overlap).select(key, F.posexplode("chunks").alias("seq", "c")).select(key, "seq", "c.section_title", "c.text", "c.page")


def chunk_table(df: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "kind", path: str = "path", doc_name: str = "doc_name") -> DataFrame:
    """The chunk store of ``df``: ``id, doc_name, section_title, text, char_count, page, chunk_pos, doc_chunk_count, preview``.

    Ids run from 0 in load order: text files before PDF files, each by path (null paths first) and key, then in the
    document. Positions count the chunks of one ``doc_name``, also where several documents share it. Only the documents'
    keys and their numbers of chunks are sorted and counted; no task holds all documents of a name, and texts are at most
    joined with the outcome. Keys must be unique.
    """
    order = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(doc_name).alias("doc_name"), (F.col(kind) == "pdf").cast("int").alias("_kind"), F.col(path).alias("_path"))
    made = materialize(chunk_arrays(order, "_key", "_text").join(order.drop("_text"), "_key"))
    docs = made.select("_key", "doc_name", "_kind", "_path", F.size("chunks").alias("_n")).where("_n > 0")
    first = running_total(docs, ["_kind", "_path", "_key"], "_n", "_first").select("_key", "_first")
    named = running_total(docs, ["doc_name", "_kind", "_path", "_key"], "_n", "_upto").select("_key", "doc_name", "_n", "_upto")
    names = materialize(named.groupBy("doc_name").agg(F.min("_upto").alias("_begin"), F.sum("_n").alias("_count")))
    placed = named.join(names, named["doc_name"].eqNullSafe(names["doc_name"])).select("_key", (F.col("_upto") - F.col("_begin")).alias("_before"), "_count")
    rows = made.join(materialize(first.join(placed, "_key")), "_key").select("doc_name", "_first", "_before", "_count", F.posexplode("chunks").alias("_k", "c"))
    return rows.select(
        (F.col("_first") + F.col("_k")).alias("id"),
        "doc_name",
        "c.section_title",
        "c.text",
        F.length("c.text").alias("char_count"),
        "c.page",
        (F.col("_before") + F.col("_k") + 1).cast("int").alias("chunk_pos"),
        F.col("_count").cast("int").alias("doc_chunk_count"),
        F.concat(F.substring("c.text", 1, 150), F.lit("...")).alias("preview"),
    )


def _sorted_by_range(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in the given order over all partitions, written once, with ``_part`` and the place ``_at`` in it."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return materialize(ordered).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))


def _with_offsets(rows: DataFrame, amount: Column, offset: str) -> DataFrame:
    """``rows`` with what all partitions before hold of ``amount``; one number for each partition reaches the driver."""
    before, offsets = 0, []
    for r in rows.groupBy("_part").agg(amount.alias("n")).orderBy("_part").toLocalIterator():
        offsets.append((r["_part"], before))
        before += r["n"]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(offsets, f"_part bigint, {offset} bigint")), "_part")


def with_global_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with a consecutive number from 0 in the given order: rows are sorted by range and counted per partition.

    The order must be total. Rows are shuffled once.
    """
    rows = _with_offsets(_sorted_by_range(df, order), F.count("*"), "_offset")
    return rows.withColumn(name, F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset")


def running_total(df: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows before, in the given order, which must be total."""
    rows = _with_offsets(_sorted_by_range(df, order), F.sum(amount), "_offset")
    before = F.sum(amount).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.coalesce(before, F.lit(0)) + F.col("_offset")).drop("_part", "_at", "_offset")
