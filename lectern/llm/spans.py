"""Long spans that stand verbatim in more than one text, by recompression.

Rounds of recompression rename the texts: a run of one symbol becomes a symbol, and a pair of symbols becomes a
symbol if a coin that every symbol carries in that round says left for the first and right for the second. Names
are hashes of what they stand for, so all tasks name equal pairs and runs alike without exchanging a dictionary, and
two copies of a span are renamed alike except for a margin at their ends. The sizes of symbols are bounded in every
round, which bounds the margin. The starts of the resulting symbols, thinned to the least name of every window,
are anchors: any shared span of the wanted length holds one, and the text around it, in every copy. Spark groups
the anchors' surroundings by name; those that occur in two texts mark the only places where a shared span can be,
and there all windows of the wanted length are named and grouped in the same way, which settles them exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.common import materialize, small_batches, spread
from lectern.llm.points import U, code_points, mix, parted, prefix_sums, span_hash

#: Names that stand so often in a sample of so many texts, under two ids at least, are known to be shared beforehand, up to
#: so many of them: those of a notice that stands in a large part of all texts.
SAMPLE_TEXTS, HOT_TIMES, HOT_NAMES = 20_000, 8, 1 << 17
#: Names expected of a text, by which the number of partitions is chosen.
NAMES_EACH = 60


def rounds_for(length: int) -> tuple[list[int], int, int, int]:
    """Bounds of the symbol sizes by round, how far an anchor must be from the start and from the end of a copy, and
    how many places that leaves it: the width of the window of which the anchor is the least."""
    caps: list[int] = []
    while True:
        more = [*caps, 2 << len(caps)]
        margin = sum(2 * c - 1 for c in more)
        if length - 2 * margin - more[-1] < max(more[-1], length // 3):
            margin = sum(2 * c - 1 for c in caps)
            after = margin + caps[-1] if caps else (length + 1) // 2
            return caps, margin, after, length - margin - after + 1
        caps = more


def recompress(flat: np.ndarray, begin: np.ndarray, caps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the symbols of all texts after the rounds, and their start positions."""
    name, start = mix(flat.astype(U) + U(11)), np.arange(len(flat))
    size = np.ones(len(flat), np.int64)
    head = np.zeros(len(flat), bool)
    head[begin[:-1][np.diff(begin) > 0]] = True
    for turn, cap in enumerate(caps, 1):
        same = np.concatenate([[False], (name[1:] == name[:-1]) & ~head[1:]])
        if same.any():
            first = np.flatnonzero(~same)
            times = np.diff(np.append(first, len(name)))
            joined = (times > 1) & (times * size[first] <= cap)
            name[first[joined]] = mix(name[first[joined]] + times[joined].astype(U) * U(0xD1B54A32D192ED03) + U(turn))
            size[first[joined]] *= times[joined]
            keep = ~(same & np.repeat(joined, times))
            name, start, size, head = name[keep], start[keep], size[keep], head[keep]
        left = (mix(name ^ U(turn * 0x2545F491)) & U(1)).astype(bool)
        pair = np.flatnonzero(left[:-1] & ~left[1:] & ~head[1:] & (size[:-1] + size[1:] <= cap))
        name[pair] = mix(mix(name[pair] + U(turn)) + name[pair + 1])
        size[pair] += size[pair + 1]
        keep = np.ones(len(name), bool)
        keep[pair + 1] = False
        name, start, size, head = name[keep], start[keep], size[keep], head[keep]
    return name, start


def _sliding(x: np.ndarray, width: int, least: np.ufunc, fill) -> np.ndarray:
    """``least`` over ``x[i : i + width]`` for every i; ``fill`` stands after the end."""
    blocks = -(-(len(x) + width) // width)
    padded = np.full(blocks * width, fill, x.dtype)
    padded[: len(x)] = x
    table = padded.reshape(blocks, width)
    before = least.accumulate(table, axis=1).ravel()
    after = least.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return least(after[: len(x)], before[width - 1 : width - 1 + len(x)])


def anchors(flat: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """Positions such that the copies of every span of ``length`` hold the same ones, one at least, at a distance of
    at least the margin from either end."""
    caps, _, _, width = rounds_for(length)
    name, start = recompress(flat, begin, caps)
    top = np.iinfo(np.uint64).max
    dense = np.full(len(flat), top, U)
    dense[start] = np.minimum(name, U(top - 1))
    lowest = _sliding(dense, width, np.minimum, top)
    highest = _sliding(lowest[::-1], width, np.maximum, 0)[::-1]
    return start[dense[start] == highest[start]]


def _named(name: np.ndarray, ids: pa.Array, pos: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """``name, id, pos`` of the places with these names. A place whose name is known to be shared needs no other to be found:
    its position is given as ``-1 - pos`` and its name is replaced by one of its own, so that such places spread evenly."""
    if len(hot) and len(name):
        known = hot[np.minimum(np.searchsorted(hot, name), len(hot) - 1)] == name
        own = mix(mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(U)) + pos.astype(U))
        name, pos = np.where(known, own, name), np.where(known, -1 - pos, pos)
    return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), ids, pa.array(pos.astype(np.int32))], names=["name", "id", "pos"])


def _seeds(docs: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """``name, id, pos``: a hash of the surroundings of every anchor, as long as they lie within every copy."""
    _, margin, after, _ = rounds_for(length)
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for batch in small_batches(batches, 4_000_000):
            flat, begin = code_points(batch.column(1).to_pylist())
            if not len(flat):
                continue
            at = anchors(flat, begin, length)
            of = np.searchsorted(begin, at, "right") - 1
            inside = (at - margin >= begin[of]) & (at + after <= begin[of + 1])
            at, of = at[inside], of[inside]
            seed = span_hash(prefix_sums(flat), at - margin, at + after)
            yield _named(seed, batch.column(0).take(pa.array(of)), at - begin[of], shared.value)

    return docs.mapInArrow(run, "name bigint, id bigint, pos int")


def _windows(docs: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """``name, id, pos``: a hash of every window of ``length`` that holds one of the marked places ``at`` of its text."""
    _, margin, after, _ = rounds_for(length)
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for batch in small_batches(batches, 2_000_000):
            flat, begin = code_points(batch.column(1).to_pylist())
            lists = batch.column(2)
            of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = lists.flatten().to_numpy() + begin[of]
            low, high = np.maximum(at + after - length, begin[of]), np.minimum(at - margin, begin[of + 1] - length) + 1
            low, high = low[high > low], high[high > low]
            step = np.zeros(len(flat) + 2, np.int64)
            np.add.at(step, low, 1)
            np.add.at(step, high, -1)
            start = np.flatnonzero(np.cumsum(step[:-1]) > 0)
            of = np.searchsorted(begin, start, "right") - 1
            name = span_hash(prefix_sums(flat), start, start + length)
            yield _named(name, batch.column(0).take(pa.array(of)), start - begin[of], shared.value)

    return docs.mapInArrow(run, "name bigint, id bigint, pos int")


def _hot_names(docs: DataFrame, share: float, length: int, name_places) -> np.ndarray:
    """Ascending names that ``name_places`` finds often in a sample of the texts, under two ids. They are surely shared."""
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))) if share < 1 else docs
    often = name_places(sample, length, np.zeros(0, U)).groupBy("name").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
    top = often.where((F.col("a") < F.col("b")) & (F.col("n") >= HOT_TIMES)).orderBy(F.desc("n"), "name").limit(HOT_NAMES)
    return np.sort(top.select("name").toPandas()["name"].to_numpy(np.int64).view(U))


def _in_two(named: DataFrame, amount: int) -> DataFrame:
    """The rows whose name occurs under two ids, or is known to. No name's rows are gathered.

    The rows are made and shuffled once for both uses: the conditions that always hold keep their columns and
    filters alike, so that Spark reuses the exchange.
    """
    rows = parted(named.where("name is not null and id is not null and pos is not null"), "name", amount)
    both = rows.groupBy("name").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("pos").alias("p"))
    shared = both.where("a < b or p < 0").select("name")
    return rows.join(shared, "name").select("id", F.when(F.col("pos") < 0, -1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"))


def shared_spans(df: DataFrame, key: str = "id", text: str = "text", length: int = 200) -> DataFrame:
    """``key, span_start, span_end``: the longest runs of positions of a text that lie in stretches of at least
    ``length`` characters standing verbatim in the text of another key; overlapping or touching stretches form one run.

    Positions are 0-based code points of the text as stored. Null keys, null texts and texts shorter than ``length``
    have no spans; a repetition within one text alone isn't shared; a key stored twice (with the same text) counts
    once. Other columns are ignored. Exact up to collisions of 64-bit hashes.
    """
    if length < 1:
        raise ValueError("length must be positive")
    docs = spread(df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).where(F.col(key).isNotNull() & (F.length(text) >= length)))
    texts = df.count()
    share = min(1.0, SAMPLE_TEXTS / max(texts, 1))
    marks = _in_two(_seeds(docs, length, _hot_names(docs, share, length, _seeds)), texts * NAMES_EACH).groupBy("id").agg(F.collect_set("pos").alias("at"))
    marked = docs.join(marks, "id").groupBy("id").agg(F.first("t").alias("t"), F.first("at").alias("at"))
    marked = materialize(marked)
    starts = _in_two(_windows(marked, length, _hot_names(marked, share, length, _windows)), texts * NAMES_EACH).distinct()
    by_pos = Window.partitionBy("id").orderBy("pos")
    runs = starts.withColumn("new", F.coalesce(F.col("pos") > F.lag("pos").over(by_pos) + length, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(by_pos)).groupBy("id", "run").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    return runs.select(F.col("id").alias(key), F.col("a").cast("bigint").alias("span_start"), (F.col("b") + length).cast("bigint").alias("span_end"))


def shared_amount(df: DataFrame, key: str = "id", text: str = "text", length: int = 200) -> DataFrame:
    """``key, shared, share``: for every text (also those without spans) the number and share of its shared characters."""
    docs = df.select(F.col(key), F.length(text).alias("_n")).where(F.col(key).isNotNull()).groupBy(key).agg(F.max("_n").alias("_n"))
    spans = shared_spans(df, key, text, length).groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    amount = F.coalesce("shared", F.lit(0))
    return docs.join(spans, key, "left").select(key, amount.alias("shared"), F.when(F.col("_n") > 0, amount / F.col("_n")).otherwise(0.0).alias("share"))
