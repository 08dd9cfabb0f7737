"""Code points, words and shingles of many texts at once, as numpy arrays inside a task."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the published splitmix64 finisher)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and the position where each text begins (with the total at the end)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])


def word_characters() -> np.ndarray:
    """For every code point whether it is a letter or number (Unicode categories L and N, which is what ``isalnum`` tells)."""
    if "words" not in _cache:
        _cache["words"] = np.fromiter(map(str.isalnum, map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1)
    return _cache["words"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the hash base and of its inverse, modulo 2^64."""
    if len(_cache.get("up", ())) <= n:
        size = max(n + 1, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _cache[name] = np.cumprod(steps, dtype=U)
    return _cache["up"], _cache["down"]


def prefix_sums(flat: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` gives the hash of any span of ``flat``."""
    up, _ = powers(len(flat))
    return np.concatenate([np.zeros(1, U), np.cumsum(mix(flat.astype(U) + U(1)) * up[: len(flat)], dtype=U)])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the code points in each ``[start, end)``, equal for equal spans wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def word_spans(flat: np.ndarray, begin: np.ndarray, also: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word (maximal run of letters, numbers and the characters ``also``), none across texts."""
    is_word = word_characters()[flat]
    for c in also:
        is_word |= flat == ord(c)
    edge = np.zeros(len(flat) + 1, bool)
    edge[begin] = True
    inner = is_word[1:] & is_word[:-1] & ~edge[1:-1]
    start = np.flatnonzero(is_word & ~np.concatenate([[False], inner])) if len(flat) else np.zeros(0, np.int64)
    end = np.flatnonzero(is_word & ~np.concatenate([inner, [False]])) + 1 if len(flat) else np.zeros(0, np.int64)
    return start, end


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word (maximal run of letters and numbers) of the texts as given, and the text it stands in."""
    flat, begin = code_points(texts)
    start, end = word_spans(flat, begin)
    return span_hash(prefix_sums(flat), start, end), np.searchsorted(begin, start, "right") - 1


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct sequences of ``words`` consecutive words of the lower-cased texts: hash and text number, ordered
    by both, and the number of words of each text."""
    hashed, of = word_hashes([t.lower() for t in texts])
    counts = np.bincount(of, minlength=len(texts))
    if len(hashed) < words:
        return np.zeros(0, U), np.zeros(0, np.int64), counts
    n = len(hashed) - words + 1
    joint = np.zeros(n, U)
    for k in range(words):
        joint = mix(joint + hashed[k : k + n])
    inside = of[:n] == of[words - 1 :]
    joint, of = joint[inside], of[:n][inside]
    order = np.lexsort((joint, of))
    joint, of = joint[order], of[order]
    new = np.ones(len(joint), bool)
    new[1:] = (joint[1:] != joint[:-1]) | (of[1:] != of[:-1])
    return joint[new], of[new], counts


#: Rows that one task gets of a shuffle by name, about 100 MB of them.
TASK_ROWS = 3_000_000


def parted(rows: DataFrame, column: str, amount: int) -> DataFrame:
    """``rows``, about ``amount``, partitioned by a column: in as many partitions as the session says or as their number needs."""
    needed = -(-amount // TASK_ROWS)
    more = needed > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(needed, column) if more else rows.repartition(column)


def packed_bits(bits: DataFrame, size: int) -> np.ndarray:
    """A map of ``size`` bits (a multiple of 32,768), packed from the least bit of each byte, with the bits of column ``bit``
    set. Spark puts it together in blocks of 4 KB."""
    place = F.col("bit") + 1
    blocks = bits.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    packed = np.zeros((size // 32768, 4096), np.uint8)
    for r in blocks.toLocalIterator():
        packed[r["block"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return packed.reshape(-1)
