"""Byte-level BPE encoding by a depth-first walk over the trie of distinct words.

In BPE the encoding of a prefix is fixed by its last token: the encoding of ``w`` is the encoding of ``w`` without
its last token, followed by that token, and a token may follow another exactly if the two are what BPE makes of
their joined bytes. So every trie node needs one state, its last token, found from the states of its ancestors.
Walking the sorted distinct words depth first keeps the states of the current path on a stack; the states of a
prefix that neighbours share are computed once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.common import small_batches, spread

#: Fixed value: the published split pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words a worker remembers between batches, bytes of the longest word among them, and pairs of tokens known to fit; beyond,
#: the memory starts anew.
MEMORY_WORDS, MEMORY_BYTES, MEMORY_PAIRS = 400_000, 64, 2_000_000


class TrieEncoder:
    """Encodes sets of words, sharing the work on common prefixes. ``ranks``: token bytes to id, in merge order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.word_of = {i: t for t, i in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}  # cleared with the words a worker remembers
        # Lengths that any token ending in a byte pair can have: few, so most suffixes are never looked up.
        ends: dict[bytes, set[int]] = {}
        for t in ranks:
            ends.setdefault(t[-2:], set()).add(len(t))
        self.lengths = {k: sorted(v, reverse=True) for k, v in ends.items()}

    def _merged(self, data: bytes) -> list[int]:
        """Plain BPE: join the neighbours of lowest rank until none can be joined."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand after ``left``; ``left`` -1 is the start of a word."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = self._merged(self.word_of.get(left, b"") + self.word_of[right]) == ([right] if left < 0 else [left, right])
            self.fits[key] = known
        return known

    def encode_all(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its ids, in sorted order."""
        last, size = [-1], [0]
        before = b""
        for word in sorted(set(words)):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                options = self.lengths.get(word[end - 2 : end], ()) if end > 1 else (1,)
                for n in (*options, 1):
                    if n <= end and (token := self.ranks.get(word[end - n : end])) is not None and self.follows(last[end - n], token):
                        last.append(token)
                        size.append(n)
                        break
            before = word
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= size[at]
            yield word, ids[::-1]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}


_workers: dict[str, tuple] = {}


def _worker(path: str) -> tuple:
    """Encoder, word memory and splitter of this Python worker."""
    if path not in _workers:
        import regex

        _workers[path] = (TrieEncoder(load_ranks(path)), {}, regex.compile(PATTERN).findall)
    return _workers[path]


def encode_texts(texts: list[str | None], path: str = VOCAB) -> list[list[list[int]]]:
    """For each text the ids of its words, in order; none for an empty or null text."""
    encoder, memory, split = _worker(path)
    if len(memory) > MEMORY_WORDS or len(encoder.fits) > MEMORY_PAIRS:
        memory.clear()
        encoder.fits.clear()
    words = [split(t) if t else [] for t in texts]
    new = {w.encode("utf-8", "surrogatepass"): w for w in set().union(*words).difference(memory)}
    memory.update((new[w], ids) for w, ids in encoder.encode_all(list(new)))
    out = [list(map(memory.__getitem__, ws)) for ws in words]
    for w in new.values():
        if len(w) > MEMORY_BYTES:
            del memory[w]
    return out


def _lists(rows: list[list[list[int]]]) -> pa.ListArray:
    sizes = np.fromiter((sum(map(len, row)) for row in rows), np.int64, len(rows))
    flat = np.fromiter((i for row in rows for word in row for i in word), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = VOCAB) -> DataFrame:
    """``key, ids``: the token ids of every row's text, without special tokens, one row for each row of ``df``.

    Null and empty texts give an empty list. Strings that look like special tokens are ordinary text. A null key
    is kept, repeated rows come out as often as they went in, other columns are ignored. Nothing is shuffled; a
    task holds one Arrow batch and its worker's bounded word memory. ``vocab`` must be readable on the executors.
    """

    def run(batches):
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(encode_texts(batch.column(1).to_pylist(), vocab))], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(df[key].alias("key"), df[text].alias("text")))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = VOCAB) -> DataFrame:
    """``key, n_tokens`` for every row; 0 for null and empty texts."""

    def run(batches):
        for batch in small_batches(batches):
            counts = [sum(map(len, row)) for row in encode_texts(batch.column(1).to_pylist(), vocab)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["key", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(df[key].alias("key"), df[text].alias("text")))
    return rows.mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)
