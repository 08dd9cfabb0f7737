"""Keyword-stuffed pages, link lists and tag lists, found by how regularly their terms recur.

Prose repeats its words at irregular and long distances. Stuffed pages repeat whole phrases after two to four
words, or whole sentences and rows of keywords at an even distance, again and again. The first pass compares the
sequence of word pairs of every document with itself at short lags (a positional autocorrelation over a lag window) and
takes the spread of the gaps between equal pairs at longer ones; where a noticeable share of the words recurs so, the text
is unnaturally regular and its recurring pairs mark it, and are candidates for other texts. The second pass counts for
each candidate, over all documents, how many contain it at all: a stuffing phrase is one that recurs tightly wherever it
occurs, unlike an idiom or an interjection. Candidates and phrases are tables; a bit map of fixed size only spares what
can't meet them in the join. The third pass marks in every document the words of such phrases and the links and their
markup, joins marks that stand a few words apart (words between two marks are fields of a catalogue entry or the
filling of a sentence built around the phrase), and compares the marked part with the whole. Paragraphs that are lists
of varied short items with hardly a function word are marked too, whatever the other texts hold.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.common import materialize, small_batches, spread
from lectern.llm.points import code_points, packed_bits, prefix_sums, span_hash, word_spans

#: Distances in words between the starts of two equal word pairs that count as tight.
LAGS = (2, 3, 4)
#: A text is unnaturally regular if this share of its words lies in pairs that recur tightly.
REGULAR = 0.2
#: Longer cycles: a pair recurs evenly if it stands in a text so often, at gaps of at most so many words on average that
#: spread by at most this share of it. A text is regular too if this share of its words lies in such pairs and at most half
#: of these are function words.
CYCLE_TIMES, CYCLE, CYCLE_SPREAD, CYCLE_SHARE, CYCLE_FUNCTION = 3, 48, 0.3, 0.7, 0.5
#: One word said over and over, more than half of a text of so many words, is a search word; shorter ones are interjections.
RUN_WORDS, RUN_LETTERS = 6, 3
#: A pair or word is a stuffing phrase of other texts if it recurs in regular texts in this share of the documents that
#: contain it, and there are so many such texts, whatever the size of the table.
PHRASE_SHARE, PHRASE_TEXTS = 0.15, 2
#: A pair marks its own text if it stands there tightly so often; once repeated may be chance in a short text.
OWN_TIMES = 3
#: Bits of the map of phrases. More phrases only let more through to the exact join.
PHRASE_BITS = 1 << 24
#: Unmarked words between two marks that still belong to the marked stretch, and at either end of a text.
GLUE, EDGE = 8, 4
#: Share of the text (without white space) that must be marked.
SHARE = 0.5
#: A list of terms: so many words and items at least, most words in items of at most so many words, so few function words
#: and words with digits, so many distinct items.
LIST_WORDS, LIST_ITEMS, ITEM_WORDS, IN_ITEMS = 12, 8, 4, 0.6
FUNCTION_SHARE, DIGIT_SHARE, DISTINCT_SHARE = 0.1, 0.3, 0.5
#: A text more than half of which is such a list holds no larger share of function words.
MOST_FUNCTION = 0.35
#: Function words of the languages of the documents.
FUNCTION_WORDS = frozenset(
    """the of and to in a is that it for was on with as be by at from are this not or have an they which were had but we his her
    she he i you their there been has would will who when what no if
    der die das und zu den von mit ist des auf für im dem nicht ein eine als auch es er sie war wie bei oder nach aus sich wird hat daß dass um so ich
    le la les de du et à un une en est que qui dans pour par sur pas au il elle se ce sont avec plus ou ne son sa ses était
    el los las y del por con para su al lo como más o fue""".split()
)

#: Stands for the missing follower in the code of a word alone.
ALONE = 0xFFFFFFFF
_WORD = re.compile(r"\w+")
_LINK = re.compile(r"#[^\W\d]\w+|<[^<>]{0,300}>|\]\([^()\s]*\)|(?:https?://|www\.)[^\s<>()\[\]|,;]+|[\w-]+(?:\.[\w-]+)*\.(?:[a-z]{2,})/[^\s<>()\[\]|,;]*")


_ITEM = re.compile(r"[,;|/>•·:=\t\n]+")
#: Lines that belong to a reference list, an index or contents table, or a transcript.
_REFERENCE = re.compile(r"\(\d{4}[a-z]?\)|\b\d+\s*:\s*\d+\s*[-–]\s*\d+|\b(?:1[5-9]|20)\d\d\b\S?\s*\d+\s*\(\d+\)")
_ENTRY = re.compile(r"(?:[,\t]|\.{2,}|\s{2,}|…)\s*\d{1,4}(?:[-–]\d+)?\s*$|;\s*see(?:\s+also)?\b", re.IGNORECASE)
_SPEAKER = re.compile(r"\s*([^\W\d][\w.' -]{0,30}):\s+\S.*[.?!…]\W*$")
_GLOSS = re.compile(r"\s*[^\W\d][\w' -]{1,40}(?::|\s[-–—])\s+(?:\S+\s+){3,}\S+\s*$")
#: Scripts without spaces between words, where a run of letters is a clause.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
_GAP = re.compile(r"\n\s*\n")


def _mostly(form: re.Pattern, lines: list[str]) -> bool:
    return 2 * sum(bool(form.search(x)) for x in lines) > len(lines)


def transcript(text: str) -> bool:
    """Most lines are what a speaker says, and a speaker comes more than once."""
    lines = [x for x in text.split("\n") if x.strip()]
    said = [m[1] for m in map(_SPEAKER.match, lines) if m]
    return 2 * len(said) > len(lines) and len(set(said)) < len(said)


def ordinary(text: str) -> bool:
    """A transcript, an index, references or a glossary of different terms, which recur regularly by their form."""
    lines = [x for x in text.split("\n") if x.strip()]
    terms = [re.split(r":|\s[-–—]", x)[0] for x in lines if _GLOSS.match(x)]
    return len(lines) > 1 and 2 * len(set(terms)) > len(lines) or _mostly(_REFERENCE, lines) or _mostly(_ENTRY, lines) or transcript(text)


def list_of_terms(text: str) -> bool:
    """Short varied items between separators with hardly a function word, unless they are an index, references, a glossary or a transcript."""
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words)
    if n < LIST_WORDS or sum(map(FUNCTION_WORDS.__contains__, words)) > FUNCTION_SHARE * n or n - sum(map(str.isalpha, words)) > DIGIT_SHARE * n:
        return False
    items = [tuple(w) for i in _ITEM.split(low) if (w := _WORD.findall(i))]
    if len(items) < LIST_ITEMS or len(set(items)) < DISTINCT_SHARE * len(items) or sum(len(i) for i in items if len(i) <= ITEM_WORDS) < IN_ITEMS * n:
        return False
    # A heading says nothing of the form of the lines below it.
    lines = [x for x in text.split("\n") if x.strip()]
    lines = lines[1:] if len(lines) > 1 and not _ITEM.search(lines[0].strip()) else lines
    forms = [_REFERENCE, _ENTRY] + [_GLOSS] * (len(lines) > 1)
    return not any(_mostly(f, lines) for f in forms) and not transcript(text)


def _lists(text: str) -> list[tuple[int, int]]:
    """Where the lists of terms lie: the whole text, or paragraphs of it."""
    if list_of_terms(text):
        return [(0, len(text))]
    ends = [(m.start(), m.end()) for m in _GAP.finditer(text)]
    blocks = list(zip([0, *(b for _, b in ends)], [*(a for a, _ in ends), len(text)], strict=True))
    return [(a, b) for a, b in blocks if len(blocks) > 1 and list_of_terms(text[a:b])]


def _few_function_words(word: np.ndarray, sizes: np.ndarray, ids: dict[str, int]) -> list[int]:
    """Numbers of the texts with so few function words that half of them may be lists."""
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(word)]
    known = np.array([ids[w] for w in FUNCTION_WORDS if w in ids], np.int64)
    held = np.bincount(owner[np.isin(word >> 32, known)], minlength=len(sizes))
    return np.flatnonzero((sizes >= LIST_WORDS) & (held <= MOST_FUNCTION * sizes)).tolist()


def _pairs(texts: list[str], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in a row, whose words are numbered in ``ids`` (empty before): for each word but the last a code of it and its follower, the number of the text they
    lie in (-1 across texts), and a code of the word alone; and the number of words of each text."""
    low = [t.lower() for t in texts]
    points, begin = code_points(low)
    start, end = word_spans(points, begin, "_")
    of = np.searchsorted(begin, start, "right") - 1
    sizes = np.bincount(of, minlength=len(texts))
    _, first, flat = np.unique(span_hash(prefix_sums(points), start, end), return_index=True, return_inverse=True)
    joined = "".join(low)
    ids.update((joined[a:b], k) for k, (a, b) in enumerate(zip(start[first].tolist(), end[first].tolist(), strict=True)))
    if len(flat) < 2:
        return *(np.zeros(0, np.int64),) * 3, sizes
    pair = (flat[:-1] << 32) | flat[1:]
    # The same word twice is emphasis or an interjection, not a phrase.
    inside = (of[:-1] == of[1:]) & (flat[:-1] != flat[1:])
    return pair, np.where(inside, of[:-1], -1), (flat[:-1] << 32) | ALONE, sizes


def _name(code: int, names: list[str]) -> str:
    first, second = code >> 32, code & ALONE
    return names[first] if second == ALONE else f"{names[first]} {names[second]}"


def _tight(pair: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Positions of pairs that stand in the lag window before or after an equal pair of the same text."""
    on = np.zeros(len(pair), bool)
    for lag in LAGS:
        if len(pair) > lag:
            at = np.flatnonzero((pair[:-lag] == pair[lag:]) & (of[:-lag] == of[lag:]) & (of[:-lag] >= 0))
            on[at] = on[at + lag] = True
    return np.flatnonzero(on)


def _even(pair: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Positions of pairs that recur in their text at gaps of nearly the same size, up to several dozen words."""
    inside = np.flatnonzero(of >= 0)
    order = inside[np.lexsort((pair[inside], of[inside]))]
    same = np.append(False, (pair[order][1:] == pair[order][:-1]) & (of[order][1:] == of[order][:-1]))[: len(order)]
    group = np.cumsum(~same) - 1
    gap = np.where(same, np.diff(order, prepend=0), 0).astype(float)
    times, total, squares = np.bincount(group), np.bincount(group, gap), np.bincount(group, gap * gap)
    mean = total / np.maximum(times - 1, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(times - 1, 1) - mean**2, 0))
    return np.sort(order[((times >= CYCLE_TIMES) & (mean <= CYCLE) & (spread <= CYCLE_SPREAD * mean))[group]])


def _words_at(at: np.ndarray, pair: np.ndarray, of: np.ndarray, ids: dict[str, int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words of each of ``n`` texts lie in the pairs at the given positions, and how many of these are function words."""
    words = np.unique(np.concatenate([at, at + 1]))
    owner = np.append(of, -1)[words]
    owner = np.where(owner < 0, of[words - 1], owner)
    code = np.append(pair >> 32, pair[-1:] & ALONE)[words]
    known = np.isin(code, np.array([ids[w] for w in FUNCTION_WORDS if w in ids], np.int64))
    return np.bincount(owner[owner >= 0], minlength=n), np.bincount(owner[(owner >= 0) & known], minlength=n)


def _runs(pair: np.ndarray, sizes: np.ndarray, names: list[str]) -> list[tuple[int, str]]:
    """Texts more than half of which is one word right after itself, with each such word."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero((pair >> 32 == pair & ALONE) & (owner[:-1] == owner[1:])) if len(pair) else np.zeros(0, np.int64)
    long = [len(w) >= RUN_LETTERS and w.isalpha() and w not in FUNCTION_WORDS and not _UNSPACED.search(w) for w in (names[k] for k in (pair[at] >> 32).tolist())]
    at = at[np.array(long, bool)]
    held = np.bincount(owner[np.unique(np.concatenate([at, at + 1]))], minlength=len(sizes)) if len(at) else np.zeros(len(sizes), np.int64)
    full = (sizes >= RUN_WORDS) & (2 * held > sizes)
    return [(int(owner[k]), names[pair[k] >> 32]) for k in at if full[owner[k]]]


def _counted(pair: np.ndarray, of: np.ndarray, ids: dict[str, int]) -> pa.RecordBatch:
    """``phrase, docs`` of the given pairs, each once a text."""
    names = list(ids)
    found, docs = np.unique(np.unique(np.stack([of, pair], 1), axis=0)[:, 1], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array([_name(p, names) for p in found.tolist()], pa.string()), pa.array(docs, pa.int64())], names=["phrase", "docs"])


def _regular(texts: list[str], pair: np.ndarray, of: np.ndarray, sizes: np.ndarray, ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that recur tightly or evenly in unnaturally regular texts, and which texts recur tightly."""
    tight, even, n = _tight(pair, of), _even(pair, of), len(texts)
    regular = _words_at(tight, pair, of, ids, n)[0] >= REGULAR * np.maximum(sizes, 1)
    held, function = _words_at(even, pair, of, ids, n)
    cyclic = (held >= CYCLE_SHARE * np.maximum(sizes, 1)) & (function <= CYCLE_FUNCTION * held)
    for k in np.unique(of[np.concatenate([tight[regular[of[tight]]], even[cyclic[of[even]]]])]):
        if ordinary(texts[k]):
            regular[k] = cyclic[k] = False
    return np.unique(np.concatenate([tight[regular[of[tight]]], even[cyclic[of[even]]]])), regular


def _own_phrases(texts: list[str], pair: np.ndarray, of: np.ndarray, sizes: np.ndarray, ids: dict[str, int]) -> dict[int, set[str]]:
    """The recurring pairs of each unnaturally regular text that name something, and the word that fills a text."""
    at, _ = _regular(texts, pair, of, sizes, ids)
    names, own = list(ids), {}
    found, times = np.unique(np.stack([of[at], pair[at]], 1), axis=0, return_counts=True)
    for k, p in found[times >= OWN_TIMES].tolist():
        both = names[p >> 32], names[p & ALONE]
        if any(w.isalpha() and w not in FUNCTION_WORDS for w in both):
            own.setdefault(k, set()).add(" ".join(both))
    for k, w in _runs(pair, sizes, names):
        own.setdefault(k, set()).add(w)
    return own


def regular_pairs(texts: DataFrame) -> DataFrame:
    """``phrase, docs``: pairs and words that recur tightly, and pairs that recur evenly, in unnaturally regular texts of column ``t``, with the number of these."""

    def run(batches):
        for batch in small_batches(batches):
            rows, ids = batch.column(0).to_pylist(), {}
            pair, of, word, sizes = _pairs(rows, ids)
            at, regular = _regular(rows, pair, of, sizes, ids)
            one = _tight(word, of)
            one = one[regular[of[one]]]
            yield _counted(np.concatenate([pair[at], word[one]]), np.concatenate([of[at], of[one]]), ids)

    return texts.mapInArrow(run, "phrase string, docs bigint").groupBy("phrase").agg(F.sum("docs").alias("docs"))


def _bits_of(code: np.ndarray, ids: dict[str, int]) -> np.ndarray:
    """The bit of each pair or word in the map of phrases."""
    known = np.fromiter((zlib.crc32(w.encode()) for w in ids), np.int64, len(ids))
    second = code & ALONE
    return (known[code >> 32] * 31 + np.where(second == ALONE, 0, known[np.where(second == ALONE, 0, second)])) % PHRASE_BITS


def _bit_map(phrases: DataFrame) -> np.ndarray:
    """The packed map of the bits of ``phrase``."""
    words = F.split("phrase", " ")
    bit = (F.crc32(words[0]) * 31 + F.crc32(F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")))) % PHRASE_BITS
    return packed_bits(phrases.select(bit.alias("bit")), PHRASE_BITS)


def _mapped(code: np.ndarray, packed: np.ndarray, ids: dict[str, int]) -> np.ndarray:
    """Which of the pairs and words may be phrases."""
    bit = _bits_of(code, ids)
    return (packed[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def containing(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``phrase, held``: in how many texts of column ``t`` each of the given pairs and words occurs."""
    shared = texts.sparkSession.sparkContext.broadcast(_bit_map(phrases))

    def run(batches):
        for batch in small_batches(batches):
            ids: dict[str, int] = {}
            pair, of, word, _ = _pairs(batch.column(0).to_pylist(), ids)
            code, of = np.concatenate([pair, word]), np.concatenate([of, of])
            at = np.flatnonzero(of >= 0)
            at = at[_mapped(code[at], shared.value, ids)]
            yield _counted(code[at], of[at], ids)

    found = texts.mapInArrow(run, "phrase string, docs bigint").groupBy("phrase").agg(F.sum("docs").alias("held"))
    return found.join(phrases.select("phrase"), "phrase", "left_semi")


def stuffing_phrases(texts: DataFrame) -> DataFrame:
    """``phrase``: the stuffing phrases of the whole table."""
    tight = materialize(regular_pairs(texts).where(F.col("docs") >= PHRASE_TEXTS))
    return materialize(tight.join(containing(texts, tight), "phrase").where(F.col("docs") >= PHRASE_SHARE * F.col("held")).select("phrase"))


def marked_share(text: str, phrases: set[str]) -> float:
    """Share of the text's characters, without white space, that are stuffing, links, lists of terms or what stands between them."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    links, lists = [m.span() for m in _LINK.finditer(low)], _lists(low)
    if not (links or lists or phrases):
        return 0.0
    spans, marks, at = [], [], 0
    for start, end in [*links, (len(low), len(low))]:
        first = len(spans)
        spans += [m.span() for m in _WORD.finditer(low, at, max(at, start))]
        marks += [False] * (len(spans) - first)
        words = [low[a:b] for a, b in spans[first:]] if phrases else []
        for k, (a, b) in enumerate(zip(words, [*words[1:], ""], strict=False), first):
            if b and f"{a} {b}" in phrases:
                marks[k] = marks[k + 1] = True
            elif a in phrases:
                marks[k] = True
        if end > start:
            spans.append((start, end))
            marks.append(True)
            at = end
    on = [k for k, m in enumerate(marks) if m or lists and any(a <= spans[k][0] < b for a, b in lists)]
    if not on:
        return 0.0
    first, last = on[0], on[-1]
    first, last = (0 if first <= EDGE else first), (len(spans) - 1 if len(spans) - 1 - last <= EDGE else last)
    stretches, begin = [], first
    for a, b in zip(on, on[1:], strict=False):
        if b - a - 1 > GLUE:
            stretches.append((begin, a))
            begin = b
    stretches.append((begin, last))
    full = len("".join(text.split()))
    covered = sum(len("".join(text[spans[a][0] : spans[b][1]].split())) for a, b in stretches)
    return covered / full


def spam_pages(df: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """``key, marked``: the documents of which more than ``share`` is stuffing, a list of links or of tags.

    Null, empty and blank texts are never spam; a text without words or with a single repeated interjection isn't either.
    Repeated rows come out repeated, null keys are kept, other columns are ignored. An empty table gives none.
    """
    texts = spread(df.select(F.col(key).alias("key"), F.col(text).alias("t")).where("t is not null"))
    phrases = stuffing_phrases(texts.select("t"))
    shared = df.sparkSession.sparkContext.broadcast(_bit_map(phrases))
    kind = df.schema[key].dataType.simpleString()

    def maybe(batches):
        """Texts marked enough if all phrases of the bit map are stuffing; ``t`` only where the join has to say whether they are."""
        for batch in small_batches(batches):
            texts, ids = batch.column(1).to_pylist(), {}
            pair, of, word, sizes = _pairs(texts, ids)
            own = _own_phrases(texts, pair, of, sizes, ids)
            code, owner = np.concatenate([pair, word]), np.concatenate([of, of])
            at = np.flatnonzero(owner >= 0)
            at = at[_mapped(code[at], shared.value, ids)]
            names, held = list(ids), {}
            for k, p in np.unique(np.stack([owner[at], code[at]], 1), axis=0).tolist():
                held.setdefault(k, set()).add(_name(p, names))
            tried = held.keys() | own.keys()
            tried.update(k for k, t in enumerate(texts) if "/" in t or "www." in t or "#" in t)
            tried.update(k for k in _few_function_words(word, sizes, ids) if k not in tried and _lists(texts[k]))
            out = []
            for k in sorted(tried):
                mine, others = own.get(k, set()), held.get(k, set())
                if (s := marked_share(texts[k], mine | others)) > share:
                    out.append((k, s, texts[k] if others - mine else None, list(mine), list(others - mine)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.float64(), pa.string(), strings, strings), strict=True))], names=["key", "marked", "t", "own", "held"])

    def exact(batches):
        for batch in batches:
            keys, texts, own, known = batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3))
            got = [(k, s) for k, t in enumerate(texts) if (s := marked_share(t, {*own[k], *(known[k] or ())})) > share]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array([k for k, _ in got], pa.int64())), pa.array([s for _, s in got], pa.float64())], names=["key", "marked"])

    found = materialize(texts.mapInArrow(maybe, f"key {kind}, marked double, t string, own array<string>, held array<string>").withColumn("row", F.monotonically_increasing_id()))
    open_texts = found.where("t is not null")
    known = open_texts.select("row", F.explode("held").alias("phrase")).join(phrases, "phrase").groupBy("row").agg(F.collect_list("phrase").alias("known"))
    decided = open_texts.select("row", "key", "t", "own").join(known, "row", "left").select("key", "t", "own", "known").mapInArrow(exact, f"key {kind}, marked double")
    return found.where("t is null").select("key", "marked").unionByName(decided).withColumnRenamed("key", key)
