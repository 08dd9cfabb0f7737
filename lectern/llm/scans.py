"""Leftovers of printed pages in scanned text: cut words, misread letters, running headers, page numbers.

One pass counts the words of the whole table. All of them meet in a symmetric-delete index, a table of what is left of
each word without up to two letters: a distance that charges little for pairs of letters that scanners confuse, and how
many times more often the other word occurs, settle which are misread. A second pass looks at the lines of every text:
page numbers and lines set like a header are taken out, words cut at line ends are joined (unless the lexicon knows the
break as a compound's own hyphen), and words that aren't among the commonest are put out and looked up in a join.
Whether a line is a running header depends on the table too: its text recurs in many documents, names the document,
breaks into a sentence, or does so elsewhere in the same document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.common import materialize, small_batches, spread
from lectern.llm.points import packed_bits

#: Letters that scanners confuse, as (misread, printed).
CONFUSED = (
    ("c", "e"), ("f", "t"), ("l", "i"), ("!", "i"), ("ri", "n"), ("0", "o"), ("1", "l"), ("|", "l"), ("cl", "d"),
    ("5", "s"), ("ii", "u"), ("rn", "m"), ("9", "g"), ("b", "h"), ("v", "y"), ("6", "b"), ("vv", "w"), ("n", "ri"),
    ("m", "rn"), ("m", "in"), ("h", "li"), ("d", "cl"), ("u", "ii"), ("e", "c"), ("t", "f"), ("i", "l"), ("h", "b"),
    ("1", "i"), ("|", "i"), ("8", "b"),
)
#: Commonest words that are sent to every task so as to pass them by; all others are looked up by joins. And how often a
#: compound or the word without its hyphen must occur to settle what stands at a line end.
KNOWN_WORDS, COMMON_COUNT = 60_000, 6
#: A word is misread only if the printed one is this many times as frequent; and the least and most letters of such a word.
RATIO, WORD_LETTERS, MOST_LETTERS = 15, 4, 40
#: Cost of a confusion and of any other edit, and the most a repair may cost.
CONFUSION_COST, EDIT_COST, MOST_COST = 0.5, 2.0, 1.0
#: A header-like line is a periodical's name if it occurs in this many documents and breaks into sentences in this share.
PERIODICAL_DOCS, PERIODICAL_BREAKS = 4, 0.25

_PART = re.compile(r"[\w|!]+")
_TOKEN = re.compile(r"[\w|!]+(?:[-‐][\w|!]+)*")
# The mark may itself be garbled: a soft hyphen or a not sign becomes a not sign and one more character.
_CUT = re.compile(r"[-‐\xad¬≠¨](?:(?<=[^\W\d_].)|(?<=[^\W\d_]¬.))[ \t]*\n\s*(?=[^\W\d_])")
_LEFT, _RIGHT = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*$"), re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_PAGE = re.compile(
    r"(?:-+ ?)?(?:pdf )?(?:page|pages|seite|página|pag\.|pág\.|p\.|s\.) ?\d{1,5}(?: ?-+)?|[-–—] ?\d{1,5} ?[-–—]|\[ ?\d{1,5} ?\]|\d{1,5}(?: (?:of|von|de|sur) |/)\d{1,5}|\d{1,5}"
    r"|(?=[ivxlc])c{0,4}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})",
    re.IGNORECASE,
)
_NUMBERED = re.compile(r"^(?:(\d{1,5}|[ivxlc]{2,9})\s{2,}(\S.*)|(.*\S)\s{2,}(\d{1,5}|[ivxlc]{2,9}))$")
_SPACED = re.compile(r"^\S(?: \S)*(?:\s{2,}\S(?: \S)*)*$")
_ENDS = re.compile(r"[.!?:…”\"»)\]]\s*$")
_VOLUME = re.compile(r",? [Vv][Oo][Ll]\. ?\w+.*$")
_INSIDE = re.compile(r"[.;?!…](?: |$)|, |\d{4}| [—–] ")
_CAPITALS = re.compile(r"\b[^\W\d_a-zß-ÿ]{3,}\b")
_DIGITS = frozenset("0123456789ivxlcIVXLC")
_YEAR = re.compile(r"(?:18|19|20)\d\d")
_SMALL = frozenset("a an and the of in on to for toward by at from with und der die das im in bei zu über für la le les de des du et sur à en l d el los las del y con entre".split())
_FOLD = {"0": "o", "1": "l", "5": "s", "!": "l", "|": "l", "6": "b", "9": "g", "8": "b"}
_SKELETON = (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("ri", "n"), ("c", "e"), ("f", "t"), ("i", "l"), ("b", "h"), ("v", "y"))


def skeleton(text: str) -> str:
    """The letters of ``text`` without case, spaces and the differences that misreading makes."""
    out = "".join(_FOLD.get(c, c) for c in text.lower())
    out = re.sub(r"[\W\d_]+", "", out)
    for a, b in _SKELETON:
        out = out.replace(a, b)
    return out


def _unspaced(line: str) -> str:
    """``T h e   C a l m`` as ``The Calm``; any other line as it is."""
    if len(line) > 6 and _SPACED.match(line) and sum(c == " " for c in line) >= 0.4 * len(line):
        return " ".join("".join(w.split(" ")) for w in re.split(r"\s{2,}", line))
    return line


def _set_like_header(line: str) -> bool:
    """Whether all words but small ones begin with a capital (or a digit read for one) and no sentence ends."""
    first = line[0]
    if not first.isupper() and first not in "0158l!|" or len(line) > 110:
        return False
    plain = _VOLUME.sub("", line)
    if _INSIDE.search(plain) or plain.rstrip(" :·").split(" ")[-1].lower() in _SMALL:
        return False
    words = plain.split()
    capitals = _in_capitals(plain)
    weighty = 0
    for k, w in enumerate(words):
        w = w.strip("«»“”\"(),;:") or "-"
        c = w[0]
        if w.isdigit():
            return False
        if c.islower() and (c != "l" or k and not capitals) or c in "234679":
            if w.lower() not in _SMALL and w.split("’")[0].lower() not in _SMALL:
                return False
        elif c.isalpha() and w.lower() not in _SMALL or c in "0158!|" and w[1:2].isalpha():
            weighty += 1
    return 0 < weighty and len(words) <= 14 and not _ENDS.search(plain)


def _in_capitals(line: str) -> bool:
    """Whether all letters are capitals but those that are often read for one."""
    letters = [c for c in line if c.isalpha() and c != "l"]
    return bool(letters) and all(c.isupper() for c in letters)


_titles: dict[str, tuple[str, str]] = {}


def _title(title: str | None) -> tuple[str, str]:
    """Skeleton and plain letters of a document's name; names come again and again."""
    if not title:
        return "", ""
    if title not in _titles:
        if len(_titles) > 50_000:
            _titles.clear()
        _titles[title] = (skeleton(title), re.sub(r"[\W\d_]+", "", title.lower()))
    return _titles[title]


class Page:
    """The lines of one text, sorted into body, page numbers and header-like lines."""

    def __init__(self, text: str, title: str | None, page: int | None):
        self.pageno = False
        #: Header-like lines: skeleton, whether it breaks into a sentence, whether it names the document, and whether
        #: it does the first and is set as no line of a text is: with a number, in capitals or spaced.
        self.headers: list[tuple[str, bool, bool, bool]] = []
        self.body = text
        #: Kind and skeleton of every line, once there is one that isn't body.
        self.lines: list[tuple[str, str, str]] = []
        if "\n" not in text:
            return
        name, plain = _title(title)
        lines = text.split("\n")
        kinds, parts = [], []
        bracket = False
        for i, raw in enumerate(lines):
            line = raw.strip()
            kind, head = "body", ""
            if not line:
                kind = "blank"
            elif len(line) < 25 and line[-1] not in ".,;:?!”\"" and _PAGE.fullmatch(line):
                first = i == 0 and i + 1 < len(lines) and not lines[i + 1].strip()
                year = first and _YEAR.fullmatch(line) and not (page is not None and abs(page - int(line)) <= 60)
                kind, bracket = ("head" if year else "page"), False
            elif bracket or line[0] == "[":
                bracket = "]" not in line
            elif len(line) <= 130:
                m = _NUMBERED.match(line) if "  " in line and (line[-1] in _DIGITS or line[0] in _DIGITS) else None
                bare = (m[2] or m[3] if m else line).strip(" ·|—-")
                spaced = bare[1:2] == " " and (alike := _unspaced(bare)) != bare
                head = alike if spaced else bare
                letters = re.sub(r"[\W\d_]+", "", head.lower()) if plain and 8 <= len(head) <= 90 and not _ENDS.search(head) else ""
                if not (head and (spaced or len(letters) >= 8 and letters in plain or _set_like_header(head))):
                    head = ""
                if head:
                    kind = "numbered" if m else "head"
            kinds.append(kind)
            parts.append(head)
        if all(k in ("body", "blank") for k in kinds):
            return
        for i, kind in enumerate(kinds):
            # Two long lines of capitals in a row, or one amid a passage of capitals, are text and no headers.
            if kind == "head" and parts[i].isupper() and len(parts[i].split()) > 3:
                around = [lines[j].strip() for j in (i - 1, i + 1) if 0 <= j < len(lines) and kinds[j] in ("head", "body")]
                if any(len(_CAPITALS.findall(x)) > 1 and not _unspaced(x) != x for x in around if len(x.split()) > 3):
                    kinds[i], parts[i] = "text", ""
        kinds = ["body" if k == "text" else k for k in kinds]
        body: list[str] = []
        for i, kind in enumerate(kinds):
            if kind in ("body", "blank"):
                body.append(lines[i])
                continue
            if kind == "page":
                self.pageno = True
                continue
            if not parts[i]:
                continue
            before = next((lines[j].strip() for j in range(i - 1, -1, -1) if kinds[j] == "body"), "")
            after = next((lines[j].strip() for j in range(i + 1, len(lines)) if kinds[j] == "body"), "")
            near = next((k for k in kinds[i + 1 :] if k != "blank"), "")
            alone = (i == 0 or kinds[i - 1] == "blank") and (i + 1 < len(kinds) and kinds[i + 1] == "blank")
            breaks = bool(before and after and not _ENDS.search(before) and not (alone and after[:1].isupper() and i == 0)) or kind == "numbered"
            breaks |= bool(after) and after[0].islower() and not alone and near != ""
            capitals = _in_capitals(parts[i])
            breaks &= kind == "numbered" or len(parts[i].split()) > 2 or capitals
            strong = breaks and (kind == "numbered" or capitals and len(parts[i].split()) <= 9 or _unspaced(lines[i].strip()) != lines[i].strip())
            # At either end of a text a heading has a blank line beside it; a header hasn't.
            edge = capitals and (i == 0 and len(kinds) > 1 and kinds[1] == "body" or 0 < i == len(kinds) - 1 and kinds[i - 1] == "body")
            breaks, strong = breaks or edge, strong or edge
            bits = [b for b in re.split(r"\s*[·:|—]\s*", _VOLUME.sub("", parts[i])) if b]
            named = bool(name) and any(len(s := skeleton(b)) >= 5 and s in name for b in bits)
            if kind == "numbered":
                self.pageno = True
            self.headers.append((skeleton(_VOLUME.sub("", parts[i])), breaks, named, strong))
        self.body = "\n".join(body)
        named_lines = iter(self.headers)
        self.lines = [(k, x, next(named_lines)[0] if k in ("head", "numbered") and h else "") for k, x, h in zip(kinds, lines, parts, strict=True)]


#: Ligatures and their letters.
_LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))


def _plain(text: str) -> str:
    """``text`` with its ligatures resolved."""
    if not text.isascii():
        for a, b in _LIGATURES:
            text = text.replace(a, b)
    return text


def count_words(texts: list[str]) -> Counter:
    """Lower-cased words with their number: compounds whole and in their parts, words cut at a line end joined.

    What stands between spaces is counted first, then taken apart once for each different piece."""
    pieces: Counter[str] = Counter()
    for text in texts:
        pieces.update(_CUT.sub("", _plain(text)).lower().split())
    counted: Counter[str] = Counter()
    for piece, n in pieces.items():
        for word in (piece,) if piece.isalpha() else _TOKEN.findall(piece):
            counted[word] += n
            if "-" in word:
                for part in word.split("-"):
                    counted[part] += n
    return counted


def lexicon(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts of column ``t``."""

    def run(batches):
        for batch in small_batches(batches):
            counted = count_words(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(counted.keys(), pa.string()), pa.array(counted.values(), pa.int64())], names=["word", "n"])

    return docs.select("t").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def deletes(word: str, most: int = 2) -> set[str]:
    """``word`` without up to ``most`` of its letters."""
    out = {word}
    for k in range(1, min(most, len(word) - 2) + 1):
        out.update("".join(c for i, c in enumerate(word) if i not in gone) for gone in map(set, combinations(range(len(word)), k)))
    return out


def distance(misread: str, printed: str, limit: float = MOST_COST) -> float:
    """Least cost of turning ``printed`` into ``misread`` by confusions and other edits."""
    rows = [[float("inf")] * (len(printed) + 1) for _ in range(len(misread) + 1)]
    rows[0][0] = 0.0
    for i in range(len(misread) + 1):
        for j in range(len(printed) + 1):
            here = rows[i][j]
            if here > limit:
                continue
            if i < len(misread) and j < len(printed):
                step = here + (0.0 if misread[i] == printed[j] else EDIT_COST)
                if step < rows[i + 1][j + 1]:
                    rows[i + 1][j + 1] = step
            for a, b in CONFUSED:
                if misread.startswith(a, i) and printed.startswith(b, j) and here + CONFUSION_COST < rows[i + len(a)][j + len(b)]:
                    rows[i + len(a)][j + len(b)] = here + CONFUSION_COST
            if i < len(misread):
                rows[i + 1][j] = min(rows[i + 1][j], here + EDIT_COST)
            if j < len(printed):
                rows[i][j + 1] = min(rows[i][j + 1], here + EDIT_COST)
    return rows[-1][-1]


_CODE = re.compile(r"[a-z]?\d+[a-z]?|\d+[a-z]*")


def _plain_reading(word: str) -> str | None:
    """A word with its digits and signs read as the letters that they look like, if that makes a word of letters."""
    if word.isalpha() or _CODE.fullmatch(word) or sum(c.isalpha() for c in word) < 3:
        return None
    plain = "".join("i" if c == "!" else _FOLD.get(c, c) for c in word)
    return plain if plain.isalpha() else None


def _deletes(words: DataFrame) -> DataFrame:
    """``gone, word, n``: the hash of every string that is left of each word, with the word."""

    def run(batches):
        for batch in batches:
            made = [sorted(deletes(w)) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.string()))], names=["word", "n", "made"])

    made = spread(words.select("word", "n")).mapInArrow(run, "word string, n bigint, made array<string>")
    return made.select("word", "n", F.explode("made").alias("left")).select(F.xxhash64("left").alias("gone"), "word", "n")


def corrections(words: DataFrame) -> DataFrame:
    """``word, printed array<struct<word, cost, n>>``: of ``words (word, n)``, each once, those that are misread, best first.

    The index is a table of Spark, joined with itself, so it holds the whole vocabulary. A printed word consists of
    letters, isn't itself misread and is ``RATIO`` times as frequent. Words of more than ``MOST_LETTERS`` aren't tested.
    """
    asked = words.where(F.length("word").between(WORD_LETTERS, MOST_LETTERS) & ~F.col("word").rlike("^[0-9]+$"))
    index = _deletes(asked)
    frequent = index.where((F.col("n") >= RATIO) & F.col("word").rlike(r"^\p{L}+$")).select("gone", F.col("word").alias("c"), F.col("n").alias("nc"))
    pairs = index.join(frequent, "gone").where((F.col("word") != F.col("c")) & (F.col("nc") >= RATIO * F.col("n"))).select("word", "c", "nc").distinct()

    def measure(batches):
        for batch in batches:
            cost = [distance(w, c) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cost, pa.float64())], names=["word", "c", "nc", "cost"])

    near = materialize(spread(pairs).mapInArrow(measure, "word string, c string, nc bigint, cost double").where(F.col("cost") <= MOST_COST))

    def read(batches):
        for batch in batches:
            kept = [(w, p) for w in batch.column(0).to_pylist() if (p := _plain_reading(w))]
            cols = list(zip(*kept, strict=True)) if kept else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string())], names=["word", "plain"])

    unread = materialize(spread(asked.where(~F.col("word").rlike(r"^\p{L}+$")).select("word")).mapInArrow(read, "word string, plain string"))
    doubtful = near.select("word").union(unread.select("word")).distinct()
    sure = near.join(doubtful.withColumnRenamed("word", "c"), "c", "left_anti")
    option = F.struct((F.col("cost") - 0.05 * F.log("nc")).alias("order"), "cost", F.col("c").alias("word"), F.col("nc").alias("n"))
    found = sure.groupBy("word").agg(F.sort_array(F.collect_list(option)).alias("o")).select("word", F.transform("o", lambda o: F.struct(o["word"].alias("word"), o["cost"].alias("cost"), o["n"].alias("n"))).alias("printed"))
    read_as = F.array(F.struct(F.col("plain").alias("word"), F.lit(MOST_COST).alias("cost"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n")))
    plain = unread.join(found, "word", "left_anti").join(words.select(F.col("word").alias("plain"), "n"), "plain", "left")
    return found.unionByName(plain.select("word", read_as.alias("printed")))


def _cuts(text: str, known: dict[str, int], owns: frozenset[str] | set[str] = frozenset()) -> tuple[str, bool, list[tuple[str, str]]]:
    """The text with cut words joined, whether a mark stood there that isn't part of the word, and the cuts that ``known``
    doesn't settle, as compound and whole word. Of these, ``owns`` names the compounds that keep their hyphen."""
    found, out, at, open_ = False, [], 0, []
    for m in _CUT.finditer(text):
        begin = m.start() - (text[m.start()] in "≠¨")
        left, right = _LEFT.search(text, max(0, begin - 60), begin), _RIGHT.match(text, m.end())
        if not left or not right:
            continue
        mark, a, b = text[m.start()], left[0], right[0]
        compound, whole = f"{a}-{b}".lower(), f"{a}{b}".lower()
        own = False
        if mark in "-‐":
            n, whole_n = known.get(compound, 0), known.get(whole, 0)
            own = n >= COMMON_COUNT and n > whole_n or b[0].isupper() and not a.isupper() or compound in owns
            if not own and compound not in known and whole not in known:
                open_.append((compound, whole))
        found |= not own and not (open_ and open_[-1] == (compound, whole))
        out += [text[at:begin], "-" if own else ""]
        at = m.end()
    return "".join([*out, text[at:]]), found, open_


def _words_with_context(body: str):
    """Every word of ``body`` with its place and its lower-cased neighbours."""
    found = list(_PART.finditer(body))
    low = [m[0].lower() for m in found]
    for k, m in enumerate(found):
        yield m, low[k], low[k - 1] if k else "", low[k + 1] if k + 1 < len(low) else ""


def _like(printed: str, misread: str) -> str:
    """``printed`` with the capitals of ``misread``."""
    letters = [c for c in misread if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return printed.upper()
    return printed[:1].upper() + printed[1:] if misread[:1].isupper() or misread[:1] in "015689|!" and len(misread) > 1 and misread[1].isupper() else printed


def repaired(text: str, title: str | None, page: int | None, headers: set[str], repairs: dict[tuple[str, str, str], str], known: dict[str, int], owns: set[str]) -> str:
    """The text without page numbers and running headers, cut words joined, misread words replaced, lines unwrapped.

    Paragraphs that only a page's end divides, in the middle of a sentence, become one again; headings stay."""
    text = _plain(text)
    lines = Page(text, title, page).lines or [("body", x, "") for x in text.split("\n")]
    kept = [("blank", "") if k == "page" or s and s in headers else ("head" if s else "body" if x.strip() else "blank", x) for k, x, s in lines]
    blocks: list[list[str]] = []
    fresh = True
    for kind, line in kept:
        if kind == "blank":
            fresh = True
            continue
        goes_on = blocks and not _ENDS.search(blocks[-1][-1]) and kind == "body" and not blocks[-1][0].startswith("\x00")
        if kind == "head":
            blocks.append(["\x00" + line])
        elif fresh and not goes_on or not blocks or blocks[-1][0].startswith("\x00"):
            blocks.append([line])
        else:
            blocks[-1].append(line)
        fresh = False
    out = []
    for block in blocks:
        body, _, _ = _cuts("\n".join(x.removeprefix("\x00").rstrip() for x in block), known, owns)
        at, made = 0, []
        for m, low, before, after in _words_with_context(body):
            word = low.rstrip("!")
            printed = repairs.get((word, before, after)) or repairs.get((word, "", ""))
            if printed:
                made += [body[at : m.start()], _like(printed, m[0])]
                at = m.start() + len(word)
        out.append(re.sub(r"[ \t]*\n[ \t]*", " ", "".join([*made, body[at:]])).strip())
    return "\n\n".join(x for x in out if x)


#: Bits of the map of wanted word pairs. More pairs only let more through to the exact join.
PAIR_BITS = 1 << 24


class Scans:
    """What is found in one table. Intermediate tables are kept in the shared folder."""

    def __init__(self, df: DataFrame, key: str = "id", text: str = "text", title: str = "doc_name", page: str = "page"):
        docs = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"), F.col(title).alias("d"), F.col(page).cast("int").alias("p"))
        self.docs = spread(docs.where("id is not null and t is not null and length(trim(t)) > 0"))
        counted = materialize(lexicon(self.docs))
        # An exclamation mark may be a letter misread, but not at the end of a word.
        self.words = materialize(counted.groupBy(F.rtrim("word", F.lit("!")).alias("word")).agg(F.sum("n").alias("n")).where("word != ''"))
        self.corrections = materialize(corrections(self.words))
        top = self.words.join(self.corrections.select("word"), "word", "left_anti").orderBy(F.desc("n"), "word").limit(KNOWN_WORDS)
        self.known = {r["word"]: r["n"] for r in top.toLocalIterator()}
        self.parts = materialize(self._structure())

    def _structure(self) -> DataFrame:
        shared = self.docs.sparkSession.sparkContext.broadcast(self.known)
        word = pa.struct([("word", pa.string()), ("prev", pa.string()), ("next", pa.string())])
        head = pa.struct([("text", pa.string()), ("breaks", pa.bool_()), ("named", pa.bool_()), ("strong", pa.bool_())])
        open_cut = pa.struct([("compound", pa.string()), ("whole", pa.string())])

        def run(batches):
            known = shared.value
            plain: set[str] = set()  # what stands between spaces and holds known words only
            for batch in small_batches(batches):
                out = []
                for t, d, p in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    page = Page(t, d, p)
                    body, cut, cuts = _cuts(_plain(page.body), known)
                    low, rare = body.lower(), []
                    for piece in set(low.split()).difference(plain):
                        if all(w in known or len(w) < WORD_LETTERS for w in _PART.findall(piece)):
                            plain.add(piece)
                    tokens = [] if plain.issuperset(low.split()) else _PART.findall(low)
                    if len(plain) > 500_000:
                        plain.clear()
                    for k in [k for k, w in enumerate(tokens) if w not in known and len(w) >= WORD_LETTERS]:
                        w = tokens[k].rstrip("!")
                        if w not in known and WORD_LETTERS <= len(w) <= MOST_LETTERS and not w.isdigit():
                            rare.append({"word": w, "prev": tokens[k - 1] if k else "", "next": tokens[k + 1] if k + 1 < len(tokens) else ""})
                    heads = [{"text": a, "breaks": b, "named": n, "strong": g} for a, b, n, g in page.headers]
                    out.append((cut, page.pageno, heads, rare, [{"compound": a, "whole": b} for a, b in cuts]))
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = (pa.bool_(), pa.bool_(), pa.list_(head), pa.list_(word), pa.list_(open_cut))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", "d", "cut", "pageno", "heads", "rare", "cuts"])

        kind = "id bigint, d string, cut boolean, pageno boolean, heads array<struct<text:string,breaks:boolean,named:boolean,strong:boolean>>"
        return self.docs.mapInArrow(run, kind + ", rare array<struct<word:string,prev:string,next:string>>, cuts array<struct<compound:string,whole:string>>")

    def headers(self) -> DataFrame:
        """``id, text``: the running headers of each text by their skeleton."""
        lines = self.parts.select("id", "d", F.explode("heads").alias("h")).select("id", "d", "h.*")
        by_text = lines.groupBy("text").agg(F.approx_count_distinct("d").alias("docs"), F.avg(F.col("breaks").cast("double")).alias("share"))
        # Both tables are written first: joins of plain tables are split by Spark where a header or document is hot.
        periodicals = materialize(by_text.where((F.col("docs") >= PERIODICAL_DOCS) & (F.col("share") >= PERIODICAL_BREAKS)).select("text", F.lit(True).alias("periodical")))
        in_doc = materialize(lines.where("d is not null and (strong or named)").select("d", "text", F.lit(True).alias("here")).distinct())
        known = lines.join(periodicals, "text", "left").join(in_doc, ["d", "text"], "left")
        return known.where("strong or named or coalesce(periodical, false) or coalesce(here, false)").select("id", "text").distinct()

    def cuts(self) -> DataFrame:
        """``id, compound, own``: the cuts that rarer words settle, and whether the hyphen is the compound's own."""
        cuts = self.parts.select("id", F.explode("cuts").alias("c")).select("id", "c.*").distinct()
        compounds, wholes = self.words.select(F.col("word").alias("compound"), "n"), self.words.select(F.col("word").alias("whole"), F.col("n").alias("m"))
        own = (F.coalesce("n", F.lit(0)) >= COMMON_COUNT) & (F.coalesce("n", F.lit(0)) > F.coalesce("m", F.lit(0)))
        return cuts.join(compounds, "compound", "left").join(wholes, "whole", "left").select("id", "compound", own.alias("own"))

    def misread(self) -> DataFrame:
        """``id, word, prev, next, printed``: the misread words of each text with what may be printed."""
        rare = self.parts.select("id", F.explode("rare").alias("w")).select("id", "w.*")
        return rare.join(self.corrections, "word").distinct()

    def _pair_counts(self, wanted: DataFrame) -> DataFrame:
        """``a, b, n``: how often the wanted word pairs ``(a, b)`` occur in the table."""

        bit = F.crc32(F.concat_ws(" ", "a", "b")) % PAIR_BITS
        shared = wanted.sparkSession.sparkContext.broadcast(packed_bits(wanted.select(bit.alias("bit")), PAIR_BITS).tobytes())

        def run(batches):
            mask = shared.value
            for batch in small_batches(batches):
                counted: Counter[tuple[str, str]] = Counter()
                for text in batch.column(0).to_pylist():
                    tokens = _PART.findall(_CUT.sub("", text).lower())
                    counted.update(zip(tokens, tokens[1:], strict=False))
                hits = [(a, b, n) for (a, b), n in counted.items() if mask[(bit := _pair_bit(a, b)) >> 3] >> (bit & 7) & 1]
                cols = list(zip(*hits, strict=True)) if hits else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["a", "b", "n"])

        found = self.docs.select("t").mapInArrow(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
        return found.join(wanted, ["a", "b"], "left_semi")

    def repairs(self) -> DataFrame:
        """``id, word, prev, next, printed``: the repair of every misread word. Where several words may be printed, the one
        that is nearest, most frequent and most often found beside the neighbours."""
        misread = materialize(self.misread())
        sure = misread.where(F.size("printed") == 1).select("id", "word", "prev", "next", F.col("printed")[0]["word"].alias("printed"))
        open_ = misread.where(F.size("printed") > 1).select("id", "word", "prev", "next", F.explode("printed").alias("c")).select("id", "word", "prev", "next", F.col("c.word").alias("printed"), "c.cost", "c.n")
        pairs = open_.select(F.col("prev").alias("a"), F.col("printed").alias("b")).union(open_.select("printed", "next")).distinct()
        counts = materialize(self._pair_counts(materialize(pairs)))
        left = counts.select(F.col("a").alias("prev"), F.col("b").alias("printed"), F.col("n").alias("nl"))
        right = counts.select(F.col("a").alias("printed"), F.col("b").alias("next"), F.col("n").alias("nr"))
        scored = open_.join(left, ["prev", "printed"], "left").join(right, ["printed", "next"], "left")
        bits = F.col("cost") * 4 - F.log(F.col("n") + 1.0) - 2 * F.log(F.coalesce("nl", F.lit(0)) + 1.0) - 2 * F.log(F.coalesce("nr", F.lit(0)) + 1.0)
        chosen = scored.groupBy("id", "word", "prev", "next").agg(F.min_by("printed", F.struct(bits, "printed")).alias("printed"))
        return sure.unionByName(chosen)

    def texts(self) -> DataFrame:
        """``id, kinds, text``: the repaired text of everything with a leftover. What one text needs is gathered by its id."""
        kinds = self.kinds().groupBy("id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
        heads = self.headers().groupBy("id").agg(F.collect_set("text").alias("heads"))
        words = self.repairs().groupBy("id").agg(F.collect_set(F.struct("word", "prev", "next", "printed")).alias("words"))
        docs = self.docs.groupBy("id").agg(F.first(F.struct("t", "d", "p")).alias("s")).select("id", "s.*")
        owns = self.cuts().where("own").groupBy("id").agg(F.collect_set("compound").alias("owns"))
        rows = docs.join(kinds, "id").join(heads, "id", "left").join(words, "id", "left").join(owns, "id", "left")
        shared = self.docs.sparkSession.sparkContext.broadcast(self.known)

        def run(batches):
            for batch in small_batches(batches):
                out = []
                for r in batch.to_pylist():
                    changes = {(w["word"], w["prev"], w["next"]): w["printed"] for w in r["words"] or ()}
                    out.append(repaired(r["t"], r["d"], r["p"], set(r["heads"] or ()), changes, shared.value, set(r["owns"] or ())))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["id", "kinds", "text"])

        return rows.select("id", "kinds", "t", "d", "p", "heads", "words", "owns").mapInArrow(run, "id bigint, kinds array<string>, text string")

    def kinds(self) -> DataFrame:
        """``id, kind``: every kind of leftover in each text."""
        flags = self.parts.select("id", F.explode(F.array(F.when(F.col("cut"), "hyphen"), F.when(F.col("pageno"), "pageno"))).alias("kind")).where("kind is not null")
        flags = flags.unionByName(self.cuts().where("not own").select("id", F.lit("hyphen").alias("kind")))
        every = flags.unionByName(self.headers().select("id", F.lit("header").alias("kind"))).unionByName(self.misread().select("id", F.lit("char").alias("kind")))
        return every.distinct()


def _pair_bit(a: str, b: str) -> int:
    return zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass")) % PAIR_BITS


def repair_scans(df: DataFrame, key: str = "id", text: str = "text", title: str = "doc_name", page: str = "page") -> DataFrame:
    """``key, kinds, text``: every text with leftovers of printed pages, repaired into continuous paragraphs.

    Texts without leftovers don't come out; else as ``scan_noise``.
    """
    return Scans(df, key, text, title, page).texts().withColumnRenamed("id", key)


def scan_noise(df: DataFrame, key: str = "id", text: str = "text", title: str = "doc_name", page: str = "page") -> DataFrame:
    """``key, kind``: one row for each text and kind of leftover of its printed pages, of ``hyphen, char, header, pageno``.

    Null, empty and blank texts and null keys give none; titles and pages may be null (the document's name then can't
    confirm a header). A key stored twice counts once; other columns are ignored; an empty table gives none.
    """
    return Scans(df, key, text, title, page).kinds().withColumnRenamed("id", key)
