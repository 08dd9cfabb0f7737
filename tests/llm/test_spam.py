import random

from lectern.llm import spam

NOUNS = "cohort letter village diary session pattern garden office winter carpenter".split()
KEYS = ["family therapist", "calm app", "free webinar", "grief journal"]


def prose(rnd, n):
    return " ".join(f"The {rnd.choice(NOUNS)} of the {rnd.choice(NOUNS)} {rnd.choice(['measured', 'described', 'was'])} {rnd.choice(NOUNS)} while {rnd.choice(NOUNS)}s {rnd.choice(['fell', 'rose'])}." for _ in range(n))


def test_pages(spark):
    rnd = random.Random(4)
    rows = [(k, prose(rnd, 12)) for k in range(200)]
    spam_ids = set()
    for k in range(200, 230):
        key = lambda: rnd.choice(KEYS)
        kind = k % 5
        a = key()
        text = {
            0: " ".join(f"{key()}," for _ in range(30)),
            1: " ".join(f"If you need {a}, our {a} is the {a} that {a} clients call {a}." for _ in range(4)),
            2: "\n".join(f"https://{rnd.choice(NOUNS)}{i}.test/x {key()}" for i in range(15)),
            3: " ".join(f"tags: {key()}, {rnd.choice(NOUNS)} / category > {key()} /" for _ in range(10)),
            4: "\n".join(f"SKU {i} | {key().title()} | {rnd.choice(NOUNS)} | {i}.99 | sale" for i in range(15)),
        }[kind]
        rows.append((k, text))
        spam_ids.add(k)
    rows += [
        (300, prose(rnd, 12) + "\n\nTags: family therapist, calm app"),
        (301, "Index\n" + "\n".join(f"{n}, {i}, {i + 7}" for i, n in enumerate(NOUNS))),
        (302, "\n".join(f"Author{i}, A. (19{i}). Notes on the {rnd.choice(NOUNS)}. Review of Things {i}:1-9. https://x{i}.test/article" for i in range(10, 20))),
        (303, None), (304, ""), (305, "   "), (306, "====" * 50), (307, "ha ha ha ha ha ha"), (308, "1 2 3 4 5 6 7 8 9"), (309, "\n".join(f"Ann: {rnd.choice(['I see.', 'Yes.', 'Go on.'])}" for _ in range(8))),
    ]
    df = spark.createDataFrame([(*r, 0.0, "t") for r in rows], "doc_id bigint, text string, marked double, t string")
    assert {r["doc_id"] for r in spam.spam_pages(df).collect()} == spam_ids
    assert spam.spam_pages(df.where("false")).count() == 0


def test_share_of_a_text():
    phrases = {"calm app"}
    assert spam.marked_share("Calm app, calm app; calm app", phrases) == 1.0
    assert spam.marked_share("nothing here", phrases) == 0.0
    assert spam.marked_share("https://a.test/b", set()) == 1.0


def test_lists_of_varied_nouns(spark):
    """A list that holds no phrase of other texts and no link; forms of ordinary lists aren't spam."""
    nouns = "poster flexibility house lamp kettle carpet mirror drawer candle basket cushion blanket teapot ladder saucer hammock".split()
    tags = "keywords=grief journal;marriage retreat; tags: family tree poster, " + ", ".join(nouns) + " / category > garden tools"
    rows = [
        (1, tags),
        (2, "The letter was in the drawer when we came. " + "\n\n" + tags),
        (3, "The letter was in the drawer of the house, and it is not clear who put it there for us. " * 6 + "\n\n" + tags),
        (4, "Index\n" + "\n".join(f"{n}, {k}; see also {m}" for k, (n, m) in enumerate(zip(nouns, nouns[1:], strict=False)))),
        (5, "References\n\nAnders, G. (1985). Ancient Tolerance: A Telephone Study. Systems Review 2:197-398. https://tolerance.test/article/4500"),
        (6, "\n".join(f"{'Ann' if k % 2 else 'Bob'}: {n.title()}, {m}." for k, (n, m) in enumerate(zip(nouns, nouns[1:], strict=False)))),
        (7, "\n".join(f"{n}: large wooden thing, kept indoors usually" for n in nouns)),
    ]
    got = spam.spam_pages(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"] for r in got.collect()} == {1, 2}


def test_own_keywords_in_a_large_table(spark):
    """Keywords of a single page, and of a campaign of two pages, among more texts than one for each phrase can be asked of."""
    rnd = random.Random(5)
    stuffed = lambda *keys: " ".join(f"{rnd.choice(keys)}," for _ in range(30))
    rows = [(k, prose(rnd, 1)) for k in range(61_000)]
    rows += [(70_000, stuffed("zither repair", "zither tuning")), (70_001, stuffed("ocarina shop", "ocarina sale")), (70_002, stuffed("ocarina shop", "ocarina sale"))]
    rows += [(70_003, "The ocarina shop of the village was cold, ocarina sale or not, and " + stuffed("ocarina shop") + " " + stuffed("ocarina sale"))]
    rows += [(70_004, "Ann: I see.\n" * 5 + "Bob: Go on.\nBob: Go on.")]
    got = spam.spam_pages(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"] for r in got.collect()} == {70_000, 70_001, 70_002, 70_003}


def test_long_cycles_and_single_words(spark):
    """A sentence or a row of keywords over and over, and one search word; a refrain is no more than a part of its text."""
    rnd = random.Random(6)
    rows = [(k, prose(rnd, 12)) for k in range(20)]
    rows += [
        (100, "\n".join(["cheap running shoes discount outlet leather boots sale"] * 8)),
        (101, " ".join(["Our quiet clinic in the old town helps every tired couple find calm evenings again."] * 6)),
        (102, "shoes " * 40),
        (103, "We met at the door. Shoes shoes shoes shoes shoes shoes shoes shoes"),
        (104, "ha ha ha ha ha ha ha"),
        (105, prose(rnd, 12) + " Shoes shoes shoes."),
        (106, "\n".join(f"{rnd.choice(NOUNS).title()} and {rnd.choice(NOUNS)} were {k} in all, and {rnd.choice(NOUNS)}s {'stood in long rows while we counted them'.split()[k % 8]} there.\nSo the evening came." for k in range(9))),
    ]
    got = spam.spam_pages(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"] for r in got.collect()} == {100, 101, 102, 103}
