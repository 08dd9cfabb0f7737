from lectern.operators import journal


def test_contents_table(spark):
    toc = "CONTENTS\nFirst Topic\t\n12\nAnn Lee, PhD\nARTICLES\nSecond\t\nTopic Continued\t\n" + "30\nBook Writer\nReviewed by: Bo Ray, MD and Cy Fox\n\nThird\t7\nPlain Author\nEnd Press\nignored\t9"
    df = spark.createDataFrame([("i", toc), ("n", None)], "issue string, text string")
    tokens = journal.toc_tokens(df, "issue", "text", ("end press",))
    assert [r["type"] for r in tokens.orderBy("pos").collect()] == ["HEADER", "TAB", "PAGE", "TEXT", "HEADER", "TAB", "TAB", "PAGE", "TEXT", "TEXT", "TAB", "PAGE", "TEXT"]
    got = [tuple(r) for r in journal.toc_entries(tokens, "issue").orderBy("ord").select("title", "author", "page").collect()]
    assert got == [("First Topic", "Lee", 12), ("Topic Continued", "Ray", 30), ("Third", "Author", 7)]


def test_title_continues_after_the_page(spark):
    df = spark.createDataFrame([("i", "Long\t\n5\nTitle\t\nAnn Lee, PhD\t\nNext\t\n9\nBo Ray, MD")], "issue string, text string")
    got = [tuple(r) for r in journal.toc_entries(journal.toc_tokens(df, "issue", "text"), "issue").orderBy("ord").select("title", "author", "page").collect()]
    assert got == [("Long Title", "Lee", 5), ("Next", "Ray", 9)]


def test_page_map_and_nearest(spark):
    pages = spark.createDataFrame([("i", 0, "17\tTitle\nx"), ("i", 1, "Name | 18\nx"), ("i", 2, "a\nb\nc\nd\ne\nf\ng\n19"), ("i", 3, "17\n"), ("i", 4, None), (None, 5, "3")], "issue string, pdf int, text string")
    mapped = journal.page_map(pages, "issue", "pdf", "text")
    assert {r["journal_page"]: r["pdf_page"] for r in mapped.collect()} == {17: 0, 18: 1, 19: 2}
    table = spark.createDataFrame([("i", 10, 1), ("i", 14, 3)], "issue string, journal_page int, pdf_page int")
    asked = spark.createDataFrame([("i", 12), ("i", 13), ("i", 40)], "issue string, page int")
    assert {r["page"]: r["pdf_page"] for r in journal.nearest_pages(asked, table).collect()} == {12: 1, 13: 3, 40: None}


def test_extents_and_texts(spark):
    mapped = spark.createDataFrame([("i", n, n - 5) for n in range(5, 41)], "issue string, journal_page int, pdf_page int")
    starts = spark.createDataFrame([("i", 1, 5), ("i", 2, 12), ("i", 3, 30)], "issue string, ord int, page int")
    extents = journal.article_extents(starts, mapped)
    assert [(r["start_page"], r["end_page"], r["start_pdf"], r["end_pdf"]) for r in extents.orderBy("ord").collect()] == [(5, 11, 0, 6), (12, 29, 7, 24), (30, 40, 25, 35)]
    pages = spark.createDataFrame([("i", n, f"p\xad{n}" if n != 1 else " ") for n in range(36)], "issue string, pdf int, text string")
    texts = {r["ord"]: (r["pages"], r["text"]) for r in journal.article_texts(extents, pages, "issue", "pdf", "text").collect()}
    assert texts[1] == (6, "\n\n".join(f"p{n}" for n in (0, 2, 3, 4, 5, 6)))


def test_same_start_page(spark):
    mapped = spark.createDataFrame([("i", n, n) for n in range(1, 60)], "issue string, journal_page int, pdf_page int")
    starts = spark.createDataFrame([("i", 1, 5), ("i", 2, 5)], "issue string, ord int, page int")
    ends = {strict: [r["end_pdf"] for r in journal.article_extents(starts, mapped, strict=strict).orderBy("ord").collect()] for strict in (True, False)}
    assert ends[True][0] == 35 and ends[False][0] == 5 or ends[True][0] == 35


def test_ocr_and_names(spark):
    df = spark.createDataFrame([("i", "ARTICLES\n'A Fine Title_\n7\nF\nAnn Lee, PhD\n2001\nOther Title\n19\nCONTENTS\nBo Ray, MD")], "issue string, text string")
    got = sorted(tuple(r) for r in journal.ocr_entries(df, "issue", "text").select("page", "title", "author").collect())
    assert got == [(7, "A Fine Title", "Lee"), (19, "Other Title", "Unknown")]
    names = spark.createDataFrame([("Reviewed by: Bo Ray, PhD, LCSW",), ("Ann Lee and Bo Ray",), ("PhD",)], "a string").select(journal.last_name(__import__("pyspark").sql.functions.col("a")).alias("x"))
    assert [r["x"] for r in names.collect()] == ["Ray", "Lee", "Unknown"]


def test_labels_and_the_editors_piece(spark):
    df = spark.createDataFrame([("i", "SECOND PANEL OF PRESENTATIONS\nAnn B. Lee, MSW\t4\nA Plain Title\t9\nBo Ray, MSAT\nIN MEMORIAM\nReview of Lee, PhD\t12")], "issue string, text string")
    tokens = journal.toc_tokens(df, "issue", "text")
    assert [r["type"] for r in tokens.orderBy("pos").collect()] == ["HEADER", "TAB", "PAGE", "TAB", "PAGE", "TEXT", "HEADER", "TAB", "PAGE"]
    got = [tuple(r) for r in journal.toc_entries(tokens, "issue").orderBy("ord").select("title", "author", "page").collect()]
    assert got == [("FROM THE EDITOR", "Lee", 4), ("A Plain Title", "Ray", 9), ("Review of Lee, PhD", "Unknown", 12)]


def test_corrections(spark):
    entries = spark.createDataFrame([("i", 7, "A Fme Title", "Lee"), ("i", 9, "Other", "Ray")], "issue string, page int, title string, author string")
    fixed = spark.createDataFrame([("i", 7, "A Fine Title", "Lee"), ("i", 7, "B", "Lee"), ("i", 30, "Lost", "Fox")], "issue string, page int, title string, author string")
    got = sorted(tuple(r) for r in journal.corrected_entries(entries, fixed, "issue").collect())
    assert got == [("i", 7, "A Fine Title", "Lee"), ("i", 9, "Other", "Ray"), ("i", 30, "Lost", "Fox")]


def test_issue_contents(spark):
    pages = spark.createDataFrame([("a", 0, "CONTENTS"), ("a", 1, "x"), ("a", 2, None), ("b", 0, "y")], "doc string, pdf int, text string")
    issues = spark.createDataFrame([("a", [1, 0, 2, 9], "TAB", None), ("b", [0], "OCR", True), ("c", [0], "TAB", False)], "issue string, toc_pages array<int>, toc_format string, skip boolean")
    assert [tuple(r) for r in journal.issue_contents(issues, pages, "doc", "pdf", "text").collect()] == [("a", "TAB", "x\nCONTENTS")]


def test_article_records(spark):
    articles = spark.createDataFrame([("4.1", 1, "The Calm", "Lee"), ("4.1", 2, "Storm", "Ray"), ("4.1", 3, "Lost", "Fox")], "issue string, ord int, title string, author string")
    extents = spark.createDataFrame([("4.1", 1, 5, 8), ("4.1", 2, 9, 9)], "issue string, ord int, start_page int, end_page int")
    texts = spark.createDataFrame([("4.1", 1, "Body")], "issue string, ord int, text string")
    got = [tuple(r)[2:] for r in journal.article_records(articles, extents, texts, "Journal").orderBy("ord").collect()]
    assert got == [
        ("Journal 4.1 Lee Calm.txt", "Journal Vol. 4.1\nTitle: The Calm\nAuthor: Lee\nPages: 5-8\n\nBody", None),
        ("Journal 4.1 Ray Storm.txt", "Journal Vol. 4.1\nTitle: Storm\nAuthor: Ray\nPages: 9-9\n\n", "empty"),
        ("Journal 4.1 Fox Lost.txt", None, "unmapped"),
    ]
