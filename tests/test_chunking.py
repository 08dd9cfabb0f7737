from pyspark.sql import functions as F

from lectern.operators import chunking


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_packed_intervals(spark):
    cases = [([3, 4, 60, 5, 5], [(0, 1), (0, 2), (3, 4)]), ([60, 60, 3], [(0, 0), (1, 1), (2, 2)]), ([20, 20, 20, 20], [(0, 1), (2, 3)]), ([20, 20, 18, 5], [(0, 1), (2, 3)]), ([], [])]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, l array<int>")
    got = {r["k"]: [tuple(x) for x in r["p"]] for r in df.select("k", chunking.packed_intervals(F.col("l"), 50, 20).alias("p")).collect()}
    assert got == {k: c[1] for k, c in enumerate(cases)}


def test_sections(spark):
    texts = [
        "intro\n## Section 1 – Alpha ([00:01:00]).\nbody a\n\n## Section 2 – Beta\nbody b",
        "## Section 1 – Alpha\nbody a\n\n## Section 2 – Beta\nbody b",
        "x\n## Section 1 – A\n## Section 2 – B\nbody",
        "x\n## Section 1 - A\nbody",
        None,
        "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = rows(chunking.section_chunks(df, "k", "t").select("k", "section_title", "text"), "k", "section_title")
    assert got == [(0, "Alpha", "[Alpha]\n\nbody a"), (0, "Beta", "[Beta]\n\nbody b"), (1, "Beta", "[Beta]\n\nbody b"), (2, "A", "[A]\n\n## Section 2 – B\nbody")]


def test_pages_and_sentences(spark):
    df = spark.createDataFrame([(1, "[PDF_PAGE:3]One. Two.\n[PDF_PAGE:4]Three."), (2, None), (3, " \n ")], "k int, t string")
    got = [tuple(x) for x in df.where("k = 1").select(F.explode(chunking.sentences(F.col("t"))).alias("s")).select("s.*").collect()]
    assert got == [("One.", 3), ("Two.", 3), ("Three.", 4)]
    assert rows(chunking.sentence_chunks(df, "k", "t"), "k") == [(1, 0, "One. Two. Three.", 3)]


def test_long_text_and_dispatch(spark):
    sentence = "word " * 30 + "end. "
    df = spark.createDataFrame([(1, sentence * 400), (2, "x\n## Section 1 – A\nbody"), (3, "x\n## Section 1 - A\nbody")], "doc_id bigint, text string")
    got = chunking.chunk_documents(df).collect()
    assert {r["doc_id"] for r in got} == {1, 2}
    assert all(len(r["text"]) <= 1500 + 200 for r in got) and len(got) > 40


def test_global_number_is_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = chunking.with_global_number(df, ["x"], "n").collect()
    assert sorted((r["x"], r["n"]) for r in got) == [(k, k) for k in range(1000)]
    assert chunking.with_global_number(df.where("false"), ["x"], "n").count() == 0


def test_running_numbers(spark):
    rows = [(k % 7, k, k % 4) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, k int, n int").repartition(5)
    numbered = {r["k"]: r["no"] for r in chunking.with_global_number(df, ["g", "k"], "no").collect()}
    summed = {r["k"]: r["before"] for r in chunking.running_total(df, ["g", "k"], "n", "before").collect()}
    total = 0
    for no, (_, k, n) in enumerate(sorted(rows)):
        assert numbered[k] == no and summed[k] == total
        total += n
    assert chunking.with_global_number(df.where("false"), ["g", "k"], "no").count() == 0
    assert chunking.running_total(df.where("false"), ["g", "k"], "n", "before").count() == 0


def test_positions_of_documents_that_share_a_name(spark):
    rows = [(1, "One. Two.", "txt", "p2", "a"), (2, "Three.", "pdf", "p1", "a"), (3, "Four.", "txt", "p1", None), (4, "Five.", "txt", None, None), (5, None, "txt", "p3", "a"), (6, "Six.", "txt", "p9", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, path string, doc_name string")
    got = [(r["id"], r["doc_name"], r["text"], r["chunk_pos"], r["doc_chunk_count"]) for r in chunking.chunk_table(df).orderBy("id").collect()]
    assert got == [(0, None, "Five.", 1, 2), (1, None, "Four.", 2, 2), (2, "a", "One. Two.", 1, 3), (3, "a", "Six.", 2, 3), (4, "a", "Three.", 3, 3)]
