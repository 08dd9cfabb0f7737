import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCAB), reason="no vocabulary")
TEXTS = ["", None, " ", "  a  b\n\n c", "<|endoftext|> hi", "é" * 300, "=" * 900, "日本語テキスト 混在", "\U0001f600\U0001f601 x", " " * 500, "don't WE'LL 'tis", "a" * 5000, "x\r\n\ty", "�​"]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.VOCAB.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def flat(rows):
    return [[i for w in r for i in w] for r in rows]


def test_texts(reference):
    assert flat(bpe.encode_texts(TEXTS)) == reference(TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_any_text(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.VOCAB.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    assert flat(bpe.encode_texts(texts)) == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_small_vocabulary_against_merging():
    ranks = {bytes([b]): b for b in range(256)}
    for n, word in enumerate(("ab", "bc", "abc", "aa", "aab", "ca")):
        ranks[word.encode()] = 256 + n
    encoder = bpe.TrieEncoder(ranks)
    import itertools

    words = [bytes(w) for k in range(1, 8) for w in itertools.product(b"abc", repeat=k)]
    assert all(encoder._merged(w) == ids for w, ids in encoder.encode_all(words))


def test_rows(spark, reference):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)] + [(None, "a b", 2), (0, "", 3)], "doc_id bigint, text string, ids int")
    got = bpe.encode(df).collect()
    assert len(got) == len(TEXTS) + 2
    by = {r["doc_id"]: r["ids"] for r in got if r["doc_id"]}
    assert by == {k: ids for k, ids in enumerate(reference(TEXTS)) if k}
    assert bpe.encode(df.where("false")).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df.where("doc_id > 0")).collect()} == {k: len(v) for k, v in by.items()}
