import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.llm import tokenize as K

PIECES = st.lists(st.sampled_from(["'", "'s", "'ll", "re", " ", "  ", "\n", "\t", "a", "Z", "é", "日本", "1", "23", "!", "..", "\xa0", " ab", "ve", "\U0001f600", "<|endoftext|>", "​"]), max_size=60)


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(K, "LEAF_CHARS", 5)
    monkeypatch.setattr(K, "WINDOW_CHARS", 4)
    return K.tokenizer(K.default_vocabulary())


def test_tree_reduction_equals_direct_encoding(small):
    @settings(max_examples=400, deadline=None)
    @given(PIECES)
    def check(parts):
        s = "".join(parts)
        ids = list(small.encode_all([s])[0])
        assert ids == small.encoding.encode_ordinary(s)
        assert small.decode(ids) == s

    check()


def test_equals_the_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(K.default_vocabulary().replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    text = ("The cache isn't   full — 3.5 ms!\n\tdef f(x): pass <|endoftext|> héé 日本語 " * 300)
    assert list(K.tokenizer(K.default_vocabulary()).encode_all([text])[0]) == other.encode(text, add_special_tokens=False).ids


def test_long_single_piece():
    t = K.tokenizer(K.default_vocabulary())
    s = "a" * 30_000
    assert list(t.encode_all([s])[0]) == t.encoding.encode_ordinary(s)


def test_corpus(spark):
    df = spark.createDataFrame([(1, "hello world", 7), (2, None, 8), (3, "", 9), (3, "x", 9)], "doc_id long, text string, ids int")
    got = K.encode_corpus(df)
    assert got.columns == ["doc_id", "ids"]
    rows = sorted((r.doc_id, list(r.ids)) for r in got.collect())
    assert rows[1:3] == [(2, []), (3, [])] and len(rows) == 4
    assert {(r.doc_id, r.text) for r in K.decode_corpus(got).collect()} == {(1, "hello world"), (2, ""), (3, ""), (3, "x")}
    assert K.encode_corpus(df.limit(0)).count() == 0
