import pytest

from chunkloom.llm import sentences as S


@pytest.fixture(scope="module")
def model(spark, sf):
    return S.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def cut(text, model, kind=None):
    out, at = [], 0
    for e in S.sentence_ends(text, kind, model):
        out.append(text[at:e].strip())
        at = e
    return out


CASES = [
    ("The cache waits ... for nothing. It took Mrs. Benduka 3 runs.", ["The cache waits ... for nothing.", "It took Mrs. Benduka 3 runs."]),
    ("We saw 0.15 s for 15 caches, i.e. 15.5% more than in v1.2. The scanner (see no. 12, p. 40) stops! Is it?", ["We saw 0.15 s for 15 caches, i.e. 15.5% more than in v1.2.", "The scanner (see no. 12, p. 40) stops!", "Is it?"]),
    ('"Is it done?" asked the reviewer. The cursor keeps logs, dumps, etc. The log ends', ['"Is it done?" asked the reviewer.', "The cursor keeps logs, dumps, etc.", "The log ends"]),
    ("索引器跳过「請重試。谢谢！」字样。缓存比较旧的哈希值？", ["索引器跳过「請重試。谢谢！」字样。", "缓存比较旧的哈希值？"]),
    ("แคชเก็บแฮชเก่า งานกลางคืนเก็บชื่อเต็มภายใน 3.5 วินาที แคชรวมหน้าว่าง", ["แคชเก็บแฮชเก่า", "งานกลางคืนเก็บชื่อเต็มภายใน 3.5 วินาที", "แคชรวมหน้าว่าง"]),
    ("यह मॉड्यूल डॉ. वेलमोरा के अनुसार है। सूचक खाली है?", ["यह मॉड्यूल डॉ. वेलमोरा के अनुसार है।", "सूचक खाली है?"]),
    ("# 1.2 Heading one\n\n- first entry\n- second entry.\n\n1. one\n2. two\n\n```\nx. Y.\n\nz\n```\nTail", ["# 1.2 Heading one", "- first entry", "- second entry.", "1. one", "2. two", "```\nx. Y.\n\nz\n```", "Tail"]),
    ("The line break alone\nis no end. Two\r\nlines.", ["The line break alone\nis no end.", "Two\r\nlines."]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(model, text, want):
    assert cut(text, model) == want


def test_german_ordinals_and_names(model):
    assert cut("Der Speicher meldet das seit dem 14. März. Ein Leser misst es laut Hr. Dorvin.", model) == ["Der Speicher meldet das seit dem 14. März.", "Ein Leser misst es laut Hr. Dorvin."]


def test_comment_and_thread_signs(model):
    assert cut("// One line of\n// text. Another\n//\n// Third", model, "comment") == ["// One line of\n// text.", "Another", "//\n// Third"]
    assert cut("velmo: The cache. It ends\n\ntikka: More", model, "thread") == ["velmo: The cache.", "It ends", "tikka: More"]


def test_blank_texts(model):
    for text in (None, "", "  \n\t", "​ ﻿", "\n\n"):
        assert S.sentence_ends(text, None, model) == []


def test_held_out_accuracy(spark, model):
    """Reliable candidates of other documents than those of the fit."""
    hits = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null").limit(1500).collect():
        found = [b for b in S.blocks(r.text, r.doc_type) if not b.code]
        starts = [(m[0] if (m := S._WORD.search(b.text, b.lead)) else "") for b in found]
        for k, b in enumerate(found):
            for f, y in S.reliable(b, starts[(k + 1) % len(found)], model.counts):
                hits += (model.weights[f].sum() > 0) == bool(y)
                total += 1
    assert total > 2000 and hits / total > 0.97


def test_frames(spark, model):
    df = spark.createDataFrame([(1, "The cache ends. More", "x"), (1, "The cache ends. More", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, end_pos string")
    assert {tuple(r) for r in S.sentence_boundaries(df, model).distinct().collect()} == {(1, 15), (1, 20)}
    assert S.sentence_boundaries(df.limit(0)).count() == 0
    assert S.sentence_boundaries(df).distinct().count() >= 1


def test_words_of_any_length_are_read_whole():
    word = "Abk" + "x" * 60
    assert [c.left for c in S.candidates(f"It has {word}. More", 0)] == [word]
    assert [c.left for c in S.candidates("see e.g. that. And 3. No", 0)] == ["e", "e.g", "that", "3"]


def test_frequent_words_have_counts_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(S, "NAMED", 10)
    monkeypatch.setattr(S, "BUCKETS", 4)
    df = spark.createDataFrame([(n, "often often often rare%d. End" % n, "x") for n in range(20)], "doc_id long, text string, doc_type string")
    counts = S.word_counts(df)
    assert counts.at("often") < len(counts.named) <= 10 and counts.free[counts.at("often")] == 60
    assert counts.at("rare3") >= len(counts.named) and len(counts.stop) == len(counts.named) + 4
