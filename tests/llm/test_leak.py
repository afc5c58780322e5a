import random

import pytest

from chunkloom.llm import leak as K

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("bdfgklmnprstvz") + RNG.choice("aeiou") for _ in range(RNG.randint(2, 4))) for _ in range(400)]
ITEM = [RNG.choice(WORDS) for _ in range(60)]
FILL = [RNG.choice(WORDS) for _ in range(200)]


def hit(doc_words):
    index = K.build_index([(1, " ".join(ITEM))])
    return bool(list(K.leaks_in(index, [" ".join(doc_words)])))


def doc(passage):
    return FILL[:50] + passage + FILL[50:]


@pytest.mark.parametrize("n,want", [(60, True), (30, True), (18, True), (17, False), (10, False)])
def test_exact_passages(n, want):
    assert hit(doc(ITEM[20 : 20 + n] if n < 40 else ITEM)) is want


def test_changed_and_left_out_words():
    p = ITEM[:40]
    every8 = [w if k % 8 != 4 else "zzqq" for k, w in enumerate(p)]
    every4 = [w if k % 4 != 2 else "zzqq" for k, w in enumerate(p)]
    dropped = [w for k, w in enumerate(p) if k % 9 != 4]
    assert hit(doc(every8)) and hit(doc(dropped)) and not hit(doc(every4))


def test_folding():
    text = " ".join(ITEM[:24])
    index = K.build_index([(1, text)])
    forms = [text.upper(), text.replace("o", "о").replace("a", "а"), "".join(c + "​" for c in text), "> " + text.replace(" ", "\n> "), text.replace(" ", " <b>", 1).replace(" ", "</b> ", 1), "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in text), "**" + text.replace(" ", ", ") + "**", text.replace(" ", "\\n"), text.replace(" ", "")]
    got = {n for n, _ in K.leaks_in(index, forms)}
    assert got == set(range(len(forms)))


def test_broken_encoding():
    item = " ".join(f"{w}é" for w in ITEM[:24])
    broken = item.encode().decode("cp1252")
    assert list(K.leaks_in(K.build_index([(1, item)]), [broken])) == [(0, 1)]


def test_against_brute_force():
    """Random mixtures of item words and noise: the filter must not lose what alignment alone would find."""
    index = K.build_index([(1, " ".join(ITEM))])
    rng = random.Random(3)
    for _ in range(60):
        words = []
        for w in ITEM[: rng.randint(18, 60)]:
            r = rng.random()
            if r > 0.12:
                words.append(w)
            elif r > 0.06:
                words.append(rng.choice(WORDS))
        words = doc(words)
        at = K.np.concatenate([[0], K.np.cumsum([len(w) for w in words])])
        brute = K.align(index.words[0], index.starts[0], words, at, -10_000, 10_000)
        assert hit(words) == brute


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_CHARS", 200)
    items = spark.createDataFrame([(9, " ".join(ITEM), "x"), (8, " ".join(ITEM), "x"), (7, "too short", "x"), (6, None, "x"), (None, " ".join(ITEM), "x")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(1, " ".join(doc(ITEM))), (1, " ".join(doc(ITEM))), (2, None), (3, ""), (None, " ".join(ITEM)), (4, "x" * 100_000)], "doc_id long, text string")
    assert sorted(map(tuple, K.find_leaks(docs, items).collect())) == [(1, 8), (1, 9)]
    assert K.find_leaks(docs, items.limit(0)).count() == 0 and K.find_leaks(docs.limit(0), items).count() == 0


def by_definition(item, words):
    """Every start and every run of changed, left out and (up to eight) added words, nothing pruned: the reference for ``align``."""
    for i0 in range(len(item)):
        for j0 in range(len(words)):
            if item[i0] != words[j0]:
                continue
            todo, seen = [(i0, j0, 0, 0, 0)], set()
            while todo:
                i, j, errors, credit, debt = todo.pop()
                if (i, j, errors, credit, debt) in seen or errors > (len(item) - i0) // 8:
                    continue
                seen.add((i, j, errors, credit, debt))
                if i < len(item) and j < len(words) and item[i] == words[j]:
                    rest = max(0, debt - 2)
                    if not rest and i + 1 - i0 >= 18 and errors <= (i + 1 - i0) // 8:
                        return True
                    todo.append((i + 1, j + 1, errors, credit + 2, rest))
                if i > i0 and i < len(item):
                    todo += [(i + 1, j, errors + 1, credit, debt)] + ([(i + 1, j + 1, errors + 1, credit, debt)] if j < len(words) else [])
                if credit and j < len(words) and debt < 8:
                    todo.append((i, j + 1, errors, credit - 1, debt + 1))
    return False


@pytest.mark.parametrize("wrong", [[17], [2], [15, 17], [2, 4], [2, 3], [16, 17], [2, 17]])
def test_errors_beside_the_ends(wrong):
    passage = ITEM[20:38]
    assert hit(doc(["zzqq" if k + 1 in wrong else w for k, w in enumerate(passage)]))
    for k in reversed(wrong):
        del passage[k - 1]
    assert hit(doc(passage))


def test_align_against_the_definition():
    rng = random.Random(11)
    item = ITEM[:24]
    seen = {True: 0, False: 0}
    for _ in range(300):
        words = []
        for w in item[rng.randint(0, 4) : 24 - rng.randint(0, 3)]:
            r = rng.random()
            words += ["zzqq"] if r < 0.07 else [] if r < 0.12 else [w, "vvkk"] if r < 0.17 else [w]
        words = FILL[:2] + words + FILL[2:4]
        at = lambda x: K.np.concatenate([[0], K.np.cumsum([len(w) for w in x])])
        want = by_definition(item, words)
        seen[want] += 1
        assert K.align(item, at(item), words, at(words), -10_000, 10_000) is want, words
    assert min(seen.values()) > 60


SENTENCE = "every nightly report lists which cached shards were rebuilt after the operator changed their replica count and why that took longer than planned".split()


def hits(text):
    return list(K.leaks_in(K.build_index([(1, " ".join(SENTENCE))]), [text]))


def test_long_tags_are_markup():
    link = '<a href="https://example.org/' + "p/" * 130 + '" title="x > y">'
    w = SENTENCE[:18]
    assert hits(" ".join(w[:7]) + f" {link}{w[7]}</a> " + " ".join(w[8:]))
    assert hits("if a <b " + " ".join(SENTENCE) + "\nand c> d")


@pytest.mark.parametrize("size", [2, 3, 4, 18])
def test_glued_words_of_any_length(size):
    w = SENTENCE[:18]
    w[5] = "zzzz"
    assert hits(" ".join("".join(w[i : i + size]) for i in range(0, 18, size)))


def test_words_that_hold_item_words_stay_whole():
    assert K._parted(["another", "shardlist"], ["other", "shard", "list"]) == ["another", "shard", "list"]
