import math
import random

import numpy as np

from lodestack.llm import langid
from lodestack.llm.langid import BLOCK, CrossParser, identify, learn, op1_langid, plain, suffix_automaton

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"


def test_automaton_knows_exactly_the_substrings():
    rng = random.Random(1)
    for _ in range(50):
        text = [rng.randrange(3) for _ in range(rng.randint(1, 20))]
        table = suffix_automaton(text, 3)
        subs = {tuple(text[a:b]) for a in range(len(text)) for b in range(a + 1, len(text) + 1)}
        for n in range(1, 5):
            for word in np.ndindex(*(3,) * n):
                state = 0
                for s in word:
                    state = table[state, s] if state >= 0 else -1
                assert (state >= 0) == (word in subs)


def brute_phrases(text, model):
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in model:
            size += 1
        n += 1
        at += size
    return n


def test_phrases_equal_brute_force():
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 6)))
    models = tuple((name, " ".join(word(letters) for _ in range(80))) for name, letters in (("a", "abcd"), ("b", "cdef")))
    own = CrossParser(models)
    texts = [" ".join(word("abcdef") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    got = own.phrases([own.symbols(t) for t in texts])
    for i, t in enumerate(texts):
        assert [got[0, i], got[1, i]] == [brute_phrases(t, m) for _, m in models]


def test_plain():
    assert plain("Été, 12_3\n ÜBER") == "été über"


def test_edge_rows(spark):
    de, en = "der die und das ist nicht ", "the and of to is that "
    train = [(i, de * 20, "de", None, None) for i in range(3)] + [(i, en * 20, "en", None, None) for i in range(3)] + [(9, None, "fr", None, None), (9, "x", None, None, None), (9, "12", "zz", None, None)]
    model = learn(spark.createDataFrame(train, SCHEMA))
    assert [name for name, _ in model] == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 !!\n"), (4, "Das ist die"), (5, "that is the"), (6, "that is the " * 50_000), (6, "that is the " * 50_000), (7, "中文字"), (None, "und das")]
    df = spark.createDataFrame([(i, t, None, "x", "y") for i, t in rows], SCHEMA)
    got = identify(df, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (1, 2, 3, 4, 5, 6, None)] == ["und"] * 3 + ["de", "en", "en", "de"]
    assert by[7].lang_pred in ("de", "en") and by[1].score == 0
    assert {r.lang_pred for r in identify(df, ()).collect()} == {"und"}
    assert learn(df.limit(0)) == () and identify(df.limit(0), model).count() == 0


def test_predictions_of_whole_long_texts_equal_brute_force(monkeypatch):
    rng = random.Random(7)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 6)))
    models = tuple((name, " ".join(word(letters) for _ in range(60))) for name, letters in (("a", "abcd"), ("b", "bcde"), ("c", "cdef")))
    own = CrossParser(models)
    texts = [" ".join(word(rng.choice(("abcd", "bcde", "cdef"))) for _ in range(rng.choice((1, 5, 40, BLOCK)))) for _ in range(30)]
    bits, letters = own.entropies(texts)
    for i, t in enumerate(texts):
        want = [math.log2(len(m) + 2) * brute_phrases(t, m) / len(t) for _, m in models]
        assert np.allclose(bits[i], want) and letters[i] == sum(c != " " for c in t)
        assert own.predict([t])[0] == [models[int(np.argmin(want))][0]]
    monkeypatch.setattr(langid, "SLICE", 7)
    monkeypatch.setattr(langid, "TOGETHER", 50)
    assert np.allclose(own.entropies([t.replace(" ", " 1, ") for t in texts])[0], bits)


def test_copies_do_not_fill_the_sample(spark):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))
    rows = [(i, "same words again " * 20, "en", None, None) for i in range(300)] + [(1000 + i, text(), "en", None, None) for i in range(100)]
    assert dict(learn(spark.createDataFrame(rows, SCHEMA)))["en"].count("same words again") <= 20


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = op1_langid(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
