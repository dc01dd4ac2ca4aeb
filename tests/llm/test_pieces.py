import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import pieces as module
from lodestack.llm.pieces import Pieces, encode_documents, op5_pieces, pieces

SCHEMA = "doc_id long, text string, lang string, ids string, n_pieces string"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def own():
    return pieces()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abethinor é\n\t.1中👍ﬁ<s>▁ "), max_size=40), max_size=5))
def test_ids_equal_the_library_and_come_back(library, own, texts):
    for text, ids in zip(texts, own.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text) and own.decode(ids) == text.replace("▁", " ")


def test_long_texts_without_spaces(library, own):
    rng = random.Random(2)
    texts = ["".join(rng.choices(a, k=3000)) for a in ("abcdet", "zz", "中文字的是了", "aéо1", "-=_")] + [" " * 700 + "a", "a" + " " * 300]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == library.encode(texts)


def test_acceptor_equals_merging(own):
    rng = random.Random(4)
    names = list(own.ids)
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(3000)] + [(n[:k], n[k:]) for n in rng.sample(names, 800) for k in range(1, len(n)) if n[:k] in own.ids and n[k:] in own.ids]
    got = own.accepts(np.array([own.ids[a] for a, _ in pairs], np.int32), np.array([own.ids[b] for _, b in pairs], np.int32))
    apart = [own.merged(a + b) == [a, b] for a, b in pairs]
    assert got.tolist() == apart and 0 < sum(apart) < len(apart)


def test_small_model_by_hand():
    names = ["<0x%02X>" % i for i in range(256)] + ["▁", "a", "b", "ab", "aba", "▁a"]
    model = Pieces(names, [0.0] * 256 + [-9.0, -9.0, -9.0, -1.0, -2.0, -1.0], {i: i for i in range(256)}, list(range(256, 262)))
    for text, want in [("", []), ("ab", ["▁a", "b"]), ("b", ["▁", "b"]), ("bab", ["▁", "b", "ab"]), ("bababa", ["▁", "b", "ab", "aba"]), ("é", ["▁", "<0xC3>", "<0xA9>"])]:
        assert [names[i] for i in np.frombuffer(model.encode(text), "<u4")] == want, text


def test_bounds_of_what_is_kept_change_nothing(own, monkeypatch):
    texts = [f"word{i} of  many {i * i}" for i in range(300)]
    want = own.encode_all(texts)
    for name, value in (("KEPT", 5), ("LONGEST", 2), ("CHARACTERS", 10)):
        monkeypatch.setattr(module, name, value)
    assert pieces().encode_all(texts) == want


def test_every_id_of_the_corpus(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in encode_documents(docs).collect()}
    assert set(got) == set(texts)
    for i, ids in zip(texts, library.encode(list(texts.values()))):
        raw = np.array(ids, "<u4").tobytes()
        assert bytes(got[i].ids) == raw and got[i].n_pieces == len(ids) and got[i].ids_crc32 == zlib.crc32(raw)
        assert got[i].decoded_sha256 == hashlib.sha256(texts[i].replace("▁", " ").encode()).hexdigest()


def test_query(spark):
    assert op5_pieces(spark, "/root/testdata/sf0.001").count() == 200


def test_edge_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "word " * 20_000), (3, "word " * 20_000), (None, "x"), (5, "z" * 5000)]
    df = spark.createDataFrame([(i, t, None, "x", "y") for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in encode_documents(df).collect()}
    assert got[1].n_pieces == got[2].n_pieces == 0 and got[3].n_pieces == len(library.encode("word " * 20_000)) and got[5].n_pieces == len(library.encode("z" * 5000))
    assert encode_documents(df.limit(0)).count() == 0
