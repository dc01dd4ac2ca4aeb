import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm.bpe import byte_bpe
from lodestack.llm.packing import op2_packing, pack_documents, pack_histogram, places

SCHEMA = "doc_id long, text string, lang string, length long, offset long"


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 500), max_size=20))
def test_every_length_is_placed_once(counts):
    patterns = pack_histogram(counts, 32)
    assert all(sum(p) <= 32 for _, p in patterns)
    placed = Counter()
    for n, p in patterns:
        for x in p:
            placed[x] += n
    assert placed == Counter(counts)
    ranks = defaultdict(list)
    for length, a, b, *_ in places(patterns):
        ranks[length] += range(a, b)
    assert all(sorted(ranks[x]) == list(range(n)) for x, n in counts.items())


def test_lengths_beyond_the_size_are_refused():
    with pytest.raises(ValueError):
        pack_histogram({33: 1}, 32)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é\n\t' \x1c s,.1中 <|>"), max_size=40))
def test_ids_equal_the_library(library, text):
    for t in (text, text + "<|endoftext|> x"):
        assert np.frombuffer(byte_bpe().ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_ids_of_the_corpus_equal_the_library(spark, library):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(byte_bpe().ids(text), "<u4").tolist() == want.ids


def verify(rows, texts, library):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_doc) == sorted(texts)
    for doc, own in by_doc.items():
        ids = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return sum(r.length for r in rows) / (1024 * len(by_sequence))


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert verify(op2_packing(spark, "/root/testdata/sf0.001").collect(), texts, library) > 0.98


def test_edge_rows(spark, library):
    texts = {1: None, 2: "", 3: "word " * 30_000, 4: "x" * 3000, 5: "a <|endoftext|> b", 6: "  two  spaces \n "}
    rows = [(i, t, None, 7, 7) for i, t in texts.items()]
    verify(pack_documents(spark.createDataFrame(rows, SCHEMA)).collect(), texts, library)
    twice = pack_documents(spark.createDataFrame([(1, "same", None, 0, 0)] * 3, SCHEMA)).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == 3
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
