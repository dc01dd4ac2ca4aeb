import hashlib
import random

import numpy as np
import pytest

from lodestack.llm import suffix_dedup
from lodestack.llm.suffix_dedup import GRAM, anchors, dedup_substrings, maximal_repeats, op9_suffix_dedup, union

SCHEMA = "doc_id long, text string, lang string, doc long, n_spans string, _spans long"


def brute(rows, least=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept bytes) of rows with distinct keys."""
    first, out = {}, []
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - least + 1):
            if first.setdefault(raw[i : i + least], (doc, i)) != (doc, i):
                gone[i : i + least] = b"\1" * least
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        out.append((doc, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def ran(spark, rows, **more):
    df = spark.createDataFrame([(i, t, None, 1, "x", 1) for i, t in rows], SCHEMA).repartition(4)
    got = dedup_substrings(df, **more).collect()
    assert all(r.text == bytes(r.kept_bytes).decode("utf-8", "ignore") for r in got)
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got)


def corpus(seed, n):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices("abcdeé \n", k=k))
    passages = [text(rng.randint(70, 260)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            kind = rng.random()
            if kind < 0.3:
                p = text(rng.randint(1, 300))
            elif kind < 0.5:
                at = rng.randrange(len(p))
                p = p[:at] + rng.choice("xyz") + p[at:]
            elif kind < 0.7:
                p = p[rng.randrange(40) :]
            parts.append(p)
        rows.append((i * 3, "".join(parts)))
    return rows + [(1, "z" * 700), (2, "ab" * 90), (4, rows[0][1]), (5, None), (7, ""), (8, "q" * 99)]


def test_rows_that_share_a_key_are_documents_of_their_own(spark):
    rng = random.Random(3)
    text = lambda k: "".join(rng.choices("abcdefgh", k=k))
    passage = text(200)
    rows = [(1, passage), (1, text(400)), (2, "x" + passage), (1, passage), (None, text(300)), (None, "y" + passage)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in dedup_substrings(spark.createDataFrame([(i, t, None, 1, "x", 1) for i, t in rows], SCHEMA)).collect()}
    assert got == {(None, 201): 0, (None, 300): 0, (1, 200): 200, (1, 400): 0, (2, 201): 200}


@pytest.mark.parametrize("seed, patched", [(1, {}), (2, {"MANY": 2}), (3, {"SAMPLED": 1, "SAMPLED_MANY": 2}), (4, {"MANY": 8})])
def test_equals_brute_force(spark, monkeypatch, seed, patched):
    for name, value in patched.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = corpus(seed, 60)
    assert ran(spark, rows) == brute(rows)


def test_maximal_repeats_equal_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
        least = rng.randint(3, 8)
        want = {}
        for size in range(least, 41):
            at = {}
            for t, raw in enumerate(texts):
                for i in range(len(raw) - size + 1):
                    at.setdefault(raw[i : i + size], []).append((t, i))
            for spots in at.values():
                left = {texts[t][i - 1] if i else None for t, i in spots}
                right = {texts[t][i + size] if i + size < len(texts[t]) else None for t, i in spots}
                if len(spots) > 1 and (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
                    want[(size, tuple(sorted(spots)))] = 1
        got = {(size, tuple(sorted(spots))) for size, spots in maximal_repeats(texts, least)}
        assert got == set(want)


def test_each_window_holds_its_anchor(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 64)
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.integers(97, 100, 500, dtype=np.uint8), np.full(300, 97, np.uint8), rng.integers(97, 123, 500, dtype=np.uint8)])
    at, _ = anchors(data, 100)
    assert all(((at >= i) & (at <= i + 100 - GRAM)).any() for i in range(len(data) - 99)) and len(anchors(data[:99], 100)[0]) == 0
    whole = anchors(np.concatenate([data[700:], data[700:]]), 100)[0]
    assert set(at[(at >= 700 + 100)] - 700) <= set(whole)


def test_union():
    lo, hi = union(np.array([5, 0, 2, 9, 12]), np.array([6, 2, 4, 12, 13]))
    assert lo.tolist() == [0, 5, 9] and hi.tolist() == [4, 6, 13]


def test_edge_rows(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=300_000))
    rows = [(1, long), (2, "tail" + long[1000:1500]), (None, "x" * 150)]
    got = {r[0]: r for r in ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in dedup_substrings(spark.createDataFrame([(i, t, None, 1, "x", 1) for i, t in rows], SCHEMA)).collect())}
    assert got[1][2:] == (0, 0) and got[2][2:] == (500, 1) and got[None][2:] == (149, 1)
    assert ran(spark, []) == []
    same = dedup_substrings(spark.createDataFrame([(1, long[:400], None, 1, "x", 1)] * 2, SCHEMA)).collect()
    assert [r.n_removed for r in same] == [0, 0]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op9_suffix_dedup(spark, "/root/testdata/sf0.001").collect())
    assert got == [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute(rows)]
