import hashlib
import random
from collections import defaultdict

import pytest

from lodestack.llm.line_dedup import dedup_lines, op4_line_dedup, twice_seen

SCHEMA = "doc_id long, text string, lang string, n_lines string, _gone long, _key long"
SPACE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, min_chars=1, keep_first=False):
    """(doc_id, n_lines, n_dropped, text) of each row."""
    key = lambda x: x.strip(SPACE).translate(LOWER)
    held, first = defaultdict(set), {}
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            held[key(line)].add(doc)
            first[key(line)] = min(first.get(key(line), (doc, n)), (doc, n))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stays = [x for n, x in enumerate(lines) if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or (keep_first and first[key(x)] == (doc, n))]
        out.append((doc, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return sorted(out)


def ran(spark, rows, **more):
    df = spark.createDataFrame([(i, t, None, "x", 5, 5) for i, t in rows], SCHEMA).repartition(3)
    return sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(df, **more).collect())


def rows_of(seed):
    rng = random.Random(seed)
    pool = ["", " ", "Same Line", "same line \t", "ÄB", "äb", "é", "z", "\x0bpad\r", *(f"line {i}" for i in range(12))]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(60)]
    return [*rows, (100, None), (101, ""), (102, "\n"), (103, "z\n" * 50_000), (104, "x" * 300_000)]


@pytest.mark.parametrize("more", [{}, {"broadcast_keys": 0}, {"max_bits": 512}, {"keep_first": True}, {"keep_first": True, "broadcast_keys": 0}, {"min_chars": 2}])
def test_equals_brute_force(spark, more):
    rows = rows_of(len(more))
    plain = {k: v for k, v in more.items() if k in ("keep_first", "min_chars")}
    assert ran(spark, rows, min_docs=5, **more) == brute(rows, 5, **plain)


def test_rows_that_repeat_a_key_count_once(spark):
    rows = [(1, "a\nb")] * 10 + [(2, "b"), (3, "c"), (3, "c\nd"), (4, "c\nd"), (None, "e"), (None, "e"), (5, "e\nf")]
    for least in (2, 3, 10):
        got = ran(spark, [r for r in rows if r[0] is not None], min_docs=least)
        assert got == brute([r for r in rows if r[0] is not None], least)
    nulls = spark.createDataFrame([(i, t, None, "x", 5, 5) for i, t in rows], SCHEMA)
    assert {(r.doc_id, r.text) for r in dedup_lines(nulls, min_docs=2).collect() if r.doc_id in (None, 5)} == {(None, ""), (5, "f")}
    assert {(r.doc_id, r.text) for r in dedup_lines(nulls, min_docs=3).collect() if r.doc_id is None} == {(None, "e")}


def test_filter_holds_every_repeat_and_few_others(spark):
    df = spark.createDataFrame([(f"own {i}\nshared {i // 2}",) for i in range(4000)], "text string").repartition(5)
    full = twice_seen(df)
    share = sum(bin(x).count("1") for x in full.tolist()) / (len(full) * 8)
    assert 0.003 < share < 0.02


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in op4_line_dedup(spark, "/root/testdata/sf0.001").collect())
    assert got == [(*x[:3], hashlib.sha256(x[3].encode()).hexdigest()) for x in brute(rows, 10)]


def test_empty_table(spark):
    assert ran(spark, []) == []
