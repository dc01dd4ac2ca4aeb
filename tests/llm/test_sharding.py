import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestack.llm.sharding import jump_shard, op8_sharding, shard_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int"


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_equals_the_published_loop(spark):
    keys = [0, 1, 2, 7, 10**12, -1, -(2**63), 2**63 - 1] + list(range(1000, 1200))
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 25, 1000):
        for row in df.select("k", jump_shard("k", n).alias("s")).collect():
            assert row.s == jump(row.k, n)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    slots = defaultdict(list)
    for r in op8_sharding(spark, "/root/testdata/sf0.01").collect():
        raw = (docs.pop(r.doc_id) or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r.shard == jump(r.doc_id, 24) and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert not docs and len(slots) == 24
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_edge_rows(spark):
    rows = [(1, None, None, None, None, 9), (1, None, None, None, None, 9), (2, "", "en", "s", 0, 9), (None, "x", None, None, 1, 9), (3, "ä" * 200_000, "de", "s", 1, 9)]
    got = shard_documents(spark.createDataFrame(rows, SCHEMA), 3).collect()
    assert Counter(r.size for r in got) == Counter({8: 3, 9: 1, 400_008: 1})
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert shard_documents(spark.createDataFrame([], SCHEMA), 3).count() == 0


def test_one_more_shard_takes_its_share_only(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = shard_documents(df, 9).collect()
    moved = sum(r.shard != r.grown_shard for r in rows)
    assert all(r.grown_shard in (r.shard, 9) for r in rows) and 0.08 < moved / len(rows) < 0.12
