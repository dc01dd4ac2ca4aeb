"""Sharding by jump consistent hashing, in DataFrame expressions alone.

A 64-bit key walks through an arithmetic sequence of jumps; the last jump that
lands below the number of shards is the key's shard. There is no ring table, and
one more shard takes its fair part of the rows and moves no other row.

Defined results: a null key counts as key 0; repeated rows get equal shards and
slots of their own, in the order of key, checksum and size; an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.names import fresh
from lodestack.runtime import materialize

# The multiplier of the published generator, and 2^64.
MULTIPLIER = 2862933555777941757
TWO_64 = 18446744073709551616
#: Jumps that are walked up to this many shards; beyond it as many as the logarithm of their number, 40 times over.
MAX_JUMPS = 128


def _jumps(shards: int) -> int:
    """A bound of a key's jumps: one for each shard at most; a key that jumps 40 times as often as usual does not occur."""
    return min(shards, max(MAX_JUMPS, 40 * shards.bit_length()))


def jump_shard(key: str, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of the integer column ``key`` (its 64 bits, unsigned)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    whole = f"cast(coalesce(`{key}`, 0) as decimal(20,0))"
    state = "named_struct('k', {k}, 'b', {b}, 'j', {j})"
    start = state.format(k=f"cast(if({whole} < 0, {whole} + {TWO_64}, {whole}) as decimal(20,0))", b="-1L", j="0L")
    # Products stay below 10^38, so that decimals hold them without overflow.
    drawn = f"cast((s.k * cast({MULTIPLIER} as decimal(19,0)) + 1) % cast({TWO_64} as decimal(20,0)) as decimal(20,0))"
    moved = f"cast((s.j + 1) * (2147483648D / cast(({drawn} div 8589934592) + 1 as double)) as bigint)"
    step = f"if(s.j < {shards}, {state.format(k=drawn, b='s.j', j=moved)}, s)"
    return F.expr(f"cast(aggregate(sequence(1, {_jumps(shards)}), {start}, (s, i) -> {step}, s -> s.b) as int)")


def with_slots(df: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Adds ``slot``: 0, 1, 2 ... within each shard, in the order of the columns ``order``, without a gap.

    A shard may be far larger than a task's memory, so rows are sorted by ranges
    of shard and order: a slot is the number of the shard's rows in earlier
    ranges plus the place among those of its own. There is a row of counts for
    each range, and one more for each shard.
    """
    at, part, before, first = (fresh(df, n) for n in ("_at", "_part", "_before", "_first"))
    placed = materialize(df.orderBy(shard, *order).withColumn(at, F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn(part, F.shiftrightunsigned(at, 33))
    counts = placed.groupBy(shard, part).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias(first))
    earlier = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard).alias("_shard"), F.col(part).alias("_range"), first, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(before))
    joined = placed.join(F.broadcast(starts), placed[shard].eqNullSafe(starts["_shard"]) & (placed[part] == starts["_range"]))
    return joined.withColumn("slot", (F.col(before) + F.col(at) - F.col(first)).cast("long")).drop(at, part, before, first, "_shard", "_range")


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its size, the text's checksum, its shard now and with one shard more, and its slot.

    The size is the text's UTF-8 bytes (null: none) plus 8 for the key.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
    )
    rows = rows.withColumn("shard", jump_shard("doc_id", shards)).withColumn("grown_shard", jump_shard("doc_id", shards + 1))
    # Written first: sorting by ranges looks at the rows twice.
    return with_slots(materialize(rows, "rows"), "shard", ["doc_id", "text_crc32", "size"])


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs, 24).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


ORACLE = r"""
with recursive bits as (select n, n as c, 0 as i from (select unnest(range(0, 256))::bigint as n)
  union all select n, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i + 1 from bits where i < 8),
crcs as (select list(c order by n) as t from bits where i = 8),
raw as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
sums as (select doc_id, octet_length(encode(text)) + 8 as size,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::bigint)),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295::bigint) as text_crc32 from raw, crcs),
walk as (select doc_id, doc_id::uhugeint as k, -1::bigint as b, 0::bigint as j, 0 as n from documents
  union all select doc_id, d, j, floor((j + 1) * (2147483648::double / ((d // 8589934592) + 1)::double))::bigint, n from (
    select *, (k * 2862933555777941757::uhugeint + 1) % 18446744073709551616::uhugeint as d from walk where j < 25)),
shards as (select doc_id, max(case when j >= 24 and b < 24 then b end) as a, max(case when j >= 25 then b end) as g from walk group by doc_id)
select doc_id, size, text_crc32, 'key' as law, a::int as shard, row_number() over (partition by a order by doc_id) - 1 as slot, g::int as grown_shard
from sums join shards using (doc_id)
"""
