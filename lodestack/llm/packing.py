"""Packing token sequences: shortest-pack-first over the histogram of lengths.

Documents are cut into pieces of at most ``size`` tokens. Only the histogram of
piece lengths, at most ``size`` numbers, comes to the driver. There, lengths are
placed from the longest to the shortest, each into the open packing patterns
with the most room; a pattern is a tuple of lengths with a count of sequences.
Patterns go back to the pieces by rank: piece number r among the pieces of its
length takes the place that covers r. Ranks are counted in parallel buckets, so
no task holds all pieces of a frequent length.

Defined results: a null text is empty and gives its ending id alone; repeated
rows get places of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.bpe import byte_bpe
from lodestack.runtime import materialize

SIZE = 1024
END = b"\0\0\0\0"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = byte_bpe().ids
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text or "") + END
                total = len(ids) // 4
                rows += [(doc, a, min(size, total - a), zlib.crc32(ids[4 * a : 4 * (a + size)]), total) for a in range(0, total, size)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    return run


def pieces(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Each document's ids with its ending id, cut into full pieces and a rest."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_cut(size), PIECES)


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, pattern) for a histogram of lengths; each pattern's lengths sum to at most ``size``."""
    if any(not 0 < length <= size for length in counts):
        raise ValueError("lengths go from 1 to the size of a sequence")
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = max((r for r, packs in by_room.items() if packs), default=0)
            if room < length:
                by_room[size - length].append((left, (length,)))
                break
            count, pattern = by_room[room].pop()
            used = min(count, left)
            if count > used:
                by_room[room].append((count - used, pattern))
            by_room[room - length].append((used, (*pattern, length)))
            left -= used
    return [x for room in sorted(by_room) for x in by_room[room]]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, offset) of each place in each pattern."""
    given: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            out.append((length, given[length], given[length] + count, sequence, offset))
            given[length] += count
            offset += length
        sequence += count
    return out


def _ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds ``_rank`` among the rows of one length; a length with n rows is dealt into about sqrt(n) buckets."""
    buckets = F.array(*[F.lit(int(counts.get(n, 0) ** 0.5) + 1) for n in range(max(counts) + 1)])
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.get(buckets, F.col("length").cast("int"))).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start")
    return dealt.withColumn("_row", F.row_number().over(within)).join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1).drop("_bucket", "_row", "_before")


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces. ``cut`` is read three times: give a written table."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = "length long, _from long, _to long, _first long, offset long"
    if not counts:
        return cut.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    found = places(pack_histogram(counts, size))
    # Each step ends a length or a pattern's count, so places grow with the number of lengths, not with the rows.
    table = F.broadcast(spark.createDataFrame(found, schema))
    ranked = _ranked(cut, counts)
    joined = ranked.join(table, (ranked["length"] == table["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(table["length"])
    return joined.select(*cut.columns, (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, size: int = SIZE) -> DataFrame:
    return pack(materialize(pieces(docs, size), "pieces"), size)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
