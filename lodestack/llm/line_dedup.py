"""Line deduplication: two Bloom filters find suspected repeats, and only these are counted exactly.

Pass one hashes each document's distinct line keys. Every task sends the bit
positions that it saw once, and those it saw at least twice, in segments; the
merge of a segment turns a bit that two tasks saw once into one seen twice. Pass
two probes the twice-seen filter and emits the keys that may repeat, as 128-bit
digests; a count by digest confirms them. Lines of confirmed keys go, either
everywhere or everywhere but at their first occurrence.

The filter has a fixed ceiling of bits. Below it, few unrepeated keys are
suspected; beyond it ever more are, which costs shuffle but never a result. The
confirmed keys are broadcast only up to a checked number; beyond that they are
joined, salted, to the suspects and by document to the texts.

Defined results: a null text is one empty line; empty keys stay; rows that repeat
a document's key, or have none, count as one document; an empty table gives an
empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.names import fresh
from lodestack.runtime import materialize

SPACE = b" \t\n\x0b\x0c\r"
SEGMENTS = 64
BITS_PER_LINE = 16
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
#: So many confirmed keys are broadcast at most.
BROADCAST_KEYS = 500_000
SALTS = 16


def line_keys(text: bytes, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines, and each one's key or None where it is shorter than ``min_chars`` code points."""
    lines = text.split(b"\n")
    keys = [x.strip(SPACE).lower() for x in lines]
    return lines, [k if (len(k) >= min_chars and (min_chars < 2 or len(k.decode("utf-8", "replace")) >= min_chars)) else None for k in keys]


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def _positions(keys: list[bytes], bits: int) -> np.ndarray:
    """Two bit positions for each key, as an array of shape (keys, 2)."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits.bit_length() + 1)], 1).astype(np.int64)


def _sparse(positions: np.ndarray) -> bytes:
    return zlib.compress(np.diff(positions, prepend=0).astype("<u4").tobytes(), 1)


def _dense(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.int64)


def _seen(column: str, bits: int, min_chars: int):
    """Per task and segment: the positions that its documents' keys set once, and those set at least twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            found = []
            for text in _texts(batch, column):
                found += {k for k in line_keys(text, min_chars)[1] if k is not None}
            at, n = np.unique(_positions(found, bits), return_counts=True)
            twice = np.union1d(twice, np.concatenate([at[n > 1], np.intersect1d(at, once, assume_unique=True)]))
            once = np.union1d(once, at)
        width = bits // SEGMENTS
        cut = lambda a: np.split(a, np.searchsorted(a, np.arange(1, SEGMENTS) * width))
        rows = [(s, a - s * width, b - s * width) for s, (a, b) in enumerate(zip(cut(once), cut(twice))) if len(a)]
        yield pa.RecordBatch.from_pydict({"segment": pa.array([s for s, *_ in rows], pa.int32()), "once": pa.array([_sparse(a) for _, a, _ in rows], pa.binary()), "twice": pa.array([_sparse(b) for *_, b in rows], pa.binary())})

    return run


def _merged(bits: int):
    """The twice-seen bits of each segment, from all tasks' pieces, read one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = bits // SEGMENTS
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                once, twice = held.setdefault(row["segment"], (np.zeros(width, bool), np.zeros(width, bool)))
                at = _dense(row["once"])
                twice[at[once[at]]] = True
                twice[_dense(row["twice"])] = True
                once[at] = True
        yield pa.RecordBatch.from_pydict({"segment": pa.array(list(held), pa.int32()), "bits": pa.array([zlib.compress(np.packbits(t).tobytes(), 1) for _, t in held.values()], pa.binary())})

    return run


def twice_seen(docs: DataFrame, column: str = "text", min_chars: int = 1, max_bits: int = MAX_BITS) -> np.ndarray:
    """The packed twice-seen filter of all documents' line keys, of ``max_bits`` at most."""
    lines = docs.agg(F.sum(F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit("\n")) + 1)).first()[0] or 0
    bits = min(max_bits, max(MIN_BITS, 1 << int(BITS_PER_LINE * lines).bit_length()))
    seen = docs.select(column).mapInArrow(_seen(column, bits, min_chars), "segment int, once binary, twice binary")
    merged = seen.repartition(SEGMENTS, "segment").mapInArrow(_merged(bits), "segment int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    width = bits // SEGMENTS // 8
    for row in merged.collect():
        out[row["segment"] * width : (row["segment"] + 1) * width] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _suspects(key: str, column: str, min_chars: int, shared):
    """One row per document and distinct key that the filter suspects: digest, document and first line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in batches:
            owner, lines, keys = [], [], []
            for i, text in enumerate(_texts(batch, column)):
                first: dict[bytes, int] = {}
                for n, k in enumerate(line_keys(text, min_chars)[1]):
                    if k is not None:
                        first.setdefault(k, n)
                owner += [i] * len(first)
                keys += first
                lines += first.values()
            at = _positions(keys, len(packed) * 8)
            hit = np.flatnonzero((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1))
            docs = batch.column(batch.schema.get_field_index(key)).take(pa.array([owner[i] for i in hit], pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, pa.array([_digest(keys[i]) for i in hit], pa.binary()), pa.array([lines[i] for i in hit], pa.int64())], ["_doc", "_key", "_line"])

    return run


def _without(column: str, min_chars: int, of_row, schema: pa.Schema):
    """Takes the marked lines out. ``of_row`` gives, for a batch, a function from row and digest to (gone, line kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = of_row(batch)
            texts, n_lines, n_dropped = [], [], []
            for i, text in enumerate(_texts(batch, column)):
                lines, keys = line_keys(text, min_chars)
                kept = [x for n, (x, k) in enumerate(zip(lines, keys)) if k is None or not gone(i, _digest(k), n)]
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            new = {column: pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[name] if name in new else batch.column(batch.schema.get_field_index(name)) for name in schema.names], schema.names)

    return run


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, key: str = "doc_id", column: str = "text", max_bits: int = MAX_BITS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The documents without the lines whose key is found in at least ``min_docs`` of them.

    With ``keep_first`` the key's first line stays in the document with the
    smallest ``key``. Columns ``n_lines`` (before) and ``n_dropped`` are added,
    or replaced where the table has them.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    kind = docs.schema[key].dataType
    shared = spark.sparkContext.broadcast(twice_seen(docs, column, min_chars, max_bits))
    found = T.StructType([T.StructField("_doc", kind), T.StructField("_key", T.BinaryType()), T.StructField("_line", T.LongType())])
    suspects = docs.select(key, column).mapInArrow(_suspects(key, column, min_chars, shared), found)
    # A row for each key and document, then a plain count; both are combined on the map side.
    held = suspects.groupBy("_key", "_doc").agg(F.min("_line").alias("_line"))
    counted = held.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_doc", "_line")).alias("_first"))
    confirmed = materialize(counted.where(F.col("_n") >= min_docs).select("_key", F.col("_first._doc").alias("_first_doc"), F.col("_first._line").alias("_first_line")), "lines")
    out = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    schema = pa.schema([pa.field(f.name, pa.null()) for f in out.fields])

    if confirmed.count() <= broadcast_keys:
        firsts = {bytes(r["_key"]): (r["_first_doc"], r["_first_line"]) for r in confirmed.collect()}
        known = spark.sparkContext.broadcast(firsts)

        def of_table(batch):
            table, ids = known.value, batch.column(batch.schema.get_field_index(key)).to_pylist()
            return lambda i, digest, n: digest in table and not (keep_first and table[digest] == (ids[i], n))

        return docs.mapInArrow(_without(column, min_chars, of_table, schema), out)

    salted = confirmed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    marked = suspects.withColumn("_salt", F.pmod(F.xxhash64("_doc"), F.lit(SALTS)).cast("int")).join(salted, ["_key", "_salt"])
    stays = F.when(F.lit(keep_first) & F.col("_doc").eqNullSafe(F.col("_first_doc")), F.col("_first_line")).otherwise(F.lit(-1))
    doc, marks = fresh(docs, "_doc"), fresh(docs, "_gone")
    lists = marked.groupBy(F.col("_doc").alias(doc)).agg(F.collect_set(F.struct(F.col("_key").alias("k"), stays.alias("n"))).alias(marks))
    joined = docs.join(lists, docs[key].eqNullSafe(lists[doc]), "left").drop(doc)

    def of_lists(batch):
        gone = [{x["k"]: x["n"] for x in row or ()} for row in batch.column(batch.schema.get_field_index(marks)).to_pylist()]
        return lambda i, digest, n: digest in gone[i] and gone[i][digest] != n

    return joined.mapInArrow(_without(column, min_chars, of_lists, schema), out)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with l as (select doc_id, at_, line, lower_key from (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) as at_ from documents)
  , lateral (select translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_key)),
gone as (select lower_key from l where lower_key <> '' group by lower_key having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines, count(g.lower_key)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by at_) filter (where g.lower_key is null), '')) as kept_sha256
from l left join gone g using (lower_key) group by doc_id
"""
