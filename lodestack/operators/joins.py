"""Joins of questions, documents, chunks, retrieved ids and evidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as fn
from lodestack.functions.metrics import bound
from lodestack.runtime import materialize

#: A table of keys with at most so many rows is sent to the documents; a larger one is shuffled with them.
SENT_KEYS = 200_000


def questions_with(qas: DataFrame, rows: DataFrame, key: str = "_id", doc: str = "doc_id") -> DataFrame:
    """Questions with the chunks, splits or document of theirs; a question without any is out, see ``unmatched``."""
    return qas.join(rows.withColumnRenamed(doc, "_doc"), F.col(key) == F.col("_doc")).drop("_doc")


def unmatched(qas: DataFrame, rows: DataFrame, key: str = "_id", doc: str = "doc_id") -> DataFrame:
    """The audit of ``questions_with``: the keys of questions that found nothing, with how many questions they have."""
    known = rows.select(F.col(doc).alias("_doc")).distinct()
    return qas.join(known, F.col(key) == F.col("_doc"), "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def retrieved_chunks(found: DataFrame, chunks: DataFrame, ids: str = "retrieved_ids", doc: str = "doc_id") -> DataFrame:
    """(index, rank, chunk_id, text) of each retrieved id: its document and ordinal are read from the id."""
    each = found.select("index", F.posexplode(ids).alias("_p", "chunk_id"))
    parsed = each.select("index", (F.col("_p") + 1).alias("rank"), "chunk_id", fn.chunk_id_doc(F.col("chunk_id")).alias("_doc"), fn.chunk_id_ordinal(F.col("chunk_id")).alias("ordinal"))
    own = chunks.select(F.col(doc).cast("string").alias("_doc"), "ordinal", "text")
    return parsed.join(own, ["_doc", "ordinal"]).select("index", "rank", "chunk_id", "text")


def unique_leaves(lists: DataFrame, leaves: str, key: str) -> DataFrame:
    """(key, n, unique): whether a context's leaves are all different."""
    return lists.select(key, F.size(leaves).alias("n"), (F.size(F.array_distinct(leaves)) == F.size(leaves)).alias("unique"))


def _run(words: Column, at: Column, size: int) -> Column:
    """The hash of ``size`` neighbouring words."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)])


def _inner_key(words: Column) -> Column:
    """A hash of up to three neighbouring words that stand whole in every text that holds these words: not the first nor the last.

    Of the runs of three the one with the most characters is taken, the earliest
    of equals; with four words both inner ones count, with three the one; null
    with fewer.
    """
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.struct((F.char_length(F.get(words, i)) + F.char_length(F.get(words, i + 1)) + F.char_length(F.get(words, i + 2))).alias("n"), (-i).alias("i")))
    return F.when(n >= 5, _run(words, -F.array_max(runs)["i"], 3)).when(n == 4, _run(words, F.lit(1), 2)).when(n == 3, _run(words, F.lit(1), 1))


def _keys(words: Column, sizes: list[int]) -> Column:
    """The hashes of all runs of so many neighbouring words."""

    def runs(size: int) -> Column:
        return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: _run(words, i, size))).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.concat(*map(runs, sizes)))


def contained(items: DataFrame, docs: DataFrame, item: str = "item_id", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, doc): the items whose normalised text stands in a document's normalised text, once for each row of ``docs``.

    Words inside an item stand whole wherever the item does, so an item is keyed
    by its longest run of three inner words (of fewer where it is short) and
    joined on the hashes of the documents' runs; only those pairs are tested.
    Items of one or two words have no inner word and are tested against every
    document; they are counted first, and more than 1,024 of them are an error.
    """
    spark = items.sparkSession
    own = items.select(item, fn.normalize_answer(F.col(text)).alias("_e")).where(F.col("_e").isNotNull())
    own = own.select(item, "_e", bound(F.split("_e", " "), lambda w: F.struct(_inner_key(w).alias("k"), F.least(F.lit(3), F.size(w) - 2).alias("n"))).alias("_s"))
    own = materialize(own.select(item, "_e", F.col("_s.k").alias("_k"), F.col("_s.n").alias("_size")), "items")
    plain = docs.select(doc, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    sizes = sorted(r["_size"] for r in own.where("_k is not null").select("_size").distinct().collect())
    keys = own.where("_k is not null").select("_k").distinct()
    if 0 < keys.count() <= SENT_KEYS:
        keys = F.broadcast(keys)
    words = F.split(fn.normalize_answer(F.col("_text")), " ")
    runs = plain.select(doc, F.explode(bound(words, lambda w: _keys(w, sizes)) if sizes else F.array().cast("array<bigint>")).alias("_k")).join(keys, "_k").distinct()
    pairs = materialize(runs.join(own, "_k").select(item, doc, "_e").distinct(), "candidates")
    tested = plain.join(pairs.withColumnRenamed(doc, "_doc"), F.col(doc) == F.col("_doc"))
    out = tested.where(F.contains(fn.normalize_answer(F.col("_text")), F.col("_e"))).select(item, doc)

    short = own.where("_k is null").select(item, "_e").limit(1025).collect()
    if len(short) > 1024:
        raise ValueError("more than 1,024 items have fewer than three words")
    if short:
        table = F.broadcast(spark.createDataFrame([(r[item], r["_e"]) for r in short], own.select(item, "_e").schema))
        out = out.unionByName(plain.join(table, F.contains(fn.normalize_answer(F.col("_text")), F.col("_e"))).select(item, doc))
    return out
