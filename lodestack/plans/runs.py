"""A whole run: documents to chunks, vectors, retrieved ids and merged results, for data sets and a chunking method."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as fn
from lodestack.operators import chunking, retrieval
from lodestack.runtime import materialize
from lodestack.sources.readers import of_datasets

#: The chunking methods, whether each needs splits of its own, and whether it keeps a tree.
METHODS = {"C": (False, False), "HC": (True, True), "SC": (True, False), "LC": (True, False)}


@dataclass(frozen=True)
class Run:
    """What a run does. ``name`` tells its tables from those of other runs."""

    method: str = "C"
    chunk_size: int = 200
    max_level: int = 10
    merge_over_chunks: bool = False
    top_k: int = 128
    datasets: tuple[str, ...] | None = None
    lower: bool = True

    @property
    def name(self) -> str:
        return f"{self.method}{self.chunk_size}" + (f"_L{self.max_level}" if METHODS[self.method][1] else "")


def index(run: Run, docs: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """(dataset, doc_id, ordinal, chunk_id, text) of documents (dataset, doc_id, text) or of their splits."""
    if run.method not in METHODS:
        raise ValueError(f"no method {run.method}: {', '.join(METHODS)}")
    docs = of_datasets(docs, run.datasets)
    with_splits, tree = METHODS[run.method]
    if with_splits:
        own = splits.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        made = chunking.leaf_chunks(_fitted(run, own, tree).where(~fn.is_blank(F.col("text"))), run.chunk_size)
    else:
        made = chunking.fixed_chunks(docs, run.chunk_size, dataset="dataset")
    return made.join(docs.select("doc_id", "dataset").dropDuplicates(["doc_id"]), "doc_id").select("dataset", "doc_id", "ordinal", "chunk_id", "text")


def _fitted(run: Run, splits: DataFrame, tree: bool) -> DataFrame:
    """Splits of the run's levels at most, and joined where they are short."""
    own = chunking.clamp_levels(splits, run.max_level) if tree else splits
    return chunking.merge_splits(own, run.chunk_size) if run.merge_over_chunks else own


def retrieve(run: Run, chunks: DataFrame, qas: DataFrame, embed: Callable[[DataFrame], DataFrame] = retrieval.embed) -> DataFrame:
    """(index, retrieved_ids): for each question the ids of its document's best chunks, in rank order."""
    passage = retrieval.passage_text(F.lit(None).cast("string"), F.col("text"), lower=run.lower)
    vectors = embed(chunks.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("chunk_id").alias("chunk"), passage.alias("text")))
    question = F.lower("input") if run.lower else F.col("input")
    asked = embed(qas.select(F.col("_id").cast("string").alias("doc_id"), F.col("index").alias("qid"), question.alias("text")))
    found = retrieval.search_local(asked, vectors, run.top_k)
    lists = found.groupBy(F.col("qid").alias("index")).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk"))).alias("_r"))
    return lists.select("index", F.transform("_r", lambda r: r["chunk"]).alias("retrieved_ids"))


def run_all(run: Run, docs: DataFrame, qas: DataFrame, splits: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] = retrieval.embed) -> DataFrame:
    """The questions of the run's data sets with ``retrieved_ids``; the chunks are written between the stages."""
    chunks = materialize(index(run, docs, splits), f"{run.name}-chunks")
    asked = of_datasets(qas, run.datasets)
    found = retrieve(run, chunks, asked, embed)
    return asked.join(found, "index", "left").withColumn("retrieved_ids", F.coalesce("retrieved_ids", F.array().cast("array<string>")))
