"""Contexts by mode, token counters by name, and prompts from stored settings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as fn
from lodestack.operators import context


def library_counter(load: Callable[[], Callable[[list[str]], list[int]]]) -> Callable[[Column], Column]:
    """A counter by a tokenizer that ``load`` makes once per Python worker's stream; texts go to it in batches."""

    @F.pandas_udf("int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = load()
        for part in parts:
            yield pd.Series(count(part.fillna("").tolist()), dtype="int32")

    return run


#: Token counters by name: each makes a column of a text's length.
COUNTERS: dict[str, Callable[[Column], Column]] = {
    "words": fn.word_len,
    "spaced": lambda t: F.size(fn.split_space(t)),
    "estimated": fn.count_words,
    "characters": F.char_length,
}


def register_counter(name: str, counter: Callable[[Column], Column]) -> None:
    COUNTERS[name] = counter


def counter(name: str) -> Callable[[Column], Column]:
    if name not in COUNTERS:
        raise ValueError(f"no token counter {name}: {', '.join(sorted(COUNTERS))}")
    return COUNTERS[name]


def contexts(qas: DataFrame, budget: int, docs: DataFrame | None = None, ranked: DataFrame | None = None, chunks: DataFrame | None = None, nodes: DataFrame | None = None, strategy: int = 0, key: str = "index") -> DataFrame:
    """Questions (key, _id, ...) with ``context`` and ``merge_count``, by the mode of ``context.context_mode``.

    ``none`` gives an empty text, ``whole`` the question's document, ``plain``
    ranked chunks within the budget, ``auto_merge`` ranked leaves merged into
    parents. Questions without any result have an empty context.
    """
    mode = context.context_mode(budget, strategy, nodes is not None)
    none = F.lit(0).alias("merge_count")
    if mode == "none":
        return qas.select("*", F.lit("").alias("context"), none)
    if mode == "whole":
        own = docs.select(F.col("doc_id").cast("string").alias("_doc"), F.col("text").alias("context"))
        return qas.join(own, F.col("_id").cast("string") == F.col("_doc"), "left").drop("_doc").select("*", none)
    if mode == "plain":
        made = context.budget_context(ranked, budget, key).select(key, "context", none)
    else:
        made = context.auto_merge_contexts(ranked, chunks, nodes, budget, key)
    out = qas.join(made, key, "left")
    return out.withColumns({"context": F.coalesce("context", F.lit("")), "merge_count": F.coalesce("merge_count", F.lit(0))})


def fill(template: Column, **values: Column) -> Column:
    """A template column with {name} places; values are put in at once and never read again."""
    names = "|".join(values)
    parts = F.split(template, rf"(?<=\{{(?:{names})\}})|(?=\{{(?:{names})\}})")
    known = F.create_map(*[x for name, value in values.items() for x in (F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))])
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")


def prompts(rows: DataFrame, family: str = "", template: str = "prompt", most: str = "max_length") -> DataFrame:
    """Rows with ``prompt`` and ``context_length``: the template of the row's data set, filled with its context and input.

    A prompt of more words than the model's length keeps its first and last half.
    """
    filled = context.chat_prompt(fill(F.col(template), context=F.col("context"), input=F.col("input")), family)
    named = rows.withColumn("_filled", filled).withColumn("_words", fn.split_space(F.col("_filled")))
    half = F.floor(F.col(most) / 2).cast("int")
    cut = F.concat(F.array_join(F.slice("_words", F.lit(1), half), " "), F.array_join(F.slice("_words", F.size("_words") - half + 1, half), " "))
    prompt = F.when(F.size("_words") > F.col(most), cut).otherwise(F.col("_filled"))
    return named.withColumn("prompt", prompt).withColumn("context_length", F.size(fn.split_space(F.col("prompt")))).drop("_filled", "_words")
