"""Context assembly: budgets, merging of retrieved chunks into their parents, prompts."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import text as fn
from lodestack.operators.chunking import by_documents, running, tree_nodes


def budget_context(ranked: DataFrame, budget: int, key: str = "qid", length: Callable[[Column], Column] = lambda t: F.size(fn.split_space(t))) -> DataFrame:
    """(key, context, n_chunks) of rows (key, rank, chunk_id, text).

    Ranked chunks go in, each id once, while the words before are fewer than the
    budget; they are joined by blank lines and cut to the budget.
    """
    once = Window.partitionBy(key, "chunk_id").orderBy("rank")
    first = ranked.withColumn("_o", F.row_number().over(once)).where("_o = 1").drop("_o")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = first.withColumn("_n", length(F.col("text"))).withColumn("_b", before).where(F.col("_b") < budget)
    parts = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "text", "_n"))).alias("c"), F.sum("_n").alias("total"))
    whole = F.array_join(F.transform("c", lambda x: x["text"]), "\n\n")
    cut = F.array_join(F.slice(fn.split_space(whole), 1, budget), " ")
    return parts.select(key, F.when(F.col("total") > budget, cut).otherwise(whole).alias("context"), F.size("c").alias("n_chunks"))


def interval_totals(leaves: DataFrame, nodes: DataFrame, key: str = "doc_id", length: Callable[[Column], Column] = lambda t: F.size(fn.split_space(t))) -> DataFrame:
    """Nodes (key, lft, rgt) with the characters of their leaves and the tokens of their joined text.

    Both are differences of running totals over the document's leaves (key, ordinal, text). Leaves (side 0)
    and nodes (side 1) of whole documents stand together in one pass, so the totals are made once and
    nothing is joined. Nodes without a key have no leaves.
    """
    names = nodes.columns
    sides = (
        leaves.select(key, F.lit(0).alias("_side"), F.col("ordinal").cast("long").alias("_at"), F.char_length("text").cast("long").alias("_chars"), length(F.col("text")).cast("long").alias("_tokens"))
        .where(F.col(key).isNotNull())
        .unionByName(nodes.withColumns({"_side": F.lit(1), "_at": F.col("lft").cast("long"), "_end": F.col("rgt").cast("long")}), allowMissingColumns=True)
    )

    def run(part: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        doc, leaf = np.cumsum(first) - 1, (part["_side"] == 0).to_numpy()
        # Leaves of all documents in order, and how many stand before each document.
        before = np.append(0, np.cumsum(np.bincount(doc[leaf], minlength=doc[-1] + 1)))
        a, b = before[doc[~leaf]], before[doc[~leaf] + 1]
        out = part.loc[~leaf, names].reset_index(drop=True)
        lft, rgt = (np.minimum(a + part.loc[~leaf, at].to_numpy(np.int64), b) for at in ("_at", "_end"))
        for name in ("chars", "tokens"):
            total = running(part.loc[leaf, f"_{name}"])
            out[name] = total[rgt] - total[lft]
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return by_documents(sides, key, ["_side", "_at"], run, f"{schema}, chars long, tokens long")


def tree_totals(splits: DataFrame, key: str = "doc_id", length: Callable[[Column], Column] = lambda t: F.size(fn.split_space(t))) -> DataFrame:
    """``interval_totals`` of the hierarchy of splits (key, split_idx, level, text), in the pass that makes its nodes."""
    return tree_nodes(splits, key, totals={"chars": F.char_length("text"), "tokens": length(F.col("text"))})


def merge_test(children_chars: Column, siblings: Column, parent_chars: Column, parent_tokens: Column, held_tokens: Column, context_tokens: Column, budget: Column) -> Column:
    """Whether retrieved siblings give way to their parent."""
    threshold = parent_chars / 3 * (1 + context_tokens / budget)
    return (children_chars >= threshold) & (siblings >= 2) & (parent_tokens - held_tokens <= budget - context_tokens)


@dataclass
class Node:
    """An interval [lft, rgt) of a document's leaf ordinals, with its parent's place in the list of nodes."""

    doc: object
    lft: int
    rgt: int
    parent: int | None
    n_children: int


@dataclass
class Merged:
    kept: list[int] = field(default_factory=list)
    context: str = ""
    merge_count: int = 0


def auto_merge(ranked: list[tuple[object, int]], leaves: dict[tuple[object, int], str], nodes: list[Node], leaf_node: dict[tuple[object, int], int], budget: int, count: Callable[[str], int]) -> Merged:
    """Walks ranked leaves, climbing to parents where enough of a parent has been retrieved.

    ``leaf_node`` gives the node of a leaf: one of its own, of width 1.
    """
    state = Merged()
    kept = state.kept
    text = lambda i: "\n".join(leaves[nodes[i].doc, k] for k in range(nodes[i].lft, nodes[i].rgt))
    render = lambda: "\n\n".join(map(text, kept))
    width = lambda i: nodes[i].rgt - nodes[i].lft
    # Running sums over each document's leaves, and each node's tokens once, as every climb asks for them again.
    tokens_to, chars_to, place = [0], [0], {}
    for at in sorted(leaves):
        place[at] = len(place)
        tokens_to.append(tokens_to[-1] + count(leaves[at]))
        chars_to.append(chars_to[-1] + len(leaves[at]))
    whole_tokens: dict[int, int] = {}

    def summed(totals: list[int], doc: object, a: int, b: int) -> int:
        """The sum over the leaves [a, b) of a document, which stand side by side."""
        return totals[place[doc, b - 1] + 1] - totals[place[doc, a]] if b > a else 0

    def tokens_of(i: int) -> int:
        if i not in whole_tokens:
            whole_tokens[i] = count(text(i))
        return whole_tokens[i]

    def apart(i: int, j: int) -> bool:
        a, b = nodes[i], nodes[j]
        return a.doc != b.doc or a.lft >= b.rgt or a.rgt <= b.lft

    for leaf in ranked:
        now = leaf_node[leaf]
        if any(nodes[k].doc == nodes[now].doc and nodes[k].lft <= nodes[now].lft and nodes[now].rgt <= nodes[k].rgt for k in kept):
            continue
        if nodes[now].parent is not None and nodes[nodes[now].parent].n_children == 1:
            now = nodes[now].parent
        leaves_before = sum(map(width, kept))
        kept.append(now)
        while (parent := nodes[now].parent) is not None:
            siblings = [k for k in kept if nodes[k].parent == parent]
            p = nodes[parent]
            # Kept nodes never overlap.
            held = sum(summed(tokens_to, p.doc, max(p.lft, nodes[k].lft), min(p.rgt, nodes[k].rgt)) for k in kept if nodes[k].doc == p.doc)
            chars = sum(summed(chars_to, p.doc, nodes[k].lft, nodes[k].rgt) for k in siblings)
            all_chars = summed(chars_to, p.doc, p.lft, p.rgt)
            tokens = count(state.context)
            if not (chars >= all_chars / 3 * (1 + tokens / budget) and len(siblings) >= 2 and tokens_of(parent) - held <= budget - tokens):
                break
            kept[kept.index(siblings[0])] = parent
            kept[:] = [k for k in kept if k == parent or apart(k, parent)]
            now = parent
            state.context = render()
            if count(state.context) >= budget:
                break
        state.merge_count += sum(map(width, kept)) - leaves_before - 1
        state.context = render()
        if count(state.context) >= budget:
            break
    words = state.context.split()
    if len(words) > budget:
        state.context = " ".join(words[:budget])
    return state


def auto_merge_contexts(ranked: DataFrame, chunks: DataFrame, nodes: DataFrame, budget: int, key: str = "qid") -> DataFrame:
    """(key, context, merge_count) from (key, rank, doc_id, ordinal), leaf chunks and nodes over leaf ordinals.

    One group holds a query's ranked ids and the nodes and leaves of its
    documents: what a query's search returned bounds it.
    """
    used = ranked.select(key, "doc_id").distinct()
    leaf = chunks.join(used, "doc_id").groupBy(key).agg(F.collect_list(F.struct("doc_id", "ordinal", "text")).alias("leaves"))
    node = nodes.join(used, "doc_id").groupBy(key).agg(F.collect_list(F.struct("doc_id", "depth", "lft_leaf", "rgt_leaf", "n_children")).alias("nodes"))
    order = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "ordinal"))).alias("ranks"))
    kind = ranked.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for qid, ranks, leaves, found in zip(batch["key"], batch["ranks"], batch["leaves"], batch["nodes"]):
                tree = sorted(((n["doc_id"], n["depth"], n["lft_leaf"], n["rgt_leaf"], n["n_children"]) for n in found), key=lambda n: (n[0], n[1], n[2]))
                out: list[Node] = []
                path: dict[tuple, tuple[list[int], list[int]]] = {}
                for doc, depth, a, b, children in tree:
                    # Nodes of a depth do not overlap and come in order: only the last that starts at or before ``a`` can hold this one.
                    starts, places = path.get((doc, depth - 1), ([], []))
                    up = places[at - 1] if (at := bisect_right(starts, a)) else None
                    out.append(Node(doc, a, b, up if up is not None and b <= out[up].rgt else None, children))
                    for own, x in zip(path.setdefault((doc, depth), ([], [])), (a, len(out) - 1)):
                        own.append(x)
                texts = {(x["doc_id"], x["ordinal"]): x["text"] for x in leaves}
                base: dict[tuple, int] = {}
                for i, n in enumerate(out):
                    if n.n_children == 0:
                        n.n_children = n.rgt - n.lft
                        for x in range(n.lft, n.rgt):
                            base[n.doc, x] = i
                own = {}
                for at, i in base.items():
                    out.append(Node(at[0], at[1], at[1] + 1, i, 0))
                    own[at] = len(out) - 1
                done = auto_merge([(r["doc_id"], r["ordinal"]) for r in ranks], texts, out, own, budget, lambda t: len(t.split()))
                rows.append((qid, done.context, done.merge_count))
            yield pd.DataFrame(rows, columns=["key", "context", "merge_count"])

    joined = order.join(leaf, key).join(node, key).withColumnRenamed(key, "key")
    return joined.mapInPandas(run, f"key {kind}, context string, merge_count int").withColumnRenamed("key", key)


#: Ways to make a context, by number: plain, and merging.
STRATEGIES = ("plain", "auto_merge")


def context_mode(budget: int, strategy: int = 0, tree: bool = True) -> str:
    """none (budget 0), whole (-1), or a strategy; merging needs a tree."""
    if budget == 0:
        return "none"
    if budget == -1:
        return "whole"
    return STRATEGIES[strategy if tree else 0]


def chat_prompt(prompt: Column, family: str) -> Column:
    """The prompt in a model family's chat form."""
    if family == "qwen":
        return F.concat(F.lit("<|im_start|>user\n"), prompt, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    if family == "llama":
        return F.concat(F.lit("[INST]"), prompt, F.lit("[/INST]"))
    return prompt
