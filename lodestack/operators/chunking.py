"""Chunking: packing sentences, hierarchies as interval tables, and the pieces of model-driven chunkers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestack.functions import text as fn

MAX_LEVEL = 10


def pack_starts(lengths: Column, size: int) -> Column:
    """Where chunks start (0-based) when items of these lengths are packed greedily; a longer item stands alone."""
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("used"), F.lit(0).alias("i"))

    def step(s: Column, n: Column) -> Column:
        fits = (s["i"] > 0) & (s["used"] + n <= size)
        return F.struct(F.when(fits, s["starts"]).otherwise(F.concat(s["starts"], F.array(s["i"]))).alias("starts"), F.when(fits, s["used"] + n).otherwise(n).alias("used"), (s["i"] + 1).alias("i"))

    return F.aggregate(lengths, start, step, lambda s: s["starts"])


def pack_sentences(sentences: Column, size: int, length: Callable[[Column], Column] = fn.word_len) -> Column:
    """Chunks of at most ``size`` words from whole sentences, joined without a separator.

    The fold carries positions alone, so its state stays small for long documents.
    Sentences and starts are values of a lambda each, so that they are made once.
    """

    def once(value: Column, f: Callable[[Column], Column]) -> Column:
        return F.element_at(F.transform(F.array(value), f), 1)

    def cut(items: Column) -> Column:
        part = lambda starts: F.transform(starts, lambda a, k: F.array_join(F.slice(items, a + 1, F.coalesce(F.get(starts, k + 1), F.size(items)) - a), ""))
        return once(pack_starts(F.transform(items, length), size), part)

    return once(sentences, cut)


#: The data sets whose sentences are cut by the Chinese rule.
CHINESE = ("multifieldqa_zh", "dureader")


def fixed_chunks(docs: DataFrame, size: int = 200, key: str = "doc_id", text: str = "text", dataset: str | None = None) -> DataFrame:
    """Fixed-size chunks of each document: key, ordinal, chunk_id, text. Of rows that repeat a key the one with the least text is chunked.

    With the column ``dataset`` those of Chinese data sets are cut into sentences by the Chinese rule.
    """
    t = F.col(text)
    if dataset is None:
        one, sentences = docs.groupBy(key).agg(F.min(text).alias(text)), fn.sentences_en(t)
    else:
        one = docs.groupBy(key).agg(F.min(F.struct(text, dataset)).alias("_r")).select(key, "_r.*")
        sentences = F.when(F.col(dataset).isin(*CHINESE), fn.sentences_zh(t)).otherwise(fn.sentences_en(t))
    chunks = one.select(F.col(key), F.posexplode(pack_sentences(sentences, size)).alias("ordinal", "text"))
    return chunks.select(key, "ordinal", fn.chunk_id(F.col(key), F.col("ordinal")).alias("chunk_id"), fn.strip(F.col("text")).alias("text"))


def clamp_levels(splits: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """Splits deeper than ``most`` join the split before them; the first split always stands."""
    order = Window.partitionBy(key).orderBy("split_idx")
    stands = F.when((F.col("level") <= most) | (F.row_number().over(order) == 1), 1).otherwise(0)
    grouped = splits.withColumn("_g", F.sum(stands).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy(key, "_g").agg(F.array_sort(F.collect_list(F.struct("split_idx", "text", "level"))).alias("s"))
    return merged.select(key, (F.col("_g") - 1).cast("int").alias("split_idx"), F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"), F.col("s")[0]["level"].alias("level"))


def merge_over_chunks(levels: list[int], lengths: list[int], size: int) -> list[tuple[int, int, int]]:
    """(first, end, level) of splits after joining, from the deepest level up, each split with the run behind it.

    The run's levels never fall below the greatest so far, from one below the
    split's own; it is joined as a whole if the sum of lengths is within ``size``.
    """
    items = [(i, i + 1, level, n) for i, (level, n) in enumerate(zip(levels, lengths))]
    for level in range(max(levels, default=0), 0, -1):
        out, i = [], 0
        while i < len(items):
            first, end, own, total = items[i]
            j, floor = i + 1, level + 1
            if own == level:
                while j < len(items) and items[j][2] >= floor:
                    floor = items[j][2]
                    j += 1
                whole = sum(x[3] for x in items[i:j])
                if j > i + 1 and whole <= size:
                    out.append((first, items[j - 1][1], level, whole))
                    i = j
                    continue
            out.append((first, end, own, total))
            i += 1
        items = out
    return [x[:3] for x in items]


def merge_splits(splits: DataFrame, size: int, key: str = "doc_id", length: Callable[[Column], Column] = fn.word_len) -> DataFrame:
    """``merge_over_chunks`` over a table of splits (key, split_idx, level, text). Only levels and lengths enter Python."""
    kind = splits.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, n, a, b, level) for doc, s in zip(batch["key"], batch["s"]) for n, (a, b, level) in enumerate(merge_over_chunks([x["level"] for x in s], [x["n"] for x in s], size))]
            yield pd.DataFrame(rows, columns=["key", "merged_idx", "first", "end", "level"])

    per_doc = splits.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct("split_idx", "level", length(F.col("text")).alias("n")))).alias("s"))
    spans = per_doc.mapInPandas(run, f"key {kind}, merged_idx int, first int, end int, level int")
    numbered = splits.select(F.col(key).alias("key"), "text", (F.row_number().over(Window.partitionBy(key).orderBy("split_idx")) - 1).alias("_i"))
    joined = numbered.join(spans, "key").where((F.col("_i") >= F.col("first")) & (F.col("_i") < F.col("end")))
    texts = joined.groupBy("key", "merged_idx", "level").agg(F.array_sort(F.collect_list(F.struct("_i", "text"))).alias("t"))
    return texts.select(F.col("key").alias(key), F.col("merged_idx").alias("split_idx"), "level", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"))


def by_documents(rows: DataFrame, key: str, order: list[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over whole documents: rows in order of key and ``order``, many documents at a time, and which rows start one.

    A task holds a batch and the document that is open at its end.
    """

    types = to_arrow_schema(StructType.fromDDL(schema))
    whole = lambda t: pd.ArrowDtype(t) if t == pa.int64() else None  # noqa: E731  # long keys stay whole beside nulls

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            if not rows.num_rows:
                continue
            batch = rows.to_pandas(types_mapper=whole)
            last = batch[key].iloc[-1]
            open_rows = batch[key].isna() if pd.isna(last) else batch[key] == last
            done = int(len(batch) - open_rows.sum())
            if not done and held and _same(held[-1][key].iloc[-1], last):
                held.append(batch)
                continue
            yield from ready(pd.concat([*held, batch.iloc[:done]]))
            held = [batch.iloc[done:]]
        if held:
            yield from ready(pd.concat(held))

    def ready(part: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        if len(part):
            keys, before = part[key], part[key].shift()
            gone = keys.isna().to_numpy()
            starts = np.where(gone | before.isna().to_numpy(), gone != before.isna().to_numpy(), (keys != before).fillna(False).to_numpy(bool))
            starts[0] = True
            out = run(part.reset_index(drop=True), starts)
            for at in range(0, len(out), 50_000):
                yield from pa.Table.from_pandas(out.iloc[at : at + 50_000], schema=types, preserve_index=False).combine_chunks().to_batches()

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(stream, schema)


def _same(a: object, b: object) -> bool:
    return (pd.isna(a) and pd.isna(b)) or a == b


def running(numbers: pd.Series) -> np.ndarray:
    """The sum before each row and, last, that of all; nulls count nothing."""
    return np.append(0, np.cumsum(numbers.fillna(0).to_numpy(np.int64)))


def tree_nodes(splits: DataFrame, key: str = "doc_id", max_level: int = MAX_LEVEL, totals: dict[str, Column] | None = None) -> DataFrame:
    """The hierarchy as intervals over split positions: key, depth, lft, rgt, parent_lft, n_children.

    At depth L an interval ends before each later split of level L or less; it
    is a node if the interval around it at depth L - 1 is wider than one split.
    Rows without a key are one document, of which the root alone is given.
    ``totals`` names numbers of a split, which are added up for each node (long).

    Only keys, levels and these numbers are shuffled, once; each depth takes one pass over a batch.
    """
    kind = splits.schema[key].dataType.simpleString()
    totals = totals or {}
    names = list(totals)

    def run(part: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        levels, n = part["level"].fillna(max_level + 1).to_numpy(), len(part)
        base = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        keyed = part[key].notna().to_numpy()
        sums = {name: running(part[name]) for name in names}
        depths: list[list[np.ndarray]] = []
        for depth in range(max_level + 1):
            starts = np.flatnonzero(first | (levels <= depth))
            ends, children = np.append(starts[1:], n), np.zeros(len(starts), np.int64)
            if depth:
                above_starts, above_ends, above_children = depths[-1][0], depths[-1][1], depths[-1][2]
                up = np.searchsorted(above_starts, starts, "right") - 1
                node = (above_ends[up] - above_starts[up] > 1) & keyed[starts]
                above_children += np.bincount(up[node], minlength=len(above_starts))
                parent = above_starts[up]
            else:
                node, parent = np.ones(len(starts), bool), np.full(len(starts), -1)
            depths.append([starts, ends, children, node, parent])
        out = []
        for depth, (starts, ends, children, node, parent) in enumerate(depths):
            at = starts[node]
            up = pd.array(parent[node] - base[at], "Int32") if depth else pd.array([None] * len(at), "Int32")
            out.append(pd.DataFrame({key: part[key].take(at).reset_index(drop=True), "depth": np.int32(depth), "lft": (at - base[at]).astype(np.int32), "rgt": (ends[node] - base[at]).astype(np.int32), "parent_lft": up, "n_children": children[node].astype(np.int32)} | {name: s[ends[node]] - s[at] for name, s in sums.items()}))
        return pd.concat(out, ignore_index=True)

    rows = splits.select(key, "split_idx", "level", *[c.cast("long").alias(name) for name, c in totals.items()])
    return by_documents(rows, key, ["split_idx"], run, f"{key} {kind}, depth int, lft int, rgt int, parent_lft int, n_children int" + "".join(f", {name} long" for name in names))


def leaf_chunks(splits: DataFrame, size: int = 200, key: str = "doc_id") -> DataFrame:
    """Each split's packed leaf chunks with document-wide ordinals: key, split, ordinal, chunk_id, text."""
    order = Window.partitionBy(key).orderBy("split_idx")
    numbered = splits.select(key, "text", (F.row_number().over(order) - 1).cast("int").alias("split"))
    chunks = numbered.select(key, "split", F.posexplode(pack_sentences(fn.sentences_en(F.col("text")), size)).alias("_p", "text"))
    ordinal = (F.row_number().over(Window.partitionBy(key).orderBy("split", "_p")) - 1).cast("int")
    return chunks.withColumn("ordinal", ordinal).select(key, "split", "ordinal", fn.chunk_id(F.col(key), F.col("ordinal")).alias("chunk_id"), "text")


def leaf_nodes(nodes: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nodes over leaf ordinals: lft_leaf and rgt_leaf from the chunks of the splits that a node holds."""
    per_split = chunks.groupBy(key, "split").agg(F.min("ordinal").alias("a"), (F.max("ordinal") + 1).alias("b"))
    # Splits (side 0) and nodes (side 1) of whole documents stand together; a node's splits are found by bisection, not by a join.
    names = ["depth", "lft", "rgt", "parent_lft", "n_children", "lft_leaf", "rgt_leaf"]
    none = lambda *found: [F.lit(None).cast("int").alias(c) for c in found]
    sides = per_split.select(key, F.lit(0).alias("side"), F.col("split").alias("at"), "a", "b", *none(*names[:5])).unionByName(
        nodes.where(F.col(key).isNotNull()).select(key, F.lit(1).alias("side"), F.col("lft").alias("at"), *none("a", "b"), *[F.col(c).cast("int").alias(c) for c in names[:5]])
    )

    def run(part: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        doc, side = np.cumsum(first), part["side"].to_numpy()
        splits, own = part[side == 0], part[side == 1]
        stride = int(max(part["at"].max(), own["rgt"].max() if len(own) else 0)) + 2
        places = doc[side == 0] * stride + splits["at"].to_numpy()
        lo = np.searchsorted(places, doc[side == 1] * stride + own["lft"].to_numpy(np.int64))
        hi = np.searchsorted(places, doc[side == 1] * stride + own["rgt"].to_numpy(np.int64))
        some = hi > lo
        a, b = splits["a"].to_numpy(np.int64), splits["b"].to_numpy(np.int64)
        out = own[some][[key, *names[:5]]].reset_index(drop=True)
        return out.assign(parent_lft=out["parent_lft"].astype("Int32"), lft_leaf=a[lo[some]], rgt_leaf=b[hi[some] - 1])

    kind = nodes.schema[key].dataType.simpleString()
    return by_documents(sides, key, ["side", "at"], run, ", ".join([f"{key} {kind}", *[f"{c} int" for c in names]]))


def chunk_documents(method: str, docs: DataFrame | None = None, splits: DataFrame | None = None, size: int = 200, max_level: int | None = None, merge: bool = False) -> DataFrame:
    """Chunks by method: ``fixed`` from documents, ``hierarchical``, ``semantic`` or ``paragraph`` from splits.

    Clamping and joining of splits are for the hierarchical method alone.
    """
    if method == "fixed":
        return fixed_chunks(docs, size)
    if method not in ("hierarchical", "semantic", "paragraph"):
        raise ValueError(f"unknown method {method}")
    splits = splits.where(~fn.is_blank(F.col("text")))
    if method == "hierarchical":
        if max_level is not None:
            splits = clamp_levels(splits, max_level)
        if merge:
            splits = merge_splits(splits, size)
    return leaf_chunks(splits, size)


def points_to_splits(points: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Splits from cut points (key, level, p) and lines (key, pos, text): a point on several levels takes the deepest; 0 is none."""
    cuts = points.where("p > 0").groupBy(key, F.col("p").alias("pos")).agg(F.max("level").cast("int").alias("_level"))
    marked = lines.join(cuts, [key, "pos"], "left")
    group = F.sum(F.when(F.col("_level").isNotNull(), 1).otherwise(0)).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    parts = marked.withColumn("split_idx", group.cast("int")).groupBy(key, "split_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "_level"))).alias("s"))
    return parts.select(key, "split_idx", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"), F.coalesce(F.col("s")[0]["_level"], F.lit(1)).alias("level"))


def clip_points(points: Column, most: Column) -> Column:
    return F.filter(points, lambda p: p < most)


def rebase_points(points: Column, residual: Column, start: Column) -> Column:
    """Points behind the residual lines, moved to the window's start."""
    return F.transform(F.filter(points, lambda p: p >= residual), lambda p: p - residual + start)


def points_to_clips(points: Column, start: Column, end: Column) -> Column:
    """Half-open intervals between start, the points inside, and end."""
    inside = F.filter(F.array_sort(points), lambda p: (p > start) & (p < end))
    edges = F.concat(F.array(start), inside, F.array(end))
    return F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.struct(F.element_at(edges, i).alias("lft"), F.element_at(edges, i + 1).alias("rgt")))


def parse_answers(answers: DataFrame, key: str, answer: str, max_level: int = MAX_LEVEL) -> DataFrame:
    """(key, level, pos, p) of a reply's lines "p, Level N, flag"; a point stays if it is greater than the one before it on its level."""
    names = "One Two Three Four Five Six Seven Eight Nine Ten".split()[:max_level]
    level = F.coalesce(*[F.when(F.col("_n") == f"Level {name}", i + 1) for i, name in enumerate(names)])
    lines = answers.select(key, F.posexplode(F.split(answer, "\n")).alias("pos", "_line"))
    pattern = r"^([0-9]+), (.*), (.*)$"
    parts = lines.select(key, "pos", F.regexp_extract("_line", pattern, 1).alias("_p"), F.regexp_extract("_line", pattern, 2).alias("_n")).where("_p <> ''")
    known = parts.select(key, "pos", level.alias("level"), F.col("_p").cast("int").alias("p")).where("level is not null")
    before = F.lag("p").over(Window.partitionBy(key, "level").orderBy("pos"))
    return known.withColumn("_b", before).where("_b is null or p > _b").drop("_b")


def points_valid(points: Column, start: Column, end: Column) -> Column:
    """The first point is not before start; later ones rise and are not beyond end."""
    first = F.get(points, F.lit(0))
    rise = F.forall(F.transform(points, lambda p, i: (i == 0) | ((p > F.get(points, i - 1)) & (p <= end))), lambda ok: F.coalesce(ok, F.lit(True)))
    return (F.size(points) == 0) | ((first >= start) & rise)


def window_fill(lines: DataFrame, budget: int, key: str = "doc_id", length: str = "n", reserved: int = 0) -> DataFrame:
    """The leading lines whose lengths sum to the budget at most, and at least one."""
    order = Window.partitionBy(key).orderBy("pos")
    total = F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("_t", total).withColumn("_r", F.row_number().over(order)).where((F.col("_t") + reserved <= budget) | (F.col("_r") == 1)).drop("_t", "_r")


def residual_lines(lines: list[str], points: list[list[int]], start: int, window: int, mode: int) -> list[str]:
    """Lines carried into the next window: none in mode 1; in mode 2 the level-2 clips since the last level-1 point.

    At most five clips (two first, three last) of 20 lines stay; where that is
    half a window or more, three (one, two) of 15; where even that is, none.
    """
    if mode == 1:
        return []
    if mode != 2:
        raise ValueError("mode is 1 or 2")
    begin = max((p for p in points[0] if p <= start), default=0) if points else 0
    inner = sorted(p for p in (points[1] if len(points) > 1 else []) if begin < p < start)
    edges = [begin, *inner, start]
    clips = [lines[a:b] for a, b in zip(edges, edges[1:]) if b > a]
    for head, tail, most in ((2, 3, 20), (1, 2, 15)):
        kept = clips if len(clips) <= head + tail else clips[:head] + clips[-tail:]
        out = [line for clip in kept for line in clip[:most]]
        if sum(map(len, out)) < window / 2:
            return out
    return []


def heading_segments(lines: DataFrame, mark: str = "# ", key: str = "doc_id") -> DataFrame:
    """Adds ``segment``: a new one at each line but the first that starts with ``mark``."""
    order = Window.partitionBy(key).orderBy("pos")
    starts = F.when((F.row_number().over(order) > 1) & F.startswith(F.col("text"), F.lit(mark)), 1).otherwise(0)
    return lines.withColumn("_s", starts).withColumn("segment", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_s")


def paragraph_window(paragraphs: DataFrame, target: int = 550, key: str = "doc_id") -> DataFrame:
    """(key, end): the paragraphs of a first window. It grows to the target of counted words, and the last one goes unless alone."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    counted = paragraphs.withColumn("_w", F.size(fn.split_space(F.col("text")))).withColumn("_c", F.round(1.2 * F.sum("_w").over(order)))
    ends = counted.groupBy(key).agg(F.min(F.when(F.col("_c") >= target, F.col("pos") + 1)).alias("_e"), F.count(F.lit(1)).alias("_n"))
    size = F.coalesce("_e", "_n")
    return ends.select(key, F.when(size > 1, F.when(F.col("_e").isNull(), size).otherwise(size - 1)).otherwise(size).cast("int").alias("end"))


def cuts_to_chunks(paragraphs: Column, cuts: Column) -> Column:
    """Texts of the paragraphs between consecutive cuts, joined by line ends."""
    return F.transform(cuts, lambda c, i: F.array_join(F.slice(paragraphs, F.coalesce(F.get(cuts, i - 1), F.lit(0)) + 1, c - F.coalesce(F.get(cuts, i - 1), F.lit(0))), "\n"))


def semantic_breaks(vectors: DataFrame, percentile: float = 0.74, key: str = "doc_id") -> DataFrame:
    """Adds ``chunk``: a new one where the cosine distance to the vector before is above the document's percentile; a vector of zeros has none."""
    order = Window.partitionBy(key).orderBy("pos")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    v, before = F.col("vec"), F.col("_before")
    far = vectors.withColumn("_before", F.lag("vec").over(order)).withColumn("distance", F.round(1 - F.try_divide(dot(v, before), F.sqrt(dot(v, v) * dot(before, before))), 9))
    # The limit comes from a window over the same rows: a join would make the vectors twice.
    cut = F.when(F.col("distance") > F.col("_limit"), 1).otherwise(0)
    marked = far.where(F.col(key).isNotNull()).withColumn("_limit", F.percentile("distance", F.lit(percentile)).over(Window.partitionBy(key))).withColumn("_cut", cut)
    return marked.withColumn("chunk", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_before", "_limit", "_cut")


def buffered_groups(sentences: DataFrame, buffer: int = 1, key: str = "doc_id") -> DataFrame:
    """Adds ``group``: each sentence (key, pos, text) with ``buffer`` neighbours on either side, joined by spaces."""
    around = Window.partitionBy(key).orderBy("pos").rowsBetween(-buffer, buffer)
    return sentences.withColumn("group", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text")).over(around)), lambda x: x["text"]), " "))


def semantic_chunks(docs: DataFrame, embed: Callable[[DataFrame], DataFrame], buffer: int = 1, percentile: float = 0.74, key: str = "doc_id") -> DataFrame:
    """Splits (key, split_idx, text, level) of documents, cut where neighbouring groups of sentences are far apart; all are of level 1.

    ``embed`` adds ``vec``, the vector of the column ``group``.
    """
    sentences = docs.select(key, F.posexplode(fn.sentences_en(F.col("text"))).alias("pos", "text"))
    marked = semantic_breaks(embed(buffered_groups(sentences, buffer, key)), percentile, key)
    parts = marked.groupBy(key, F.col("chunk").alias("split_idx")).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_s"))
    return parts.select(key, "split_idx", F.array_join(F.transform("_s", lambda x: x["text"]), " ").alias("text"), F.lit(1).alias("level"))
