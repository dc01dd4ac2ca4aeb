"""Text metrics of one prediction and one reference."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.text import normalize_answer, normalize_zh_answer


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays: both are sorted together and walked once."""
    side = lambda tokens, i: F.transform(tokens, lambda w: F.struct(w.alias("w"), F.lit(i).alias("i")))
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("left"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        left = F.when(s["w"].eqNullSafe(x["w"]), s["left"]).otherwise(0)
        hit = (x["i"] == 1) & (left > 0)
        return F.struct(x["w"].alias("w"), (left + F.when(x["i"] == 0, 1).when(hit, -1).otherwise(0)).alias("left"), (s["n"] + hit.cast("int")).alias("n"))

    return F.aggregate(F.sort_array(F.concat(side(a, 0), side(b, 1))), start, step, lambda s: s["n"])


def token_f1(pred: Column, truth: Column) -> Column:
    def score(t: Column) -> Column:
        precision, recall = t["o"] / F.size(t["a"]), t["o"] / F.size(t["b"])
        return F.when(t["o"] > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))

    both = F.struct(pred.alias("a"), truth.alias("b"))
    return bound(both, lambda t: bound(F.struct(t["a"].alias("a"), t["b"].alias("b"), overlap(t["a"], t["b"]).alias("o")), score))


def _tokens(s: Column) -> Column:
    return F.filter(F.split(normalize_answer(s), " "), lambda w: w != "")


def qa_f1(pred: Column, truth: Column) -> Column:
    """F1 of normalised words."""
    return token_f1(_tokens(pred), _tokens(truth))


def characters(s: Column) -> Column:
    """The stand-in segmenter for Chinese text: single characters."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def qa_f1_zh(pred: Column, truth: Column, segment=characters) -> Column:
    """F1 of segments, each normalised, without blank ones."""
    clean = lambda s: F.filter(F.transform(segment(s), normalize_zh_answer), lambda w: w != "")
    return token_f1(clean(pred), clean(truth))


def evidence_hit(truth: Column, text: Column) -> Column:
    """1.0 where the normalised evidence stands in the normalised text; empty evidence does."""
    return F.contains(normalize_answer(text), normalize_answer(truth)).cast("double")


_STOP = re.compile(r"[.!?]+\s*|\n+")


def _union_lcs(reference: list[str], candidate: list[list[str]]) -> set[int]:
    """Positions of a reference sentence that stand in its longest common subsequence with any candidate sentence."""
    held: set[int] = set()
    for other in candidate:
        n, m = len(reference), len(other)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if reference[i] == other[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < n and j < m:
            if reference[i] == other[j]:
                held.add(i)
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return held


def rouge_l_f(pred: str | None, truth: str | None) -> float:
    """Summary-level ROUGE-L F (Lin 2004, union of common subsequences), evenly weighted; 0 where either has no words."""
    cut = lambda s: [w for x in _STOP.split(s or "") if (w := x.split())]
    p, t = cut(pred), cut(truth)
    n_pred, n_truth = sum(map(len, p)), sum(map(len, t))
    if not n_pred or not n_truth:
        return 0.0
    hits = 0
    left = Counter(w for s in p for w in s)
    for s in t:
        for i in sorted(_union_lcs(s, p)):
            if left[s[i]]:
                left[s[i]] -= 1
                hits += 1
    precision, recall = hits / n_pred, hits / n_truth
    return 2 * precision * recall / (precision + recall) if hits else 0.0


def rouge_l(pred: Column | str, truth: Column | str) -> Column:
    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([rouge_l_f(x, y) for x, y in zip(a, b)])

    return run(pred, truth)


def rouge_l_zh(pred: Column, truth: Column, segment=characters) -> Column:
    return rouge_l(F.array_join(segment(pred), " "), F.array_join(segment(truth), " "))


def bleu(pred: Column, truth: Column, order: int = 4) -> Column:
    """Sentence BLEU of two token arrays: clipped n-gram precision, evenly weighted, brevity penalty, no smoothing."""

    def grams(tokens: Column, n: int) -> Column:
        whole = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), "\u0001"))
        return F.when(F.size(tokens) >= n, whole).otherwise(F.array().cast("array<string>"))

    def score(t: Column) -> Column:
        logs = F.lit(0.0)
        for n in range(1, order + 1):
            part = bound(F.struct(grams(t["a"], n).alias("a"), grams(t["b"], n).alias("b")), lambda g: overlap(g["a"], g["b"]) / F.nullif(F.size(g["a"]), F.lit(0)))
            logs = logs + bound(part, lambda p: F.when(p > 0, F.log(p))) / order
        short = F.when(F.size(t["a"]) >= F.size(t["b"]), F.lit(0.0)).otherwise(1 - F.size(t["b"]) / F.nullif(F.size(t["a"]), F.lit(0)))
        return F.coalesce(F.exp(logs + short), F.lit(0.0))

    return bound(F.struct(pred.alias("a"), truth.alias("b")), score)


#: The metric of each data set, and the metric's function.
METRIC_OF = {
    "hotpotqa": "qa_f1", "2wikimqa": "qa_f1", "musique": "qa_f1", "narrativeqa": "qa_f1", "qasper": "qa_f1", "multifieldqa_en": "qa_f1", "qasper_all": "qa_f1",
    "HiCBench": "rouge_l", "OHRBench_sub": "rouge_l", "GutenQA": "rouge_l", "dureader": "rouge_l_zh", "multifieldqa_zh": "qa_f1_zh",
}


def metric_of(dataset: Column) -> Column:
    """The name of a data set's metric; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in METRIC_OF.items() for x in pair]), dataset)


def by_metric(name: Column, pred: Column, truth: Column) -> Column:
    """The score by the metric's name; null for an unknown one. Only rows with a ROUGE metric go through Python, and once."""
    words = lambda s: F.when(name == "rouge_l", s).when(name == "rouge_l_zh", F.array_join(characters(s), " "))
    rouge = rouge_l(words(pred), words(truth))
    return F.when(name == "qa_f1", qa_f1(pred, truth)).when(name == "qa_f1_zh", qa_f1_zh(pred, truth)).when(name.isin("rouge_l", "rouge_l_zh"), rouge)


def bleu_reference(pred: list[str], truth: list[str], order: int = 4) -> float:
    """Plain Python BLEU, for tests."""
    total = 0.0
    for n in range(1, order + 1):
        a, b = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (pred, truth))
        hit = sum((a & b).values())
        if not hit:
            return 0.0
        total += math.log(hit / sum(a.values())) / order
    return math.exp(total + (0 if len(pred) >= len(truth) else 1 - len(truth) / len(pred)))
