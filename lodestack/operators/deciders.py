"""Model-driven steps behind small protocols, each with a deterministic stand-in that needs no model.

A step gets a factory; it is called once per Python worker's stream, where a
real back-end would open its client. Calls that fail are tried again a bounded
number of times.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as fn
from lodestack.operators.chunking import residual_lines

LEVELS = tuple(f"Level {x}" for x in "One Two Three Four Five Six Seven Eight Nine Ten".split())
_LINE = re.compile(r"^([0-9]+), (.*), (.*)$")


def pieces(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """Batches in pieces of a few documents, so that a step's results for a whole batch never stand in memory at once."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


class Generator(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


def retried(call: Callable, times: int = 3, wait: float = 1.0) -> Callable:
    """The call, tried ``times`` times at most."""

    def run(*args):
        for left in range(times - 1, -1, -1):
            try:
                return call(*args)
            except Exception:
                if not left:
                    raise
                time.sleep(wait)

    return run


def extractive_generator() -> Generator:
    """Answers with the prompt's sentence that shares most words with its last line."""

    def answer(prompt: str) -> str:
        *body, question = prompt.strip().split("\n")
        want = set(question.lower().split())
        parts = [s for s in re.split(r"(?<=[.!?])\s+", " ".join(body)) if s]
        return max(parts, key=lambda s: (len(want & set(s.lower().split())), -len(s)), default="")

    return lambda prompts: [answer(p) for p in prompts]


def generate(rows: DataFrame, prompt: Column, load: Callable[[], Generator] = extractive_generator, samples: int = 1) -> DataFrame:
    """Adds ``pred``: ``samples`` answers to the prompt."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = retried(load())
        for part in parts:
            drawn = [call(part.fillna("").tolist()) for _ in range(samples)]
            yield pd.Series([list(x) for x in zip(*drawn)])

    return rows.withColumn("pred", run(prompt))


def heading_model() -> Callable[[list[tuple[int, str]]], str]:
    """Replies with a line for each sentence that starts a heading or, on level two, that stands behind a blank or short line."""

    def reply(window: list[tuple[int, str]]) -> str:
        out = []
        for n, (i, line) in enumerate(window):
            marks = len(re.match(r"[ #]*", line)[0].replace(" ", ""))
            if marks or n == 0:
                out.append(f"{i}, {LEVELS[max(marks, 1) - 1]}, True")
            elif len(line.strip()) < 20:
                out.append(f"{i}, {LEVELS[1]}, False")
        return "\n".join(out)

    return reply


def parse_reply(reply: str) -> list[list[int]]:
    """Points by level; a point stays if it is greater than the one before it on its level. A bad line raises ValueError."""
    points: list[list[int]] = [[] for _ in LEVELS]
    last: dict[int, int] = {}
    for line in reply.strip().split("\n"):
        if not (m := _LINE.match(line)):
            raise ValueError(line)
        if m[2] in LEVELS:
            level, p = LEVELS.index(m[2]), int(m[1])
            if level not in last or p > last[level]:
                points[level].append(p)
            last[level] = p
    return points


def points_valid(points: list[int], start: int, end: int) -> bool:
    return not points or (points[0] >= start and all(a < b <= end for a, b in zip(points, points[1:])))


def iterate_windows(lines: list[str], model: Callable, window: int, mode: int = 2, count: Callable[[str], int] = lambda s: len(s.split())) -> tuple[list[list[int]], int]:
    """Cut points by level of a document's lines, and how many replies could not be used.

    Windows start at the last level-1 point of a window that has several, which
    is then decided anew; otherwise behind the window, with residual lines.
    """
    points: list[list[int]] = [[] for _ in LEVELS]
    errors = start = 0
    residual: list[str] = []
    while start < len(lines):
        used, end = sum(map(count, residual)), start
        while end < len(lines) and (end == start or used + count(lines[end]) <= window):
            used += count(lines[end])
            end += 1
        shown = [(i, x) for i, x in enumerate([*residual, *lines[start:end]])]
        try:
            local = parse_reply(model(shown))
            if not all(points_valid(p, 0, len(shown) - 1) for p in local):
                raise ValueError("points out of order")
            local = [[p - len(residual) + start for p in level if p >= len(residual)] for level in local]
        except ValueError:
            local = [[start], *([] for _ in LEVELS[1:])]
            errors += 1
        if end < len(lines) and len(local[0]) > 1 and local[0][-1] > start:
            most, residual = local[0][-1], []
        else:
            most = end
        for own, new in zip(points, local):
            own += [p for p in new if p < most]
        start = most
        if most == end:
            residual = residual_lines(lines, points, start, window, mode)
            if sum(map(count, residual)) >= window:
                residual = []
    return points, errors


def model_chunks(docs: DataFrame, window: int = 16384, mode: int = 2, load: Callable = heading_model) -> DataFrame:
    """(doc_id, level, p) of each document's non-blank lines by a windowed model; errors count replies that were not usable."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = retried(load())
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                lines = [x for x in (text or "").split("\n") if x.strip() and x.strip(" #")]
                points, errors = iterate_windows(lines, model, window, mode)
                rows += [(doc, level + 1, p, errors) for level, own in enumerate(points) for p in own]
            yield pd.DataFrame(rows, columns=["doc_id", "level", "p", "errors"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, level int, p int, errors int")


def shortest_paragraph() -> Callable[[list[tuple[int, str]]], str]:
    """Names the paragraph, not the first, that shares fewest words with the one before it."""

    def reply(shown: list[tuple[int, str]]) -> str:
        sets = [set(t.split()) for _, t in shown]
        scores = [(len(a & b) / (len(a | b) or 1), i) for (a, b, (i, _)) in zip(sets, sets[1:], shown[1:])]
        return f"Answer: ID {min(scores)[1]}" if scores else "none"

    return reply


def cut_paragraphs(paragraphs: list[str], decide: Callable, target: int = 550) -> list[int]:
    """Ends of chunks: a window grows to the target of words, and the decider names the paragraph where the topic turns.

    A reply that names none moves on by the window.
    """
    cuts, at, n = [], 0, len(paragraphs)
    while at < n - 5:
        i = words = 0
        while at + i < n and round(1.2 * words) < target:
            words += len(paragraphs[at + i].split())
            i += 1
        end = i - 1 if i > 1 and round(1.2 * words) >= target else i
        m = re.search(r"Answer: ID (\d+)", decide([(k, paragraphs[k]) for k in range(at, at + end)]).rsplit("</think>", 1)[-1])
        now = int(m[1]) if m and at < int(m[1]) < n else at + max(1, i - 1)
        if m and now == int(m[1]):
            cuts.append(now)
        at = now
    return [*cuts, n] if n else []


def paragraph_chunks(docs: DataFrame, target: int = 550, load: Callable = shortest_paragraph) -> DataFrame:
    """(doc_id, i, text) of paragraphs cut where the decider sees the topic turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decide = retried(load())
        for batch in pieces(batches):
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                parts = [x for x in (text or "").split("\n") if x.strip()]
                at = 0
                for i, end in enumerate(cut_paragraphs(parts, decide, target)):
                    rows.append((doc, i, "\n".join(parts[at:end])))
                    at = end
            yield pd.DataFrame(rows, columns=["doc_id", "i", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, i int, text string")


def covered_facts(facts: Column, answer: Column) -> Column:
    """The stand-in judge: (statement, attributed) by whether the normalised fact stands in the answer."""
    return F.transform(facts, lambda x: F.struct(x.alias("statement"), F.contains(fn.normalize_answer(answer), fn.normalize_answer(x)).cast("int").alias("attributed")))
