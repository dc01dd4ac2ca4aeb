"""Training samples for a chunking model: numbered windows of a document's lines with their cut points as answers."""

from __future__ import annotations

import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as fn

INSTRUCTION = "Mark the numbered sentences where a section starts, with its level and whether it is a heading."

#: Lines whose samples a step makes at a time; a longer document is taken alone.
STEP = 1 << 16


class Line(NamedTuple):
    """A line's place in its document, its level and its words, with heading marks and without."""

    at: int
    level: int
    n: int
    n_shown: int


def _residual(annotation: list[list[list]], f: int, s: int, rng: random.Random) -> list:
    """Lines carried into the next sample: of the segment before (or not) and of this one up to part ``s``, the first part and up to four others, 1 to 20 lines of each."""
    carried = []
    for i in range(max(0, f - rng.randint(0, 1)), f + 1):
        first, rest = annotation[i][0], annotation[i][1 : s + 1] if i == f else annotation[i][1:]
        carried += [first, *rng.sample(rest, rng.randint(min(1, len(rest)), min(4, len(rest))))]
    return [x for part in carried for x in part[: rng.randint(1, 20)]]


def _samples(lines: list[Line], window: int, least: int, max_level: int, omit_p: float, shuffle_p: float, rng: random.Random) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
    """(places of the lines shown, points) of each sample of one document's lines."""
    annotation: list[list[list]] = []
    for x in lines:
        if not annotation or x.level == 1:
            annotation.append([[x]])
        elif x.level == 2:
            annotation[-1].append([x])
        else:
            annotation[-1][-1].append(x)
    if rng.random() < shuffle_p:
        rng.shuffle(annotation)

    shown: list[int] = []
    points: list[tuple[int, int]] = []
    used = len(INSTRUCTION.split())

    def show(x) -> None:
        nonlocal used
        shown.append(x.at)
        used += 2 + x.n_shown

    for f, segment in enumerate(annotation):
        n = sum(map(len, segment))
        if sum(x.n for part in segment for x in part) <= least:
            continue
        if rng.random() < omit_p:
            annotation[f] = segment = segment[: rng.randint(min(n, 5), min(n, 15))]
        for s, part in enumerate(segment):
            if rng.random() < omit_p:
                part = part[: rng.randint(min(len(part), 15), min(len(part), 25))]
            for x in part:
                if used >= window:
                    break
                if 0 < x.level <= max_level:
                    points.append((len(shown), x.level))
                show(x)
            if used >= window:
                yield shown, points
                shown, points, used = [], [], len(INSTRUCTION.split())
                carried = _residual(annotation, f, s, rng)
                if used + sum(2 + x.n_shown for x in carried) < window:
                    for x in carried:
                        show(x)
                break
    yield shown, points


def training_samples(lines: DataFrame, window: int = 8192, least: int = 50, max_level: int = 10, key: str = "doc_id", omit_p: float = 0.0, shuffle_p: float = 0.0, seed: int = 1) -> DataFrame:
    """(key, instruction, input, output, n_lines) of lines (key, pos, text) with # headings.

    First-level segments of at most ``least`` words are left out; the others fill
    one window, counted in words of the instruction and the numbered lines. A
    sample ends with the line that fills it; the rest of that first-level segment
    goes, and the next sample opens with residual lines, which have no points and
    are left out where they alone would fill the window.
    What is left at the end of a document is its last sample, even without points.

    With probability ``shuffle_p`` a document's first-level segments are shuffled;
    with ``omit_p`` a first-level segment keeps 5 to 15 of its second-level ones,
    and one of these 15 to 25 of its lines. Choices hang on ``seed`` and the key alone.
    """
    bare = lambda text: F.regexp_replace(text, "^[ #]*", "")
    plain = F.when(fn.heading_level(F.col("text")) > 0, bare(F.col("text"))).otherwise(F.col("text"))
    leveled = lines.where("text <> ''").select(key, "pos", "text", fn.heading_level(F.col("text")).alias("level"), F.size(fn.split_space(F.col("text"))).alias("n"), F.size(fn.split_space(plain)).alias("n_shown"))
    per_doc = leveled.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "text", "level", "n", "n_shown"))).alias("lines"))
    names = "One Two Three Four Five Six Seven Eight Nine Ten".split()
    kind = pa.list_(pa.struct([("shown", pa.list_(pa.int32())), ("output", pa.string())]))

    # Python sees levels and counts alone; the lines stay in the JVM, which puts them in by place.
    @F.arrow_udf("array<struct<shown:array<int>,output:string>>")
    def choose(levels: pa.Array, ns: pa.Array, n_shown: pa.Array, seeds: pa.Array) -> pa.Array:
        made, at = [], 0
        ends = np.cumsum(levels.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        while at < len(levels):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
            rows = []
            for *numbers, start in zip(*(x.slice(at, to - at).to_pylist() for x in (levels, ns, n_shown, seeds))):
                found = _samples([Line(i, *x) for i, x in enumerate(zip(*numbers))], window, least, max_level, omit_p, shuffle_p, random.Random(start))
                rows.append([{"shown": shown, "output": "\n".join(f"{p}, Level {names[level - 1]}, True" for p, level in points)} for shown, points in found])
            made.append(pa.array(rows, kind))
            at = to
        return pa.concat_arrays(made) if made else pa.array([], kind)

    def sample(s: Column) -> Column:
        line = lambda at: F.col("lines")[at]
        text = lambda x: F.when(x["level"] > 0, bare(x["text"])).otherwise(x["text"])
        numbered = F.transform(s["shown"], lambda at, i: fn.index_format(i, text(line(at))))
        return F.struct(F.array_join(numbered, "\n").alias("input"), s["output"].alias("output"), F.size(s["shown"]).alias("n_lines"))

    numbers = [F.col(f"lines.{name}") for name in ("level", "n", "n_shown")]
    chosen = per_doc.withColumn("samples", choose(*numbers, F.xxhash64(key, F.lit(seed))))
    return chosen.select(key, F.explode(F.transform("samples", sample)).alias("s")).select(key, F.lit(INSTRUCTION).alias("instruction"), "s.input", "s.output", "s.n_lines")


def training_variants(lines: DataFrame, seeds: list[int], **options) -> DataFrame:
    """The samples with their ``type``: as they are, and per seed with segments shuffled, and shuffled and cut."""
    out = training_samples(lines, **options).withColumn("type", F.lit("original"))
    for seed in seeds:
        for name, omit_p in (("internal_shuffle", 0.0), ("augmented", 1.0)):
            out = out.unionByName(training_samples(lines, **options, omit_p=omit_p, shuffle_p=1.0, seed=seed).withColumn("type", F.lit(f"{name}_s{seed}")))
    return out


def seeded_variants(samples: DataFrame, seeds: list[int], order: str = "input") -> DataFrame:
    """The samples and, per seed, the same rows with a reproducible sort key ``shuffle`` from a hash of the row and the seed."""
    out = samples.withColumn("variant", F.lit("original")).withColumn("shuffle", F.xxhash64(order))
    for seed in seeds:
        out = out.unionByName(samples.withColumn("variant", F.lit(f"shuffled {seed}")).withColumn("shuffle", F.xxhash64(order, F.lit(seed))))
    return out


def sampled(rows: DataFrame, share: float, seed: int = 1, key: str = "doc_id") -> DataFrame:
    """The rows whose key a hash with the seed puts into the first ``share`` of its range: the same ones in every run."""
    grains = 1 << 30
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(grains)) < int(grains * share))
