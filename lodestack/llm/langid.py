"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded labelled text. A text is
parsed greedily against it: each phrase is the longest match from where the last
one ended. A language's entropy is its number of phrases, weighted by the
logarithm of its text's length, per symbol; the language with the least wins.

Texts are lower-cased and every stretch without letters becomes one space. A
text is parsed whole, as are those of a batch together: at each step every text
that is long enough advances by one symbol, in numpy, ``BLOCK`` steps at a time.

The sample that is learned from is bounded by parameters: ``MAX_LANGUAGES``,
``SAMPLE_DOCS`` different texts and ``SAMPLE_SYMBOLS`` of each language (of the
last text taken, as much as fits), ``ALL_SYMBOLS`` of all. The ``MAX_LETTERS``
most frequent letters have symbols of their own; all others share ``SHARED``
symbols by a hash.

Defined results: a null text, one without letters, and any text where nothing
was learned give ``und`` with score 0; languages that tie go by name; repeated
rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the sample that is learned from: languages (the most frequent), documents and symbols of each, symbols of all.
MAX_LANGUAGES, SAMPLE_DOCS, SAMPLE_SYMBOLS, ALL_SYMBOLS = 1000, 60, 40_000, 200_000
#: Documents of this many characters are taken first.
SHORT, LONG = 200, 4_000
MAX_LETTERS, SHARED = 120, 32
#: Steps taken at a time, symbols parsed together, and characters made symbols at a time.
BLOCK, TOGETHER, SLICE = 1024, 1 << 24, 1 << 21
SHARPNESS = 4.0
GAP, FIRST = 0, 1
_NO_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower case, with one space for every stretch that has no letter."""
    return _NO_LETTERS.sub(" ", text.lower())


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Moves of the suffix automaton as a table: row = state (0: the start), column = symbol, -1: no move."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in moves[p]:
            moves[p][s] = new
            p = link[p]
        if p >= 0:
            q = moves[p][s]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(s) == q:
                    moves[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(moves), width), -1, np.int32)
    for state, out in enumerate(moves):
        for s, to in out.items():
            table[state, s] = to
    return table


@functools.cache
def _letters() -> np.ndarray:
    """True for every code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class CrossParser:
    def __init__(self, texts: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in texts]
        count: dict[str, int] = {}
        for _, text in texts:
            for c in plain(text):
                count[c] = count.get(c, 0) + 1
        known = [c for c in sorted(count, key=lambda c: (-count[c], c)) if c != " "][:MAX_LETTERS]
        shared = np.arange(0x110000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        self.symbol = np.where(_letters(), (shared % np.uint64(SHARED)).astype(np.uint8) + np.uint8(FIRST), np.uint8(GAP))
        for i, c in enumerate(known):
            self.symbol[ord(c)] = FIRST + SHARED + i
        self.width = FIRST + SHARED + len(known)
        tables, start, at = [], [], 0
        for _, text in texts:
            table = suffix_automaton(self.symbols(plain(text)).tolist(), self.width)
            tables.append(np.where(table < 0, -1, table + at))
            start.append(at)
            at += len(table)
        self.moves = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)
        self.start = np.array(start, np.int32)[:, None]
        self.weight = np.array([math.log2(len(plain(text)) + 2) for _, text in texts])

    def symbols(self, text: str) -> np.ndarray:
        parts = [np.full(1, FIRST, np.uint8)]
        for a in range(0, len(text), SLICE):
            codes = self.symbol[np.frombuffer(text[a : a + SLICE].lower().encode("utf-32-le", "surrogatepass"), "<u4")]
            gap = codes == GAP
            parts.append(codes[~(gap & np.r_[parts[-1][-1] == GAP, gap[:-1]])] if len(codes) else codes)
            if not len(parts[-1]):
                parts.pop()
        return np.concatenate(parts)[1:]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text, given as symbols, against each language: shape (languages, texts)."""
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        out = np.zeros((len(self.names), len(texts)), np.int64)
        state = np.repeat(self.start, len(texts), axis=1)
        fresh = self.moves[self.start * self.width + np.arange(self.width)]  # a phrase's first move, by language and symbol
        fresh = np.where(fresh < 0, self.start, fresh)
        for at in range(0, int(sizes.max(initial=0)), BLOCK):
            steps = min(BLOCK, int(sizes.max()) - at)
            grid = np.zeros((steps, int(np.count_nonzero(sizes > at))), np.uint8)
            for column in range(grid.shape[1]):
                part = texts[order[column]][at : at + steps]
                grid[: len(part), column] = part
            running = np.searchsorted(-sizes[order], -(np.arange(steps) + at), side="left")
            for t, n in enumerate(running):
                now = grid[t, :n]
                to = self.moves[state[:, :n] * self.width + now]
                ended = to < 0
                out[:, :n] += ended | (state[:, :n] == self.start)  # a phrase begins here
                state[:, :n] = np.where(ended, fresh[:, now], to)
        back = np.empty_like(out)
        back[:, order] = out
        return back

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol by text and language, and the number of letters of each text."""
        bits, symbols, letters = np.zeros((len(texts), len(self.names))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = []
        first = waiting = 0
        for i, text in enumerate(texts):
            codes = self.symbols(text or "")
            symbols[i], letters[i] = len(codes), np.count_nonzero(codes != GAP)
            held.append(codes)
            waiting += len(codes)
            if self.names and (waiting >= TOGETHER or i + 1 == len(texts)):
                bits[first : i + 1] = self.phrases(held).T
                held, first, waiting = [], i + 1, 0
        return bits * self.weight / np.maximum(symbols, 1)[:, None], letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        bits, letters = self.entropies(texts)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(-SHARPNESS * (bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
        return [self.names[b] if n else "und" for b, n in zip(best, letters)], np.where(letters > 0, score, 0.0)


@functools.lru_cache(maxsize=2)
def parser(model: tuple[tuple[str, str], ...]) -> CrossParser:
    """One per Python worker and model."""
    return CrossParser(model)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[tuple[str, str], ...]:
    """(language, text) of a bounded sample: different texts, by their hash, until the bound of symbols."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MAX_LANGUAGES).collect()}
    if not counts:
        return ()
    symbols = min(SAMPLE_SYMBOLS, ALL_SYMBOLS // len(counts))
    grains = 1 << 30
    limits = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, int(grains * min(1.0, 40 * SAMPLE_DOCS / n)))])
    hashed = F.xxhash64(text)
    size = F.char_length(text)
    near = rows.where(F.col(lang).isin(list(counts)) & (F.pmod(hashed, F.lit(grains)) <= F.try_element_at(limits, F.col(lang))))
    near = near.select(F.col(lang).alias("lang"), F.left(F.col(text), F.lit(4 * symbols)).alias("text"), (~size.between(SHORT, LONG)).alias("odd"), hashed.alias("hash")).dropDuplicates(["lang", "hash"])
    # The first of each language, found within salted parts before they meet.
    parts = Window.partitionBy("lang", F.pmod("hash", F.lit(64))).orderBy("odd", "hash")
    some = near.withColumn("n", F.row_number().over(parts)).where(F.col("n") <= SAMPLE_DOCS).drop("n")
    sample = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("odd", "hash"))).where(F.col("n") <= SAMPLE_DOCS).select("lang", "text", "n")
    found: dict[str, str] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["n"])):
        have = found.get(r["lang"], "")
        if len(have) < symbols:
            found[r["lang"]] = f"{have} {plain(r['text'])}"[:symbols]
    return tuple(sorted((k, v) for k, v in found.items() if v.strip()))


def identify(docs: DataFrame, model: tuple[tuple[str, str], ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = parser(shared.value)
        for batch in batches:
            names, score = own.predict(list(batch["text"]))
            yield pd.DataFrame({"key": batch["key"], "lang_pred": names, "score": score})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 4; the rows of fold 2 are held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(fold() != 2))
    return identify(docs, model).select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")
