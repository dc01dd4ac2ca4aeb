"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five lexical transducers turn a clause's words into symbols: insult, threat,
target, negation and reported speech. They are compiled into one machine, whose
scan is an Aho-Corasick automaton over the insults and threats; only clauses
with one of these are read. The symbols go through a weighted acceptor of
clauses. Its state holds whether a negation and a report came before, and a
promise: the machine guesses at the start whether the clause names a target
anywhere, and only the path whose guess comes true is accepted. Each insult or
threat takes an arc by that state: reported, negated, targeted (insult + target,
threat + target) or plain, each head with four arcs of its own. An arc weighs the
pattern's own weight times the arc's factor; a clause weighs the best accepted
path (max-plus semiring), a document the sum of its clauses.

Learned from a bounded sample of labelled rows: the insult transducer (word
beginnings and whole words), the weights of the threats, the arcs' factors from
prior values, and the logistic function that makes a score of a document's
weight. The logistic function is fitted on weights of the same grammar, learned
from the other half of the sample. The lists of threats, targets, negations and
reports are small and fixed.

Defined results: a null or empty text has weight 0 and gets the score of a text
without matches; without labels nothing is learned and the fixed lists alone
count; repeated rows get equal scores, and count once in learning; an empty table
gives an empty table.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.langid import fold

#: Bounds of the labelled sample: different texts of each label, and characters up to which a text is taken first.
SAMPLE = {1: 900, 0: 1800}
SHORT = 4_000
MAX_PATTERNS = 2_000
SHORTEST, LONGEST = 3, 9
#: A pattern's share of words in toxic texts against others', its statistic by documents, and its counted uses in a text.
LEAST_RATIO, LEAST_EVIDENCE, MOST_IN_TEXT = 6.0, 15.0, 5
END = "$"

THREATS = tuple("kill murder destroy beat hurt stab shoot töten umbringen schlagen tuer frapper détruire matar golpear destruir".split())
TARGETS = tuple("you your yours u du dich dir euch ihr tu te toi vous ti usted ustedes vosotros".split())
NEGATIONS = tuple("not no never none isn't aren't don't nicht kein keine keinen nie pas jamais nunca jamás".split())
REPORTS = tuple("said says wrote quoted called reported sagte sagt schrieb dit disait écrit dijo dice escribió".split())

INSULT, THREAT, TARGET, NEGATION, REPORT = "insult", "threat", "target", "negation", "report"
HEADS = (INSULT, THREAT)
#: The arcs of a head, the first that applies, and the factors that learning starts from.
ARCS = {"reported": 0.4, "negated": 0.3, "targeted": 1.25, "plain": 1.0}
#: Matches that a prior factor is worth, and uses that a threat's prior weight of 1 is worth.
PRIOR_MATCHES, PRIOR_USES = 5, 5

_WORD = re.compile(r"[\w']+")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


@dataclass(frozen=True)
class Transducer:
    """Words to one symbol: each pattern is a word's beginning or, with ``END``, a whole word, and has a weight."""

    symbol: str
    patterns: tuple[tuple[str, float], ...]


def whole(symbol: str, words: tuple[str, ...]) -> Transducer:
    return Transducer(symbol, tuple((w + END, 1.0) for w in words))


@dataclass(frozen=True)
class Grammar:
    """The weights of insults and threats, the arcs' factors by (head, arc), and the logistic function."""

    insults: tuple[tuple[str, float], ...]
    threats: tuple[tuple[str, float], ...] = tuple((w + END, 1.0) for w in THREATS)
    factors: tuple[tuple[tuple[str, str], float], ...] = tuple(((head, arc), f) for head in HEADS for arc, f in ARCS.items())
    #: Taken off for each word of a text: the share of words that matches make up in toxic texts.
    per_word: float = 0.0
    slope: float = 1.0
    intercept: float = -3.0

    def transducers(self) -> list[Transducer]:
        return [Transducer(INSULT, self.insults), Transducer(THREAT, self.threats), whole(TARGET, TARGETS), whole(NEGATION, NEGATIONS), whole(REPORT, REPORTS)]


class Clauses:
    """The acceptor: states (negated, reported, promise of a target: "none", "open" or "kept"), and its moves."""

    def __init__(self, factors: dict[tuple[str, str], float]):
        self.starts = [(False, False, "none"), (False, False, "open")]
        self.moves: dict[tuple[tuple, str], tuple[tuple, str | None]] = {}
        for negated in (False, True):
            for reported in (False, True):
                for promise in ("none", "open", "kept"):
                    state = (negated, reported, promise)
                    self.moves[state, NEGATION] = (True, reported, promise), None
                    self.moves[state, REPORT] = (negated, True, promise), None
                    if promise != "none":  # a target refutes the path that promised none
                        self.moves[state, TARGET] = (negated, reported, "kept"), None
                    arc = "reported" if reported else "negated" if negated else "plain" if promise == "none" else "targeted"
                    for head in HEADS:
                        self.moves[state, head] = state, arc
        self.factors = factors

    def best(self, symbols: list[tuple[str, float]]) -> tuple[float, list[tuple[str, str, float]]]:
        """The weight of the best accepted path, and its (head, arc, pattern's weight)."""
        found: tuple[float, list[tuple[str, str, float]]] = (-math.inf, [])
        for start in self.starts:
            state, total, taken = start, 0.0, []
            for symbol, weight in symbols:
                if (move := self.moves.get((state, symbol))) is None:
                    break
                state, arc = move
                if arc is not None:
                    total += weight * self.factors[symbol, arc]
                    taken.append((symbol, arc, weight))
            else:
                if state[2] != "open" and total > found[0]:
                    found = total, taken
        return found


class Acceptor:
    """The compiled grammar."""

    def __init__(self, grammar: Grammar):
        import ahocorasick

        self.grammar = grammar
        self.clause = Clauses(dict(grammar.factors))
        self.context: dict[str, str] = {}
        self.weights: dict[tuple[str, str], float] = {}
        self.heads = ahocorasick.Automaton()
        for t in grammar.transducers():
            for pattern, weight in t.patterns:
                stem = pattern.removesuffix(END)
                if t.symbol in HEADS:
                    self.weights[t.symbol, pattern] = weight
                    self.heads.add_word(stem, (*self.heads.get(stem, ()), (t.symbol, pattern)))
                else:
                    self.context[stem] = t.symbol
        if self.weights:
            self.heads.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, tuple[str, str]]]:
        """(start, (head, pattern)) of each match at the start of a word, in order of its end."""
        if not self.weights:
            return
        for end, patterns in self.heads.iter(text):
            for head, pattern in patterns:
                whole = pattern.endswith(END)
                start = end + 1 - len(pattern) + whole
                if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
                    continue
                if whole and end + 1 < len(text) and (text[end + 1].isalnum() or text[end + 1] == "_"):
                    continue
                yield start, (head, pattern)

    def clauses(self, text: str) -> Iterator[list[tuple[str, float]]]:
        """The symbols of each clause with a match, each with its pattern's weight."""
        found: dict[int, tuple[str, str]] = {}
        for start, match in self.hits(text):
            if start not in found or self.weights[match] > self.weights[found[start]]:
                found[start] = match
        starts = sorted(found)
        i = 0
        while i < len(starts):
            begin = max(text.rfind(c, 0, starts[i]) for c in ".!?;:\n") + 1
            end = m.start() if (m := _CLAUSE_END.search(text, starts[i])) else len(text)
            while i < len(starts) and starts[i] < end:
                i += 1
            symbols = []
            for word in _WORD.finditer(text, begin, end):
                if (match := found.get(word.start())) is not None:
                    symbols.append((match[0], self.weights[match]))
                elif (symbol := NEGATION if word.group().endswith("n't") else self.context.get(word.group())) is not None:
                    symbols.append((symbol, 0.0))
            yield symbols

    def runs(self, text: str | None) -> Iterator[tuple[float, list[tuple[str, str, float]]]]:
        """Of each clause with a match, the weight and the arcs taken."""
        return map(self.clause.best, self.clauses((text or "").lower()))

    def weight(self, text: str | None) -> float:
        return sum(w for w, _ in self.runs(text))

    def surplus(self, text: str | None) -> float:
        """The weight beyond what the text's length takes off."""
        return max(-40.0, min(40.0, self.weight(text) - self.grammar.per_word * ((text or "").count(" ") + 1)))

    def score(self, text: str | None) -> float:
        g = self.grammar
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, g.slope * self.surplus(text) + g.intercept))))


@functools.lru_cache(maxsize=2)
def acceptor(grammar: Grammar) -> Acceptor:
    return Acceptor(grammar)


def _beginnings(text: str) -> Counter[str]:
    """How many words of a text have each beginning, and each whole word."""
    out: Counter[str] = Counter()
    for w, n in Counter(_WORD.findall(text)).items():
        for size in range(SHORTEST, min(len(w), LONGEST) + 1):
            out[w[:size]] += n
        if len(w) >= SHORTEST:
            out[w + END] += n
    return out


def _evidence(bad: int, n_bad: int, good: int, n_good: int) -> float:
    """The log-likelihood ratio statistic of two shares of documents."""
    all_share = (bad + good) / (n_bad + n_good)
    return 2 * sum(k * math.log(k / (n * q)) for k, n, q in ((bad, n_bad, all_share), (good, n_good, all_share), (n_bad - bad, n_bad, 1 - all_share), (n_good - good, n_good, 1 - all_share)) if k)


def learn_patterns(texts: list[str], toxic: list[bool]) -> tuple[dict[str, float], float]:
    """Word beginnings and words that fill a far larger share of toxic texts, and their share of words there.

    Of beginnings with nearly the same support the longest stands. A text counts
    a beginning at most ``MOST_IN_TEXT`` times, so that no text rules alone.
    """
    n_bad, n_good = sum(toxic), len(toxic) - sum(toxic)
    held: list[Counter[str]] = [Counter(), Counter()]
    words: list[Counter[str]] = [Counter(), Counter()]
    size = [0, 0]
    for wanted in (True, False):
        for t, is_bad in zip(texts, toxic):
            if is_bad == wanted:
                own = _beginnings(t)
                if not is_bad:
                    own = {p: n for p, n in own.items() if p in held[1]}
                held[is_bad].update(own.keys())
                words[is_bad].update({p: min(n, MOST_IN_TEXT) for p, n in own.items()})
                size[is_bad] += t.count(" ") + 1
        if wanted:
            held[1] = Counter({p: n for p, n in held[1].items() if n >= 3})
    longer: dict[str, int] = defaultdict(int)
    for p, n in held[1].items():
        longer[p[:-1]] = max(longer[p[:-1]], n)
    accepted: dict[str, float] = {}
    for p in sorted(held[1], key=lambda p: (len(p), p)):
        ratio = (words[1][p] + 0.5) / (size[1] + 1) * (size[0] + 1) / (words[0][p] + 0.5)
        if ratio < LEAST_RATIO or longer[p] >= 0.9 * held[1][p] or any(p[:n] in accepted for n in range(SHORTEST, len(p))):
            continue
        if held[1][p] / n_bad > held[0][p] / n_good and _evidence(held[1][p], n_bad, held[0][p], n_good) >= LEAST_EVIDENCE:
            accepted[p] = math.log(ratio)
    accepted = dict(sorted(accepted.items(), key=lambda x: (-words[1][x[0]] * x[1], x[0]))[:MAX_PATTERNS])
    return accepted, sum(words[1][p] for p in accepted) / (size[1] + 1)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, lightly held towards slope 1."""
    a, b = 1.0, -3.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = w * p * (1 - p) + 1e-9
        g = np.array([(w * (y - p) * x).sum() - 0.5 * (a - 1), (w * (y - p)).sum() - 0.05 * (b + 3)])
        h = np.array([[(v * x * x).sum() + 0.5, (v * x).sum()], [(v * x).sum(), v.sum() + 0.05]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
        if abs(step).max() < 1e-6:
            break
    return max(a, 0.05), b


def _apart(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One of each group of near copies: a text goes where an earlier one shares one of its 8 smallest word-triple hashes."""
    import xxhash

    seen: set[int] = set()
    out = []
    for text, label in rows:
        w = _WORD.findall(text)
        own = set(sorted({xxhash.xxh3_64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))})[:8])
        if not own & seen:
            out.append((text, label))
        seen |= own
    return out


def _threat_weights(texts: list[str], toxic: list[bool]) -> dict[str, float]:
    """The logarithm of how much larger a threat's share of words is in toxic texts, from 1 where it isn't used; 0 at least."""
    uses, size = {True: Counter(), False: Counter()}, Counter()
    for t, is_bad in zip(texts, toxic):
        words = _WORD.findall(t)
        uses[is_bad].update(w for w in words if w in THREATS)
        size[is_bad] += len(words)
    out = {}
    for w in THREATS:
        n = uses[True][w] + uses[False][w]
        ratio = (uses[True][w] + 0.5) / (size[True] + 1) * (size[False] + 1) / (uses[False][w] + 0.5)
        out[w + END] = max(0.0, (n * math.log(ratio) + PRIOR_USES) / (n + PRIOR_USES))
    return out


def _weighted(texts: list[str], toxic: list[bool]) -> Grammar:
    """The transducers and the arcs' factors, without the logistic function."""
    learned, per_word = learn_patterns(texts, toxic)
    grammar = Grammar(tuple(sorted(learned.items())), tuple(sorted(_threat_weights(texts, toxic).items())), per_word=per_word)
    # How often the matches of each arc stand in toxic texts, as against all of the head's.
    own = Acceptor(grammar)
    count, bad = Counter(), Counter()
    for t, is_bad in zip(texts, toxic):
        for _, taken in own.runs(t):
            for head, arc, _ in taken:
                count[head, arc] += 1
                bad[head, arc] += is_bad
    factors = []
    for head in HEADS:
        usual = (sum(bad[head, a] for a in ARCS) + PRIOR_MATCHES) / (sum(count[head, a] for a in ARCS) + PRIOR_MATCHES)
        factors += [((head, arc), (bad[head, arc] / usual + PRIOR_MATCHES * prior) / (count[head, arc] + PRIOR_MATCHES)) for arc, prior in ARCS.items()]
    return replace(grammar, factors=tuple(factors))


def learn_grammar(rows: list[tuple[str, int]], share_toxic: float) -> Grammar:
    """The grammar from (text, label) rows; ``share_toxic``: of all labelled rows."""
    rows = _apart([(t.lower(), y) for t, y in rows])
    texts, y = [t for t, _ in rows], np.array([label for _, label in rows], float)
    if not rows or y.min() == y.max():
        return Grammar(())
    toxic = [bool(v) for v in y]
    # Weights for the logistic function come from a grammar learned on the other half.
    x = np.zeros(len(texts))
    for half in (0, 1):
        other = [i for i in range(len(texts)) if i % 2 != half]
        if len({toxic[i] for i in other}) < 2:
            continue
        own = Acceptor(_weighted([texts[i] for i in other], [toxic[i] for i in other]))
        for i in range(half, len(texts), 2):
            x[i] = own.surplus(texts[i])
    weights = np.where(y == 1, share_toxic / y.mean(), (1 - share_toxic) / (1 - y.mean()))
    slope, intercept = _logistic(x, y, weights)
    return replace(_weighted(texts, toxic), slope=slope, intercept=intercept)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Grammar:
    """Learns from whole texts of a sample of labelled rows, by a hash of the text, that is small enough for the driver."""
    flags = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    counts = {r["_label"]: r["count"] for r in flags.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return learn_grammar([], 0.0)
    grains = 1 << 30
    hashed = F.pmod(F.xxhash64(F.col("_key"), F.lit(7)), F.lit(grains))
    # Four times the sample is drawn, so that short and different texts can be taken first.
    near = F.when(F.col("_label") == 1, F.lit(int(grains * min(1, 4 * SAMPLE[1] / counts[1])))).otherwise(F.lit(int(grains * min(1, 4 * SAMPLE[0] / counts[0]))))
    drawn = F.broadcast(flags.where(hashed < near))
    rows = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).where(F.col("_text").isNotNull()).join(drawn, F.col("_doc") == F.col("_key"))
    rows = rows.select("_label", "_text", (F.char_length("_text") > SHORT).alias("_long"), F.xxhash64("_text").alias("_hash")).dropDuplicates(["_label", "_hash"])
    found = []
    for wanted, most in SAMPLE.items():
        top = rows.where(F.col("_label") == wanted).orderBy("_long", "_hash").limit(most).collect()
        found += [(n, wanted, r["_text"]) for n, r in enumerate(top)]
    return learn_grammar([(t, y) for _, y, t in sorted(found)], counts[1] / (counts[0] + counts[1]))


def score_texts(docs: DataFrame, grammar: Grammar, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = acceptor(shared.value)
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "score": [own.score(t) for t in batch["text"]]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, score double").withColumnRenamed("key", key)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = learn(docs, labels.where(fold() != 2))
    return score_texts(docs, grammar).select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
