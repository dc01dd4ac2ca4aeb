import random
import re

import pytest

from lodestack.llm.toxicity import ARCS, NEGATIONS, REPORTS, TARGETS, Acceptor, Clauses, Grammar, learn, learn_grammar, op3_toxicity, score_texts

SCHEMA = "doc_id long, text string, lang string, score string, _key long"
FACTORS = {("insult", "plain"): 1.0, ("insult", "targeted"): 1.5, ("insult", "negated"): 0.5, ("insult", "reported"): 0.25, ("threat", "plain"): 1.0, ("threat", "targeted"): 4.0, ("threat", "negated"): 0.125, ("threat", "reported"): 0.0625}
GRAMMAR = Grammar((("idiot", 2.0), ("scum$", 1.0)), (("kill$", 1.0),), tuple(FACTORS.items()))


def test_clauses_not_words():
    own = Acceptor(GRAMMAR)
    for text, weight in [
        (None, 0), ("", 0), ("fine words", 0), ("Idiot", 2), ("idiotic idiots", 4), ("scummy scum", 1), ("antiscum", 0),
        ("you idiot", 3), ("not an idiot", 1), ("he said idiot", 0.5), ("he said: idiot", 2), ("he said you are no idiot", 0.5),
        ("never. idiot", 2), ("isn't scum", 0.5), ("I kill you", 4), ("you I kill", 4), ("I kill", 1), ("idiot you not", 3), ("you. idiot", 2),
        ("not you idiot", 1), ("I never kill", 0.125), ("she wrote kill", 0.0625), ("you kill, idiot", 7), ("idiot, not scum", 2.5),
    ]:
        assert own.weight(text) == weight, text


def brute(text):
    """Clause by clause and word by word, without the machine."""
    total = 0.0
    for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
        words = re.findall(r"[\w']+", clause)
        heads = [("insult", 2.0) if w.startswith("idiot") else ("insult", 1.0) if w == "scum" else ("threat", 1.0) if w == "kill" else None for w in words]
        targeted = any(w in TARGETS for w in words)
        for i, head in enumerate(heads):
            if head:
                before = words[:i]
                reported, negated = any(w in REPORTS for w in before), any(w in NEGATIONS or w.endswith("n't") for w in before)
                arc = "reported" if reported else "negated" if negated else "targeted" if targeted else "plain"
                total += head[1] * FACTORS[head[0], arc]
    return total


def test_equals_brute_force():
    rng, own = random.Random(1), Acceptor(GRAMMAR)
    words = ["idiot", "idiots", "scum", "scummy", "kill", "killed", "you", "du", "not", "wasn't", "said", "dijo", "word", "other", "é1"]
    for _ in range(2000):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "\n", ": "]) for _ in range(rng.randint(0, 30)))
        assert own.weight(text) == pytest.approx(brute(text)), text


def test_one_path_is_accepted():
    acceptor = Clauses(FACTORS)
    assert acceptor.best([]) == (0, []) and acceptor.best([("target", 0)]) == (0, [])
    assert acceptor.best([("insult", 2.0), ("negation", 0), ("target", 0), ("threat", 1.0)]) == (3.125, [("insult", "targeted", 2.0), ("threat", "negated", 1.0)])


def test_learns_arcs_and_threats():
    rng = random.Random(2)
    filler = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(30))
    bad = [(f"{filler()} grumpfel you {filler()}. they kill {filler()}", 1) for _ in range(60)]
    good = [(f"{filler()}. he wrote grumpfel {filler()}" if i % 6 == 0 else filler(), 0) for i in range(200)]
    grammar = learn_grammar([r for pair in zip(bad, good) for r in pair] + good[60:], 0.25)
    factors = dict(grammar.factors)
    assert factors["insult", "reported"] < ARCS["reported"] < factors["insult", "targeted"] and dict(grammar.threats)["kill$"] > 2 > dict(grammar.threats)["hurt$"] == 1
    own = Acceptor(grammar)
    assert own.score(f"{filler()} you grumpfel") > own.score(f"{filler()} he wrote grumpfel")


def test_learns_stems_and_words():
    bad = [(f"xlowei{c}{c} mid{c} the end{c}", 1) for c in "abcdefghij"] + [(f"lowei{c}{c} rest{c}", 1) for c in "abcdefghijklmnop"] + [(f"word{c} grumpf tail{c}", 1) for c in "abcdefghijklmn"]
    good = [(" ".join(f"{w} n{i}x{k}" for k, w in enumerate((f"lowland{c}", "the", "grump", "rest", f"word{c}", "tail"))), 0) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" * 4)]
    rows = [(t + " " + " ".join(f"f{i}q{k}" for k in range(40)), y) for i, (t, y) in enumerate(bad + good)]
    grammar = learn_grammar(rows, 0.2)
    names = {p for p, _ in grammar.insults}
    assert "lowei" in names and "grumpf$" in names and not names & {"low", "lowe", "grump", "the$"}
    own = Acceptor(grammar)
    assert own.score("some loweizz here") > 0.9 > 0.5 > own.score("lowland grump")


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "you scum " * 40_000), (3, "you scum " * 40_000), (4, "calm"), (None, "idiot")]
    df = spark.createDataFrame([(i, t, None, "x", 1) for i, t in rows], SCHEMA)
    got = score_texts(df, GRAMMAR).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and by[1] == by[2] == by[4] < 0.3 < by[3]
    assert score_texts(df.limit(0), GRAMMAR).count() == 0
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 1), (4, 0, 1), (9, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    assert learn(df, labels).threats and learn(df, labels.limit(0)).threats and learn(df.limit(0), labels).threats


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [r for r in op3_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in truth]
    hits = sum(r.predicted and truth[r.doc_id] for r in held)
    assert len(held) > 600 and hits / sum(truth[r.doc_id] for r in held) >= 0.93 and hits / sum(r.predicted for r in held) > 0.93
