import pytest
from pyspark.sql import functions as F

from lodestack.functions import metrics
from lodestack.functions import text as fn
from lodestack.operators.chunking import pack_sentences


def one(spark, make, *values):
    names = "abc"[: len(values)]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in zip(names, values)))
    return df.select(make(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize("make, value, want", [
    (fn.word_list, "Hello, wörld 中文 x2_y", ["hello", "wörld", "中", "文", "x2_y"]),
    (fn.normalize_answer, "The a-b, an  Apple's THE", "ab apples"),
    (fn.sentences_zh, "他说：“你好。”然后走了！真的？", ["他说：", "“你好。”", "然后走了！", "真的？"]),
    (fn.sentences_zh, "。开头", ["。", "开头"]),
    (fn.sentences_zh, "标题：", ["标题："]),
    (fn.sentences_zh_line, "今天天气很好。我们去公园散步。", ["今天天气很好。", "我们去公园散步。"]),
    (fn.heading_level, "## x", 2), (fn.heading_level, "# # x", 2), (fn.heading_level, "x #", 0),
    (lambda c: fn.replace_heading(c, "# "), " ## Title", "# Title"), (lambda c: fn.replace_heading(c, "# "), "Title", "Title"),
    (lambda c: fn.truncate_sentence(c, 1, 1), "abcdefghijklmnopqrstuvwxyz012345678", "abcdefghijz012345678"[:10] + "z012345678"[-10:]),
    (lambda c: fn.truncate_sentence(c, 100, 0), "x" * 35, "x" * 35), (lambda c: fn.truncate_sentence(c, -1, 0), "x" * 35, "x" * 35),
    (lambda c: fn.merge_short_sentences(fn.sentences_en(c)), "Hi. Go on now. This is longer. No.", ["Hi. Go on now.", "This is longer.", "No."]),
    (fn.answer_paragraph, "ID 3</think>Answer: ID 17", 17), (fn.answer_paragraph, "none", None),
    (fn.json_object, 'x{"a"}</think>so {"b": {"c": 1}} end', '{"b": {"c": 1}}'),
    (fn.file_key, "/x/y/a b.c.txt", "a b.c"), (fn.chunk_id_doc, "a_b_12", "a_b"), (fn.chunk_id_ordinal, "a_b_12", 12),
    (fn.evidence_text, "# A cat sat. It ran.", "A cat sat.It ran."), (fn.strip_paragraph_id, "ID 4: text", "text"),
    (fn.is_english, "abc é", True), (fn.is_english, "ab中", False), (fn.count_words, " a b c ", 4), (fn.normalize_zh_answer, "Ａ，b c！", "ａbc"),
])
def test_functions(spark, make, value, want):
    assert one(spark, make, value) == want


def test_packing(spark):
    pack = lambda c: pack_sentences(c, 5)
    assert one(spark, pack, ["a b c.", "d e.", "f g h i."]) == ["a b c.d e.", "f g h i."]
    assert one(spark, pack, ["a b c d e f g h i."]) == ["a b c d e f g h i."] and one(spark, pack, []) == []


def test_evidence(spark):
    hit = lambda a, b: metrics.evidence_hit(fn.evidence_text(a), b)
    assert one(spark, hit, "# A cat sat. It ran.", "x A cat sat.It ran. y") == 1.0
    assert one(spark, hit, "# A cat sat. It ran.", "x A cat sat. It ran. y") == 0.0
    assert one(spark, hit, "", "anything") == 1.0


def test_f1(spark):
    assert abs(one(spark, metrics.qa_f1, "red the red car", "red car blue") - 2 / 3) < 1e-12
    assert one(spark, metrics.qa_f1, "a", "b") == 0.0
    assert one(spark, metrics.qa_f1_zh, "中文。", "中 文") == 1.0


def test_rouge_and_bleu(spark):
    assert metrics.rouge_l_f("the cat sat", "the cat sat") == 1.0 and metrics.rouge_l_f("", "x") == 0.0
    assert abs(metrics.rouge_l_f("police kill the gunman", "police killed the gunman") - 0.75) < 1e-12
    # The union of subsequences over candidate sentences (Lin 2004): w1 w2 + w1 w3 w5 cover four of five.
    assert abs(metrics.rouge_l_f("w1 w2 w6 w7 w8. w1 w3 w8 w9 w5.", "w1 w2 w3 w4 w5") - 2 * 0.4 * 0.8 / 1.2) < 1e-12
    for a, b in (("a b c d e", "a b c d f"), ("a b c d", "a b c d e f"), ("a", "b"), ("a b c", "a b c")):
        got = one(spark, lambda x, y: metrics.bleu(F.split(x, " "), F.split(y, " ")), a, b)
        assert abs(got - metrics.bleu_reference(a.split(), b.split())) < 1e-12


def test_template(spark):
    assert one(spark, lambda a, b: fn.fill_template("{{x}} {context} | {input}", context=a, input=b), "see {input}", "q") == "{x} see {input} | q"


def test_bleu_query_counts_four_grams(spark):
    from lodestack.plans import catalog

    d = "/root/testdata/sf0.01"
    pairs = {(r.conv_id, r.turn): (r.pred.split(), r.truth.split()) for r in catalog.pairs_of(spark, d).collect()}
    got = {(r.conv_id, r.turn): r.bleu for r in catalog.bleu(spark, d).collect()}
    assert got.keys() == pairs.keys() and all(abs(got[k] - metrics.bleu_reference(*pairs[k])) < 1e-8 for k in pairs)
    assert any(metrics.bleu_reference(*pairs[k], 2) > 0 == got[k] for k in pairs)


def test_strip_looks_at_the_ends_alone(spark):
    import random
    import re

    rng = random.Random(3)
    signs = [*fn.SPACES, "a", "é", "\U0001f600", "\x08", "\x0e", "\u200b", "\u180e", "\ufeff", "^", "-", "]"]
    some = ["", *fn.SPACES, None] + ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(2000)]
    space = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", fn.SPACE)
    assert [c for c in map(chr, range(0x110000)) if re.match(space, c)] == list(fn.SPACES)
    out = spark.createDataFrame(list(enumerate(some)), "i int, s string").select("i", fn.strip(F.col("s")).alias("s"))
    got = {r.i: r.s for r in out.collect()}
    assert all(got[i] == (None if s is None else re.sub(f"^{space}+|{space}+\\Z", "", s)) for i, s in enumerate(some))
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_fixed_chunks_make_sentences_once(spark):
    from lodestack.operators.chunking import fixed_chunks

    docs = spark.createDataFrame([(1, " One two. Three!  Four five six? Seven. "), (2, None), (3, " \u3000"), (3, " "), (4, "a b c d e f")], "doc_id int, text string")
    made = fixed_chunks(docs, 3)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("([.!?])") == 1
    got = sorted((r.doc_id, r.ordinal, r.text) for r in made.collect())
    assert got == [(1, 0, "One two.Three!"), (1, 1, "Four five six?"), (1, 2, "Seven."), (4, 0, "a b c d e f")]
