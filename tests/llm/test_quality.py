import re
from collections import Counter

from lodestack.llm.quality import LineRule, kept_documents, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _text long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def brute_kept(rows):
    """Whether each (doc_id, text, host), with keys of their own, is kept."""
    key = lambda line: " ".join(WORD.findall(line)).lower()
    texts, held, first = {}, {}, {}
    for doc, text, host in rows:
        texts.setdefault(host or "", set()).add(text or "")
        for line in (text or "").split("\n"):
            if WORD.search(line):
                at = (host or "", key(line))
                held.setdefault(at, set()).add(text)
                first[at] = min(first.get(at, doc), doc)
    common = {at for at, own in held.items() if len(own) >= 10 and len(own) >= 0.05 * len(texts[at[0]])}
    out = {}
    for doc, text, host in rows:
        n, *_, failed = brute(text)
        lost = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if (at := (host or "", key(x))) in common and first[at] != doc)
        out[doc] = not failed and n - lost >= 0.3 * n
    return out


def measured(spark, texts):
    rows = [(i, t, None, None, None, "x", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for _, r in sorted(got.items())]


def test_measures_equal_brute_force(spark):
    texts = [None, "", " \n\t\n", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\nx\n x\n\nx", "a b ä|<#>%\x1cé", "a b c d " * 40, "\x0b\x0ca\r\nb\r\n", " ".join(map(str, range(30_000))), "u v w x\n" * 5000]
    assert measured(spark, texts) == [brute(t) for t in texts]


def test_common_lines_deplete_documents(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    menu = " ".join(f"menu{j}" for j in range(55))
    rows = [(i, f"{body(i)}\n{menu if i < 12 else 'end'}", None, "h", None, "k", 0) for i in range(20)]
    rows += [(100 + i, f"{menu.upper()}  \nonly {i}", None, "h", None, "k", 0) for i in range(4)]
    rows += [(200, f"{menu}\nelsewhere", None, None, None, "k", 0)]
    df = spark.createDataFrame(rows + rows[-2:], SCHEMA)
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    assert all(got[i].kept for i in range(20)) and not any(got[100 + i].kept for i in range(4)) and got[200].kept
    assert got[0].words_left == 115 and got[1].words_left == 60 and got[100].words_left == 2
    assert {r.doc_id for r in kept_documents(df).collect()} == {*range(20), 200}
    assert all(r.kept for r in quality_rules(df, LineRule(min_docs=50)).collect())


def test_copies_of_one_text_are_not_common_lines(spark):
    text = "\n".join(" ".join(f"l{k}w{j}" for j in range(10)) for k in range(8))
    df = spark.createDataFrame([(i, text, None, "h", None, "k", 0) for i in range(40)], SCHEMA)
    assert all(r.kept for r in quality_rules(df).collect())


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_kept_documents_tell_rows_without_or_with_repeated_keys_apart(spark):
    text = lambda n: " ".join(f"w{n}x{j}" for j in range(60))
    rows = [(None, text(0)), (None, "short"), (1, text(1)), (2, text(2)), (2, "short too")]
    df = spark.createDataFrame([(i, t, None, "h", None, "k", 0) for i, t in rows], SCHEMA)
    assert {(r.doc_id, r.text) for r in kept_documents(df).collect()} == {(None, text(0)), (1, text(1)), (2, text(2))}


def test_verdicts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_kept([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert {r.doc_id: r.kept for r in quality_rules(docs).collect()} == want
    assert {r.doc_id for r in kept_documents(docs).collect()} == {i for i, kept in want.items() if kept}


def test_lines_of_rows_without_a_key(spark):
    menu = " ".join(f"menu{j}" for j in range(60))
    rows = [(i, f"{menu}\nown {i}") for i in range(11)] + [(None, f"{menu}\nnone")]
    got = quality_rules(spark.createDataFrame([(i, t, None, "h", None, "k", 0) for i, t in rows], SCHEMA)).collect()
    assert {(r.doc_id, r.words_left) for r in got} == {(0, 62), *((i, 2) for i in range(1, 11)), (None, 1)}


def test_texts_are_split_a_few_times_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (quality_rules(docs), kept_documents(docs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") <= 9 and all("split(" not in x for x in plan.splitlines() if "Filter" in x)
