import corpus_pipeline
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_join
from tests.llm.test_packing import library, verify  # noqa: F401
from tests.llm.test_quality import brute_kept
from tests.llm.test_suffix_dedup import brute as brute_spans


def test_stages_equal_brute_force(spark, library):  # noqa: F811
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    texts, hosts = ({r.doc_id: r[c] for r in docs.collect()} for c in ("text", "source"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test")
        got = {r.doc_id: r for r in out.collect()}
        assert out.columns == columns and len(got) == out.count() and all(r.n_chars == len(r.text) for r in got.values())
        now = {i: r.text for i, r in got.items()}
        rows = sorted(texts.items())
        if name == "quality rules":
            kept = brute_kept([(i, t, hosts[i]) for i, t in rows])
            assert now == {i: t for i, t in rows if kept[i]}
        elif name == "line dedup":
            assert now == {doc: text for doc, _, _, text in brute_lines(rows, 10, keep_first=True)}
        elif name == "n-gram Jaccard join":
            assert set(now) == {doc for doc, _, component in brute_join(rows, 5, 80) if doc == component}
        else:
            assert now == {doc: kept.decode("utf-8", "ignore") for doc, _, _, _, kept in brute_spans(rows)}
        texts, docs = now, out
    assert verify(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), texts, library) > 0.97


def test_empty_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_odd_rows(spark):
    words = lambda n, k=80: " ".join(f"w{n}x{j}" for j in range(k))
    passage = words("p", 40)
    rows = [
        (1, words(1), None, None, None), (1, words(1), None, None, None), (1, words("other"), "en", "s", 5), (None, words(3), "en", "s", 7), (4, None, "de", "s", None), (5, "", "de", "s", 0),
        (6, f"{words(6)} {passage}", "en", "s", 1), (7, f"{passage} {words(7)}", "en", "s", 1), (8, words(8, 30_000), "en", "s", 1), (9, words(8, 30_000) + " tail", "en", "s", 1), (10, words(1) + " more", "en", "t", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _text string, doc long"
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), "test")
    got = sorted(((r.doc_id, r.text[:6], r.n_chars == len(r.text)) for r in docs.collect()), key=str)
    # Of the copies under key 1 one stays, the other text under it too; 10 is near 1, 9 near 8; nulls and empty texts go.
    assert got == sorted([(1, "w1x0 w", True), (1, "wother", True), (None, "w3x0 w", True), (6, "w6x0 w", True), (7, " w7x0 ", True), (8, "w8x0 w", True)], key=str)
    ids = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()}
    assert ids == {None, 1, 6, 7, 8}
