import random

from pyspark.sql import functions as F

from lodestack.operators import chunking, context, deciders, evaluation, retrieval
from lodestack.operators.training import INSTRUCTION, seeded_variants, training_samples, training_variants

LEVELS = [1, 2, 3, 1, 2, 3, 3, 3, 3, 4, 4, 3, 4, 1, 2, 3, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4]
NODES = """(0,0,26) (1,0,3) (2,0,1) (2,1,3) (3,1,2) (3,2,3) (1,3,13) (2,3,4) (2,4,13) (3,4,5) (3,5,6) (3,6,7) (3,7,8) (3,8,11) (4,8,9) (4,9,10) (4,10,11) (3,11,13)
(4,11,12) (4,12,13) (1,13,26) (2,13,14) (2,14,26) (3,14,15) (3,15,26) (4,15,16) (4,16,17) (4,17,18) (4,18,19) (4,19,20) (4,20,21) (4,21,22) (4,22,23) (4,23,24) (4,24,25) (4,25,26)"""


def splits(spark, levels, doc=1):
    return spark.createDataFrame([(doc, i, chr(97 + i), level) for i, level in enumerate(levels)], "doc_id long, split_idx int, text string, level int")


def test_tree(spark):
    nodes = chunking.tree_nodes(splits(spark, LEVELS)).collect()
    assert sorted((n.depth, n.lft, n.rgt) for n in nodes) == sorted(eval(x) for x in NODES.split())
    by = {(n.depth, n.lft): n for n in nodes}
    for n in nodes:
        children = [c for c in nodes if c.depth == n.depth + 1 and c.parent_lft == n.lft]
        assert n.n_children == len(children)
        if children:
            edges = sorted((c.lft, c.rgt) for c in children)
            assert edges[0][0] == n.lft and edges[-1][1] == n.rgt and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))
        assert n.depth == 0 or by[n.depth - 1, n.parent_lft].rgt >= n.rgt
    assert len(chunking.tree_nodes(splits(spark, [3])).collect()) == 1


def test_tree_keeps_keys_and_long_documents(spark):
    rows = spark.createDataFrame([(None, 0, 1), (None, 1, 2), (2**60 + 1, 0, 3), (2**60 + 1, 3, 1), (2**60 + 1, 5, 11)], "doc_id long, split_idx int, level int")
    got = {tuple(n) for n in chunking.tree_nodes(rows).collect()}
    assert got >= {(None, 0, 0, 2, None, 0), (2**60 + 1, 0, 0, 3, None, 2), (2**60 + 1, 1, 0, 1, 0, 0), (2**60 + 1, 1, 1, 3, 0, 1)} and sum(n[0] is None for n in got) == 1
    # Intervals of a depth were paired with all intervals above them: 10,000 times 10,000 for this document.
    long = chunking.tree_nodes(spark.range(20_000).selectExpr("1L as doc_id", "cast(id as int) as split_idx", "cast(1 + id % 2 as int) as level"))
    assert "Join" not in long._jdf.queryExecution().toString()
    assert long.count() == 1 + 10_000 + 20_000


def test_merge_over_chunks():
    run = lambda levels, size: [(b - a, level) for a, b, level in chunking.merge_over_chunks(levels, [1] * len(levels), size)]
    assert run([1, 2, 3, 2], 10) == [(4, 1)]
    assert run([1, 2, 3, 3, 2], 3) == [(1, 1), (3, 2), (1, 2)]
    assert run(LEVELS, 100) == [(3, 1), (10, 1), (13, 1)]
    assert run(LEVELS, 4) == [(3, 1), (1, 1), (1, 2), (1, 3), (1, 3), (1, 3), (3, 3), (2, 3), (1, 1), (1, 2), (1, 3)] + [(1, 4)] * 10


def test_merge_clamp_and_points(spark):
    merged = chunking.merge_splits(splits(spark, [1, 2, 3, 3, 2]), 3).orderBy("split_idx").collect()
    assert [(r.text, r.level) for r in merged] == [("a", 1), ("bcd", 2), ("e", 2)]
    clamped = chunking.clamp_levels(splits(spark, [1, 3, 2, 4]), 2).orderBy("split_idx").collect()
    assert [(r.text, r.level) for r in clamped] == [("ab", 1), ("cd", 2)]
    assert chunking.clamp_levels(splits(spark, [3, 3]), 2).count() == 1
    lines = spark.createDataFrame([(1, i, f"L{i}") for i in range(5)], "doc_id long, pos int, text string")
    points = spark.createDataFrame([(1, 1, 0), (1, 1, 3), (1, 2, 1), (1, 2, 3)], "doc_id long, level int, p int")
    found = chunking.points_to_splits(points, lines).orderBy("split_idx").collect()
    assert [(r.text, r.level) for r in found] == [("L0", 1), ("L1L2", 2), ("L3L4", 2)]


def test_answers_and_clips(spark):
    reply = "0, Level One, True\n5, Level One, False\n4, Level One, True\n6, Level One, True\n9, Level Zero, True"
    rows = chunking.parse_answers(spark.createDataFrame([(1, reply)], "k long, a string"), "k", "a").orderBy("pos").collect()
    assert [r.p for r in rows] == [0, 5, 6] and deciders.parse_reply(reply)[0] == [0, 5, 6]
    one = spark.range(1)
    ints = lambda *v: F.array(*map(F.lit, v)).cast("array<int>")
    assert [tuple(x) for x in one.select(chunking.points_to_clips(ints(3, 5, 9), F.lit(3), F.lit(9))).first()[0]] == [(3, 5), (5, 9)]
    for points, want in (((), True), ((3, 5), True), ((2, 5), False), ((3, 3), False), ((3, 99), False), ((99,), True)):
        assert one.select(chunking.points_valid(ints(*points), F.lit(3), F.lit(9))).first()[0] is want
        assert deciders.points_valid(list(points), 3, 9) is want
    assert one.select(chunking.rebase_points(ints(1, 4, 6), F.lit(4), F.lit(10))).first()[0] == [10, 12]
    assert one.select(chunking.clip_points(ints(1, 4, 6), F.lit(5))).first()[0] == [1, 4]


def test_shards(spark):
    for n, want in ((10, [3, 3, 4]), (2, [0, 0, 2])):
        got = spark.range(n).select(retrieval.shard_ids(F.col("id"), F.lit(n), 3).alias("s")).collect()
        assert [sum(r.s == s for r in got) for s in range(3)] == want


def test_context_budget(spark):
    rows = [(1, r, f"d_{c}", f"{c} x y z") for r, c in ((0, 0), (1, 0), (2, 2), (3, 1))]
    got = context.budget_context(spark.createDataFrame(rows, "qid long, rank int, chunk_id string, text string"), 7).first()
    assert got.context.split() == "0 x y z 2 x y".split() and got.n_chunks == 2


def small_tree(n=3):
    leaves = {("d", i): f"w{i} abcdefg" for i in range(n)}
    nodes = [context.Node("d", 0, n, None, n)] + [context.Node("d", i, i + 1, 0, 1) for i in range(n)] + [context.Node("d", i, i + 1, i + 1, 0) for i in range(n)]
    return leaves, nodes, {("d", i): n + 1 + i for i in range(n)}


def test_auto_merge():
    leaves, nodes, own = small_tree()
    count = lambda t: len(t.split())
    got = context.auto_merge([("d", 0), ("d", 1)], leaves, nodes, own, 100, count)
    assert got.merge_count == 1 and got.context == "\n".join(leaves.values())
    alone = context.auto_merge([("d", 1)], leaves, nodes, own, 100, count)
    assert alone.merge_count == 0 and alone.context == leaves["d", 1]
    rng = random.Random(0)
    for _ in range(100):
        leaves, nodes, own = small_tree(8)
        ranked = [("d", rng.randrange(8)) for _ in range(6)]
        got = context.auto_merge(ranked, leaves, nodes, own, rng.randint(3, 40), count)
        spans = sorted((nodes[k].lft, nodes[k].rgt) for k in got.kept)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_dataset_score(spark):
    rows = [("q", 0, 0, 1.0), ("q", 1, 0, 0.5)]
    df = spark.createDataFrame(rows, "item string, sample int, answer_idx int, s double").withColumn("g", F.lit(1))
    assert evaluation.dataset_scores(df, ["g"], "item", F.col("s")).first().score == 75.0


def test_facts(spark):
    reply = 'x</think>{"classifications": [{"statement": "a", "attributed": 1}, {"statement": "b", "attributed": 2}]}'
    row = spark.createDataFrame([(reply, ["", " ", None, "f"])], "r string, f array<string>").select(evaluation.valid_classifications(F.col("r")).alias("c"), evaluation.valid_facts(F.col("f")).alias("f"), deciders.covered_facts(F.array(F.lit("Red car")), F.lit("a red, car!")).alias("j")).first()
    assert [x.statement for x in row.c] == ["a"] and row.f == ["f"] and row.j[0].attributed == 1


def test_windows_move_on_and_residuals():
    lines = ["# head"] + [f"sentence number {i} of the text" for i in range(30)] + ["# next"] + ["x " * 500] * 2
    points, errors = deciders.iterate_windows(lines, deciders.heading_model(), 60)
    assert points[0][0] == 0 and 31 in points[0] and not errors
    points, errors = deciders.iterate_windows(lines, lambda _: "nonsense", 60)
    assert errors > 3 and points[0][0] == 0
    assert chunking.residual_lines(["a"] * 9, [[2], [4, 6]], 9, 100, 1) == [] and chunking.residual_lines(list("abcdefghi"), [[2], [4, 6]], 9, 100, 2) == list("cdefghi")
    assert deciders.cut_paragraphs([f"p{i} word word" for i in range(20)], deciders.shortest_paragraph(), 10)[-1] == 20


def test_splits_of_a_node_are_found_without_a_join(spark):
    chunks = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 2, 2)], "doc_id long, split int, ordinal int")
    tree = spark.createDataFrame([(1, 0, 0, 3, None, 2), (1, 1, 0, 1, 0, 0), (1, 1, 1, 2, 0, 0), (1, 1, 2, 3, 0, 0)], "doc_id long, depth int, lft int, rgt int, parent_lft int, n_children int")
    found = chunking.leaf_nodes(tree, chunks)
    assert {(r.depth, r.lft, r.lft_leaf, r.rgt_leaf) for r in found.collect()} == {(0, 0, 0, 3), (1, 0, 0, 2), (1, 2, 2, 3)}
    assert "Join" not in found._jdf.queryExecution().toString()


def test_pieces_hold_few_documents():
    import pandas as pd

    parts = list(deciders.pieces([pd.DataFrame({"x": range(600)}), pd.DataFrame({"x": []}), pd.DataFrame({"x": [600]})]))
    assert [len(p) for p in parts] == [256, 256, 88, 1] and [x for p in parts for x in p["x"]] == list(range(601))


def test_searches_agree(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("chunk"), F.lit(1).alias("doc_id"), F.col("embedding").alias("vec"))
    queries = rows.where("chunk % 50 = 0").withColumnRenamed("chunk", "qid")
    exact = {(r.qid, r.rank): r.chunk for r in retrieval.search_local(queries, rows, 5).collect()}
    assert {(r.qid, r.rank): r.chunk for r in retrieval.search_global(queries, rows, 5, block=3).collect()} == exact
    near = {(r.qid, r.chunk) for r in retrieval.search_approximate(queries, rows, 5).collect()}
    assert sum((q, c) in near for (q, _), c in exact.items()) >= 0.9 * len(exact)


def test_approximate_search_lays_out_no_pairs(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("vec"))
    queries = rows.where("chunk % 20 = 0").withColumnRenamed("chunk", "qid")
    found = retrieval.search_approximate(queries, rows, 10, width=0.2, tables=2)
    assert "Join" not in found._jdf.queryExecution().toString()
    hashed = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.2, numHashTables=2, seed=7).fit(rows.select(array_to_vector("vec").alias("v"))).transform(rows.withColumn("v", array_to_vector("vec"))).collect()
    want, some = set(), 0
    for q in (x for x in hashed if x.chunk % 20 == 0):
        near = [x for x in hashed if any(a == b for a, b in zip(q.h, x.h))]
        some += len(near) < len(hashed)
        want |= {(q.chunk, i + 1, x[1]) for i, x in enumerate(sorted((-sum(a * b for a, b in zip(q.vec, x.vec)), x.chunk) for x in near)[:10])}
    assert some and {(r.qid, r.rank, r.chunk) for r in found.collect()} == want


def test_global_search_takes_tiles(spark):
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(1)
    queries, passages = rng.standard_normal((3000, 8)), rng.standard_normal((9000, 8))
    passages[5000:6000] = passages[:1000]  # ties go by id
    tracemalloc.start()
    top = retrieval.Nearest(queries, np.ones(3000, bool), 5)
    top.add(np.arange(9000), passages, np.ones(9000, bool))
    assert tracemalloc.get_traced_memory()[1] < 100e6  # one product of all pairs takes 216 MB
    tracemalloc.stop()
    scores = np.zeros((3000, 9000))
    for i in range(8):
        scores += queries[:, i, None] * passages[:, i]
    assert (top.ids == np.argsort(-scores, axis=1, kind="stable")[:, :5]).all() and (top.scores == -np.sort(-scores, axis=1)[:, :5]).all()
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.5, 0.5]), (3, [1.0, 0.0])], "chunk long, vec array<float>")
    found = retrieval.search_global(rows.where("chunk < 2").withColumnRenamed("chunk", "qid"), rows, 4, block=1).orderBy("qid", "rank").collect()
    assert [(r.qid, r.chunk, r.score) for r in found] == [(0, 0, 1.0), (0, 3, 1.0), (0, 2, 0.5), (0, 1, None), (1, 0, None), (1, 1, None), (1, 2, None), (1, 3, None)]


def test_local_search_deals_out_large_scopes(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").cast("string").alias("chunk"), F.when(F.col("vec_id") % 9 > 0, F.col("vec_id") % 3).alias("doc_id"), F.col("embedding").alias("vec"))
    rows = rows.unionByName(spark.createDataFrame([("x", 1, None), ("y", 4, None)], "chunk string, doc_id long, vec array<float>"))
    queries = rows.where("try_cast(chunk as int) % 10 = 0 or vec is null").withColumnRenamed("chunk", "qid")
    pairs = queries.withColumnRenamed("vec", "q").join(rows, "doc_id").select("qid", "chunk", retrieval.dot(F.col("q"), F.col("vec")).alias("score")).collect()
    by: dict = {}
    for p in pairs:
        by.setdefault(p.qid, []).append((-p.score if p.score is not None else 2, p.chunk, p.score))
    want = {(q, i + 1, c, x) for q, found in by.items() for i, (_, c, x) in enumerate(sorted(found)[:6])}
    for most in (10, 32_768):
        found = retrieval.search_local(queries, rows, 6, most=most)
        assert {tuple(r) for r in found.collect()} == want
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()  # pairs were joined as rows before


def test_merge_results_checks(spark):
    import pytest

    a = spark.createDataFrame([(0, "x", "d"), (1, "y", "e")], "index int, input string, _id string")
    b = spark.createDataFrame([(0, "x", "d", ["d_0"])], "index int, input string, id string, retrieved_ids array<string>")
    with pytest.raises(Exception, match="rows differ"):
        retrieval.merge_results(a, b).collect()
    with pytest.raises(Exception, match="another document"):
        retrieval.merge_results(a.limit(1), b.withColumn("retrieved_ids", F.array(F.lit("z_1")))).collect()


def test_training_samples(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["# A", "one two three", "## B", "four five six", "# C", "x"])], "doc_id long, pos int, text string")
    got = training_samples(lines, window=100, least=3).collect()
    assert len(got) == 1 and got[0].output == "0, Level One, True\n2, Level Two, True" and got[0].n_lines == 4
    assert seeded_variants(training_samples(lines, least=3), [1, 2]).count() == 3


def test_training_samples_fill_one_window_across_segments(spark):
    texts = [t for i in range(10) for t in (f"# head {i}", f"one two three {i}", f"## part {i}", f"four five six {i}")]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, pos int, text string")
    whole = training_samples(lines, least=3).collect()
    assert len(whole) == 1 and whole[0].n_lines == 40
    assert whole[0].output.split("\n") == [f"{p}, Level {'Two' if p % 4 else 'One'}, True" for p in range(0, 40, 2)]

    window = 100
    cut = training_samples(lines, window=window, least=3).collect()
    assert len(cut) > 1
    plain = [t.lstrip("# ") for t in texts]
    seen, sizes = 0, []
    for r in cut:
        rows = [x.split(" @ ", 1) for x in r.input.split("\n")]
        assert [int(i) for i, _ in rows] == list(range(r.n_lines))
        points = [int(x.split(",")[0]) for x in r.output.split("\n")]
        new = next(i for i, (_, t) in enumerate(rows) if t == plain[seen])
        carried = [t for _, t in rows[:new]]
        assert points[0] == new and all(t in plain[max(0, seen - 8) : seen] for t in carried) and bool(carried) == bool(seen)
        assert [t for _, t in rows[new:]] == plain[seen : seen + r.n_lines - new]
        # The rest of a first-level segment goes where the window is full in it.
        seen = -(-(seen + r.n_lines - new) // 4) * 4
        sizes.append(len(INSTRUCTION.split()) + len(r.input.split()))
    assert seen == 40 and all(n >= window for n in sizes[:-1]) and sizes[-1] < window + 6


def test_training_samples_lose_no_segment_to_long_residual_lines(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(t for k in range(5) for t in (f"# head {k}", "w " * 200))], "doc_id long, pos int, text string")
    got = training_samples(lines, window=150).collect()
    assert [r.input.split("\n")[0] for r in got] == [*(f"0 @ head {k}" for k in range(5)), ""]


def test_training_variants_shuffle_and_cut_segments(spark):
    texts = [t for i in range(6) for t in (f"# head {i}", *(x for j in range(20) for x in (f"## part {i} {j}", *(f"line {i} {j} {k}" for k in range(30)))))]
    lines = spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(texts)], "doc_id long, pos int, text string")
    got = training_variants(lines, [1, 2], window=10**6).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, training_variants(lines.repartition(3), [1, 2], window=10**6).collect()))
    by = {(r.doc_id, r.type): [x.split(" @ ", 1)[1] for x in r.input.split("\n")] for r in got}
    plain = [t.lstrip("# ") for t in texts]
    assert len(by) == 10 and by[1, "original"] == by[2, "original"] == plain
    orders = []
    for d, seed in ((1, 1), (1, 2), (2, 1), (2, 2)):
        mixed, less = by[d, f"internal_shuffle_s{seed}"], by[d, f"augmented_s{seed}"]
        assert sorted(mixed) == sorted(plain)
        orders.append(tuple(x for x in mixed if x.startswith("head")))
        assert sum(x.startswith("head") for x in less) == 6
        for i in range(6):
            parts = [x for x in less if x.startswith(f"part {i} ")]
            assert 4 <= len(parts) <= 14 and all(14 <= sum(x.startswith(f"line {i} {p.split()[2]} ") for x in less) <= 24 for p in parts)
    assert len(set(orders)) > 1


def test_every_data_set_has_a_score(spark):
    from lodestack.functions import metrics
    from lodestack.plans import catalog

    qa = ["hotpotqa", "2wikimqa", "musique", "narrativeqa", "qasper", "multifieldqa_en", "qasper_all"]
    names = [*qa, "HiCBench", "OHRBench_sub", "GutenQA", "dureader", "multifieldqa_zh"]
    df = spark.createDataFrame([(n, "The cat sat", "a cat sat here") for n in names] + [("other", "a", "a")], "d string, p string, t string")
    got = {r.d: r.s for r in df.select("d", metrics.by_metric(metrics.metric_of(F.col("d")), F.col("p"), F.col("t")).alias("s")).collect()}
    assert got.pop("other") is None and set(got) == set(names) == set(metrics.METRIC_OF)
    rouge = metrics.rouge_l_f("The cat sat", "a cat sat here")
    assert all(abs(got[n] - 0.8) < 1e-12 for n in qa) and all(got[n] == rouge for n in ("HiCBench", "OHRBench_sub", "GutenQA"))
    assert got["dureader"] == metrics.rouge_l_f(" ".join("The cat sat"), " ".join("a cat sat here")) and 0 < got["multifieldqa_zh"] < 1
    rows = catalog.dataset_metrics(spark, "/root/testdata/sf0.001").collect()
    assert rows and {r.dataset for r in rows} <= set(names) and all(r.score is not None for r in rows)
    assert {r.dataset for r in catalog.dataset_metrics(spark, "/root/testdata/sf0.01").collect()} == set(names)


def test_retrieval_is_held_against_evidence_of_the_data_set(spark):
    rows = [(d, e, ["an answer"]) for d, e in (("HiCBench", ["# One. Two"]), ("GutenQA", ["# One. Two"]), ("OHRBench_sub", None), ("HiCBench", []), ("qasper_all", ["# One. Two"]), ("qasper", ["# One. Two"]))]
    df = spark.createDataFrame(rows, "d string, e array<string>, a array<string>")
    got = df.select(evaluation.retrieval_target(F.col("d"), F.col("e"), F.col("a")).alias("t"), evaluation.retrieval_recall(F.col("d"), F.col("e"), F.col("a"), F.lit("x One.Two y")).alias("r")).collect()
    assert [r.t for r in got] == [["One.Two"], ["One.Two"], ["an answer"], [], ["One.", "Two"], ["an answer"]]
    # Lengths are those before cleaning: "# One." has six of nine characters, and both sentences stand in the text.
    assert [r.r for r in got] == [1.0, 1.0, 0.0, 0.0, 1.0, 0.0]
    half = df.where("d = 'qasper_all'").select(evaluation.retrieval_recall(F.col("d"), F.col("e"), F.col("a"), F.lit("one")).alias("r")).first().r
    assert abs(half - 6 / 9) < 1e-12
    scores = {r.d: r.retrieval for r in evaluation.retrieval_scores(df.withColumn("x", F.lit("One.Two, an answer")), "d", "e", "a", "x").collect()}
    assert scores == {"HiCBench": 50.0, "GutenQA": 100.0, "OHRBench_sub": 100.0, "qasper_all": 100.0, "qasper": 100.0}


def test_interval_totals_in_one_pass(spark):
    rng = random.Random(5)
    rows = [(doc, i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 5))), rng.randint(1, 4)) for doc in ("a", "b", None) for i in range(12)]
    rows += [("long", i, "x yz", 1 + i % 2) for i in range(25_000)]
    table = spark.createDataFrame(rows, "doc_id string, split_idx int, text string, level int")
    nodes = chunking.tree_nodes(table)
    text = {(d, i): t for d, i, t, _ in rows}

    def brute(d, lft, rgt):
        own = [text[d, i] for i in range(lft, rgt)]
        return sum(map(len, own)), sum(len(t.split()) for t in own)

    inside = context.tree_totals(table)
    leaves = table.withColumnRenamed("split_idx", "ordinal")
    beside = context.interval_totals(leaves, nodes)
    assert beside.columns == inside.columns
    wide = [r for r in inside.where("doc_id is not null").collect() if r.doc_id != "long" or r.rgt - r.lft == 1 or r.lft == 0]
    assert len(wide) > 25_000 and all((r.chars, r.tokens) == brute(r.doc_id, r.lft, r.rgt) for r in wide)
    assert inside.where("doc_id is not null").exceptAll(beside).count() == 0 and beside.where("doc_id is not null").count() == inside.where("doc_id is not null").count()
    assert [(r.chars, r.tokens) for r in beside.where("doc_id is null").collect()] == [(0, 0)]
    for made in (inside, beside):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
    # Nodes of a document without leaves, or that reach beyond them, count what is there; other columns stay.
    odd = spark.createDataFrame([("a", 10, 99, "p", None), ("none", 0, 3, None, 7)], "doc_id string, lft int, rgt int, tag string, n int")
    got = {r.doc_id: r for r in context.interval_totals(leaves, odd).collect()}
    assert (got["a"].chars, got["a"].tokens, got["a"].tag, got["a"].n) == (*brute("a", 10, 12), "p", None)
    assert (got["none"].chars, got["none"].tokens, got["none"].tag, got["none"].n) == (0, 0, None, 7)


def test_interval_totals_query_leaves_out_documents_without_a_key(spark, tmp_path):
    from lodestack.plans.catalog import interval_totals

    spark.createDataFrame([(1, "a b\nc"), (None, "d\ne"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in interval_totals(spark, str(tmp_path)).collect()) == [(1, 0, 0, 2, 6, 3), (1, 1, 0, 2, 6, 3), (1, 2, 0, 1, 4, 2), (1, 2, 1, 2, 2, 1)]


def test_training_samples_keep_texts_out_of_python(spark, monkeypatch):
    from lodestack.operators import training

    texts = ["", "  # A b", "one  two\tthree", "## B", "four five # six", " #", "#### C d", "seven"]
    lines = spark.createDataFrame([(d, i, t) for d in (1, None) for i, t in enumerate(texts * (3 if d else 1))], "doc_id long, pos int, text string")
    made = training_samples(lines, window=30, least=3)
    plan = made._jdf.queryExecution().executedPlan().toString()
    call = next(x for x in plan.split("\n") if "ArrowEvalPython" in x)
    assert "MapInPandas" not in plan and ".text" not in call and all(f".{name}" in call for name in ("level", "n", "n_shown"))
    want = sorted(map(tuple, made.collect()), key=str)
    assert len(want) > 3 and {r[0] for r in want} == {1, None}
    whole = [r for r in training_samples(lines, window=400, least=3).collect() if r.doc_id is None]
    assert [r.input for r in whole] == ["0 @ A b\n1 @ one  two\tthree\n2 @ B\n3 @ four five # six\n4 @ \n5 @ C d\n6 @ seven"]
    assert [r.output for r in whole] == ["0, Level One, True\n2, Level Two, True\n4, Level One, True\n5, Level Four, True"]
    monkeypatch.setattr(training, "STEP", 1)
    assert sorted(map(tuple, training_samples(lines, window=30, least=3).collect()), key=str) == want
