import json
import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as fn
from lodestack.operators import chunking, evaluation, joins, prompts, retrieval, training
from lodestack.plans import runs
from lodestack.sources import readers, settings


def normal(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fn.normalize_answer(F.col("t")).alias("n")).collect()
    return {r.i: r.n for r in rows}


def test_contained_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["cat", "cats", "dog", "a", "the", "x1", "sun", "sunny", "rain,", "Rain", "ü"]
    text = lambda k: " ".join(rng.choices(words, k=k))
    docs = [text(rng.randint(0, 40)) for _ in range(60)] + [None, "", "cats sunny"]
    items = [text(rng.randint(0, 7)) for _ in range(60)] + [docs[5][3:60], docs[9][2:40], docs[9], "", "zzz yyy xxx www vvv", None]
    got = joins.contained(spark.createDataFrame(list(enumerate(items)), "item_id int, text string"), spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string"))
    e, t = normal(spark, items), normal(spark, docs)
    want = sorted((i, j) for i in e for j in t if e[i] is not None and t[j] is not None and e[i] in t[j])
    assert sorted((r.item_id, r.doc_id) for r in got.collect()) == want and len(want) > 100
    many = spark.range(1100).select(F.col("id").alias("item_id"), F.lit("one").alias("text"))
    with pytest.raises(ValueError):
        joins.contained(many, spark.createDataFrame([(1, "one")], "doc_id int, text string"))


def test_questions_chunks_and_documents(spark):
    qas = spark.createDataFrame([("d1", 0), ("d1", 1), ("d2", 2), ("d9", 3), (None, 4)], "_id string, index int")
    chunks = spark.createDataFrame([("d1", 0, "a"), ("d1", 1, "b"), ("d_2", 0, "c"), ("d2", 0, "e")], "doc_id string, ordinal int, text string")
    assert sorted((r._id, r["index"], r.text) for r in joins.questions_with(qas, chunks).collect()) == [("d1", 0, "a"), ("d1", 0, "b"), ("d1", 1, "a"), ("d1", 1, "b"), ("d2", 2, "e")]
    assert {(r._id, r.n) for r in joins.unmatched(qas, chunks).collect()} == {("d9", 1), (None, 1)}
    found = spark.createDataFrame([(7, ["d_2_0", "d1_1", "d1_5", "junk"])], "index int, retrieved_ids array<string>")
    assert [(r["index"], r["rank"], r.text) for r in joins.retrieved_chunks(found, chunks).orderBy("rank").collect()] == [(7, 1, "c"), (7, 2, "b")]
    leaves = spark.createDataFrame([(1, [1, 2]), (2, [1, 1])], "k int, l array<int>")
    assert {(r.k, r.n, r.unique) for r in joins.unique_leaves(leaves, "l", "k").collect()} == {(1, 2, True), (2, 2, False)}


def test_settings_and_prompts(spark, tmp_path):
    (tmp_path / "prompt.json").write_text(json.dumps({"a": "C: {context}\nQ: {input}", "b": "{input}{other}"}))
    (tmp_path / "length.json").write_text(json.dumps({"m": 6}))
    stored = settings.read_settings(spark, str(tmp_path / "prompt.json"), "prompt")
    lengths = settings.read_settings(spark, str(tmp_path / "length.json"), "max_length", "int")
    rows = spark.createDataFrame([(1, "a", "m", "one two {input} three", "why $1 \\ so"), (2, "b", "m", None, "x")], "i int, dataset string, model string, context string, input string")
    made = prompts.prompts(settings.with_settings(settings.with_settings(rows, stored, "dataset"), lengths, "model"), "llama").orderBy("i").collect()
    assert made[0].prompt == "[INST]C: one two$1 \\ so[/INST]" and made[1].prompt == "[INST]x{other}[/INST]" and made[1].context_length == 1
    with pytest.raises(Exception, match="no settings for z"):
        settings.with_settings(rows.withColumn("dataset", F.lit("z")), stored, "dataset").collect()
    assert settings.with_settings(rows.withColumn("dataset", F.lit("z")), stored, "dataset", default={"prompt": "p"}).first().prompt == "p"
    with pytest.raises(ValueError):
        settings.with_settings(rows, stored.union(stored), "dataset")


def test_contexts_by_mode(spark):
    qas = spark.createDataFrame([(0, "d"), (1, "e"), (2, "f")], "index int, _id string")
    docs = spark.createDataFrame([("d", "whole d"), ("e", "whole e")], "doc_id string, text string")
    ranked = spark.createDataFrame([(0, 1, "d_0", "one two"), (0, 2, "d_1", "three four"), (1, 1, "e_0", "five")], "index int, rank int, chunk_id string, text string")
    of = lambda **more: [r.context for r in prompts.contexts(qas, **more).orderBy("index").collect()]
    assert of(budget=0) == ["", "", ""] and of(budget=-1, docs=docs) == ["whole d", "whole e", None]
    assert of(budget=3, ranked=ranked) == ["one two three", "five", ""]


def test_counters_by_name(spark):
    prompts.register_counter("letters_a", prompts.library_counter(lambda: lambda texts: [t.count("a") for t in texts]))
    row = spark.createDataFrame([("a banana b",)], "t string").select(*[prompts.counter(n)(F.col("t")).alias(n) for n in ("words", "spaced", "characters", "letters_a")]).first()
    assert tuple(row) == (3, 3, 10, 4)
    with pytest.raises(ValueError):
        prompts.counter("none")


def test_readers_and_writers(spark, tmp_path):
    lines = [json.dumps({"_id": f"d{i}", "input": "x" * (i % 7)}) if i % 5 else ("" if i % 2 else "broken{") for i in range(400)]
    (tmp_path / "qas.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = {r["index"]: r._id for r in readers.read_lines(spark, str(tmp_path / "qas.jsonl"), readers.QAS).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: (f"d{i}" if i % 5 else None) for i, line in enumerate(lines) if line}
    assert readers.read_data(spark, str(tmp_path / "qas.jsonl"), "_id string").count() == 320
    (tmp_path / "all.json").write_text('[{"_id": "a"},\n {"_id": "b"}]')
    assert sorted(r._id for r in readers.read_data(spark, str(tmp_path / "all.json"), "_id string").collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        readers.read_data(spark, "x.csv", "_id string")
    splits = spark.createDataFrame([("d", 0, 'say "A"\n', 1), ("d", 1, "é", 2), ("e", 0, "", 1)], "doc_id string, split_idx int, text string, level int")
    readers.write_chunk_results(splits, str(tmp_path / "results"))
    back = readers.read_splits(spark, str(tmp_path / "results"), lines=True)
    assert sorted(map(tuple, back.select("doc_id", "split_idx", "text", "level").collect())) == sorted(map(tuple, splits.collect()))
    for n in (1, 2):
        readers.write_training_set(spark.createDataFrame([(n,)], "a int"), "one", str(tmp_path / "sets"), "overwrite")
    readers.write_training_set(spark.createDataFrame([(3, 4)], "a int, b int"), "two", str(tmp_path / "sets"))
    assert {r.name: r.columns for r in readers.training_sets(spark, str(tmp_path / "sets")).collect()} == {"one": ["a"], "two": ["a", "b"]}


def test_chinese_lines(spark):
    rows = {"第12345678条今天天气很。好的吗我们走": None, "短": None, "": None, "一二三四五六七八九十": None, "。。。。。。。。": None}

    def fold(line):
        out, at = [], 0
        for i in range(1, len(line) - 1):
            if line[i] != "。" and not line[i - 1].isdigit() and not line[i + 1].isdigit() and len(line[at : i + 1].strip()) > 5:
                out.append(line[at : i + 1].strip())
                at = i + 1
        return out + ([line[at:]] if at < len(line) else [])

    got = spark.createDataFrame([(x,) for x in rows], "t string").select("t", fn.sentences_zh_line(F.col("t"), "literal").alias("s")).collect()
    assert {r.t: r.s for r in got} == {t: fold(t) for t in rows}


def test_numbered_sentences(spark):
    rows = spark.createDataFrame([(1, 0, "## Title here. And one more sentence"), (1, 1, "Plain words stand here. Short. Next sentence is long")], "doc_id int, pos int, text string")
    got = [r.text for r in fn.numbered_sentences(rows, start=5, mark="# ").orderBy("i").collect()]
    assert got == ["5 @ # Title here.\n", "6 @ And one more sentence\n", "7 @ Plain words stand here.\n", "8 @ Short. Next sentence is long\n"]


def test_summaries(spark):
    rows = spark.createDataFrame([("x", 1, 2.0, 3), ("x", 1, 2.0, 3), ("x", 2, 4.0, 5)], "g string, doc_id int, time_cost double, n_splits int")
    assert tuple(evaluation.chunk_statistics(rows, ["g"]).first()) == ("x", 3.0, 4.0, 2)
    scores = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", None)], "d string, score double")
    assert tuple(evaluation.macro_average(scores).first()) == (15.0, 2)


def test_loading_and_ordinals(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0])], "chunk long, vec array<float>")
    assert retrieval.bulk_load(a, a.withColumn("chunk", F.lit(2).cast("long"))).count() == 2
    with pytest.raises(Exception, match="not of width 2"):
        retrieval.bulk_load(a, spark.createDataFrame([(3, [1.0])], "chunk long, vec array<float>")).collect()
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    assert [r.ordinal for r in retrieval.ordinals(rows, "k").orderBy("k").collect()] == list(range(1000))


def test_merging_files(spark):
    original = spark.createDataFrame([(1, "q1", "d"), (0, "q0", "e")], "index int, input string, _id string")
    ctx = "index int, question string, id string, ctxs array<struct<id: string, title: string, score: string>>"
    parts = [spark.createDataFrame([(i, f"q{i}", d, [(f"{d}_0", "", "1")])], ctx) for i, d in ((0, "e"), (1, "d"))]
    assert [(r["index"], r.retrieved_ids) for r in retrieval.merge_files(original, *parts).collect()] == [(0, ["e_0"]), (1, ["d_0"])]
    with pytest.raises(Exception, match="found twice"):
        retrieval.merge_files(original, *parts, parts[0]).collect()
    both = retrieval.by_scope(parts[0], parts[1]).collect()
    assert {(r["index"], r.scope) for r in both} == {(0, "local"), (1, "global")}
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    have = retrieval.cached(rows, spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), "k", "v").collect()
    assert {(r.k, r.v, r.todo) for r in have} == {(1, "x", False), (2, None, False), (3, None, True)}


def test_chinese_data_sets_have_their_own_sentences(spark):
    docs = spark.createDataFrame([(1, "一二三。四五六。七", "dureader"), (2, "一二三。四五六。七", "qasper"), (1, "一二三。四五六。七", "dureader")], "doc_id int, text string, dataset string")
    got = sorted((r.doc_id, r.text) for r in chunking.fixed_chunks(docs, 3, dataset="dataset").collect())
    assert got == [(1, "一二三。"), (1, "七"), (1, "四五六。"), (2, "一二三。四五六。七")]


def test_samples_and_sorted_files(spark, tmp_path):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    some = training.sampled(rows, 0.25, seed=3)
    assert 850 < some.count() < 1150 and some.exceptAll(training.sampled(rows.repartition(7), 0.25, seed=3)).count() == 0
    readers.write_sorted(rows.withColumnRenamed("doc_id", "index").withColumn("x", F.lit(None).cast("string")).repartition(3), str(tmp_path / "out"))
    lines = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part*"))).splitlines()
    assert [json.loads(x) for x in lines] == [{"index": i, "x": None} for i in range(4000)]


def test_semantic_chunks(spark):
    docs = spark.createDataFrame([(1, "Cats purr. Cats sleep. Cats eat. Rain falls. Rain stops. Rain again."), (2, "One."), (3, "")], "doc_id int, text string")
    near = lambda rows: rows.withColumn("vec", F.when(F.col("group").contains("Cats"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    got = chunking.semantic_chunks(docs, near, buffer=0).orderBy("doc_id", "split_idx").collect()
    assert [(r.doc_id, r.split_idx, r.text, r.level) for r in got] == [(1, 0, "Cats purr. Cats sleep. Cats eat.", 1), (1, 1, "Rain falls. Rain stops. Rain again.", 1), (2, 0, "One.", 1)]


def test_a_run(spark):
    docs = spark.createDataFrame([("x", "d1", "Alpha beta gamma. Delta epsilon."), ("y", "d2", "Other words.")], "dataset string, doc_id string, text string")
    qas = spark.createDataFrame([("x", 0, "d1", "delta epsilon?"), ("y", 1, "d2", "other"), ("x", 2, "none", "q")], "dataset string, index int, _id string, input string")
    got = {r["index"]: r.retrieved_ids for r in runs.run_all(runs.Run(chunk_size=3, datasets=("x",)), docs, qas).collect()}
    assert set(got) == {0, 2} and got[2] == [] and sorted(got[0]) == ["d1_0", "d1_1"]
    splits = spark.createDataFrame([("d1", 0, "Alpha beta gamma.", 1), ("d1", 1, "Delta epsilon.", 4)], "doc_id string, split_idx int, text string, level int")
    chunks = runs.index(runs.Run("HC", 10, max_level=2, merge_over_chunks=True), docs, splits).collect()
    assert [(r.dataset, r.chunk_id, r.text) for r in chunks] == [("x", "d1_0", "Alpha beta gamma.Delta epsilon.")]
    assert runs.Run("HC", 200).name == "HC200_L10"
    with pytest.raises(ValueError):
        runs.index(runs.Run("Q"), docs)


def test_semantic_chunks_make_vectors_once(spark):
    from lodestack.operators import retrieval

    docs = spark.createDataFrame([(1, "One two. Three four. Five six."), (None, "A b. C d.")], "doc_id long, text string")
    got = chunking.semantic_chunks(docs, lambda rows: retrieval.embed(rows, "group"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1
    assert {r.doc_id for r in got.collect()} == {1}
    words = [f"w{i}" for i in range(70_000)]
    encode = retrieval.hash_encoder(8)
    assert (encode([" ".join(words), "w1 w1 w2", "", " "]) == encode([" ".join(words), "w1 w1 w2", "", " "])).all()
