import json

from pyspark.sql import functions as F

import __spark_entry__
from lodestack.operators.chunking import fixed_chunks
from lodestack.sources import corpora, readers
from lodestack.streaming.chunks import chunk_stream, write_chunks


def test_files(spark, tmp_path):
    docs = tmp_path / "docs" / "set1"
    docs.mkdir(parents=True)
    (docs / "a.b.txt").write_text("one\ntwo")
    (docs / "skip.md").write_text("no")
    rows = readers.read_documents(spark, str(tmp_path / "docs")).collect()
    assert [(r.dataset, r.doc_id, r.text) for r in rows] == [("set1", "a.b", "one\ntwo")]
    qas = tmp_path / "qas.jsonl"
    qas.write_text('{"_id": "d", "input": "q", "answers": ["x"]}\nbroken{\n{}\n{"_id": "e", "input": "r"}\n')
    assert sorted(r._id for r in readers.read_jsonl(spark, str(qas), readers.QAS).collect()) == ["d", "e"]
    lines = readers.read_lines(spark, str(qas), readers.QAS).orderBy("index").collect()
    assert [(r["index"], r._id) for r in lines] == [(0, "d"), (1, None), (2, None), (3, "e")]
    chunks = tmp_path / "splits.json"
    chunks.write_text(json.dumps({"x/my doc.txt": {"splits": [["A", 1], ["B", 2]]}}))
    got = readers.read_splits(spark, str(chunks)).orderBy("doc_id", "split_idx").collect()
    assert [(r.doc_id, r.text, r.level) for r in got] == [("my doc", "A", 1), ("my doc", "B", 2), ("mydoc", "A", 1), ("mydoc", "B", 2)]
    readers.write_table(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"), "json")
    assert [f.read_text() for f in (tmp_path / "out").glob("part*") if f.stat().st_size] == ['{"a":1,"b":null}\n']
    assert readers.run_path(4096, 1, 2) == "tk4096_AM1_run2"


def test_corpora(spark):
    paper = spark.sql("select 1 as doc_id, 'T' as title, 'abs' as abstract, array(named_struct('section_name', 'A ::: B', 'paragraphs', array('p'))) as full_text")
    assert corpora.paper_lines(paper).first().text == "# T\nabs\n## B\np"
    nested = json.dumps([{"section_title": "R", "paragraphs": ["p"], "subsections": [{"section_title": "S", "paragraphs": ["q"], "subsections": []}]}])
    flat = corpora.flatten_sections(spark.createDataFrame([(1, nested), (2, json.dumps([{"section_title": " ", "paragraphs": []}]))], "doc_id long, report string"))
    rows = corpora.report_lines(flat, least=1).collect()
    assert [(r.doc_id, r.text) for r in rows] == [(1, "# R\np\n## S\nq")]
    wiki = spark.createDataFrame([(1, "x\n========,1,Top\n========,2,Sub, more\ny")], "doc_id long, text string")
    assert corpora.wiki_lines(wiki, 1).first().text == "x\n# Top\n# Sub, more\ny"
    assert {(r.level, r.n) for r in corpora.heading_histogram(corpora.wiki_lines(wiki, 1)).collect()} == {(1, 2)}


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    write_chunks(chunk_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    names = ["doc_id", "ordinal", "chunk_id", "text"]
    stream = spark.read.parquet(str(tmp_path / "out")).select(*names)
    assert stream.exceptAll(fixed_chunks(docs).select(*names)).count() == 0 and stream.count() == fixed_chunks(docs).count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).where(F.col("recall").between(0, 1)).count() > 0
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 50
    assert ("pipeline" in queries) == any(name.startswith("op1_") for name in queries)


def test_sections_of_any_depth_are_unfolded(spark):
    nested = None
    for i in range(9, 0, -1):
        section = {"section_title": f"T{i}", "paragraphs": [f"p{i}"]}
        nested = json.dumps([section | ({"subsections": nested} if nested else {})])
    flat = corpora.flatten_sections(spark.createDataFrame([(1, nested), (2, "[]")], "doc_id long, report string"))
    assert sorted((len(r.path), r.title, r.paragraphs) for r in flat.collect()) == [(i, f"T{i}", [f"p{i}"]) for i in range(1, 10)]
    assert corpora.report_lines(flat, least=1).first().text.endswith("######### T9\np9")


def test_oracles_are_sql():
    import __spark_entry__

    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())
