"""Readers and writers of the engine's tables. Schemas are fixed; lines that can't be read are left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import text as fn
from lodestack.runtime import materialize

QAS = "_id string, input string, answers array<string>, facts array<string>, evidences array<string>, all_classes array<string>"
PREDICTIONS = "index int, pred array<string>, answers array<string>, all_classes array<string>, context_length int, context string, input string, evidences array<string>, id string, merge_count int, facts array<string>, retrieved_ids array<string>"
SPLITS = "map<string, struct<splits: array<array<string>>>>"


def read_documents(spark: SparkSession, folder: str, suffix: str = ".txt", recursive: bool = True) -> DataFrame:
    """(dataset, doc_id, text): one row for each text file; the dataset is the file's folder."""
    files = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(F.element_at(F.split(path, "/"), -2).alias("dataset"), fn.file_key(path).alias("doc_id"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file, without lines that can't be read and without empty objects."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    names = [c for c in rows.columns if c != "_corrupt_record"]
    filled = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in names])
    return rows.where(F.col("_corrupt_record").isNull() & filled).select(*names)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line that is not empty with its position ``index`` in its file; a line that can't be read gives nulls.

    Files are read in splits. A line's position is the number of lines before it:
    those of earlier splits of its file, and those before it in its own.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    # Within a split, rows keep the file's order; its partition and the place in it are written down.
    placed = materialize(lines.withColumn("_at", F.monotonically_increasing_id()), "lines")
    splits = placed.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.join(F.broadcast(splits.select("_file", "_start", "_first", before.alias("_before"))), ["_file", "_start"])
    index = (F.col("_before") + F.col("_at") - F.col("_first")).cast("int").alias("index")
    return numbered.where("value <> ''").select(index, F.from_json("value", schema).alias("_r")).select("index", "_r.*")


def read_data(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (.jsonl) or one JSON array or object (.json), by the name's ending; other files are an error."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    if path.endswith(".json"):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    raise ValueError(f"neither .json nor .jsonl: {path}")


def of_datasets(rows: DataFrame, allowed: list[str] | None, column: str = "dataset") -> DataFrame:
    """The rows of the data sets allowed; all without a list. Folders of other data sets are not read."""
    return rows if allowed is None else rows.where(F.col(column).isin(list(allowed)))


def read_splits(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(doc_id, split_idx, text, level) of a chunk-result file, which is one JSON object or has one on each line; a key with spaces is found without them too."""
    whole = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", SPLITS)).alias("file", "r"))
    keyed = whole.select(fn.file_key(F.col("file")).alias("doc_id"), "r.splits")
    both = keyed.union(keyed.select(F.replace("doc_id", F.lit(" "), F.lit("")), "splits")).dropDuplicates(["doc_id"])
    parts = both.select("doc_id", F.posexplode("splits").alias("split_idx", "s"))
    return parts.select("doc_id", "split_idx", F.col("s")[0].alias("text"), F.col("s")[1].cast("int").alias("level"))


def questions_by_document(qas: DataFrame) -> DataFrame:
    """One row per document with its questions in order of ``index``."""
    items = F.array_sort(F.collect_list(F.struct("index", "input", "answers")))
    return qas.groupBy("_id").agg(items.alias("questions"))


def run_path(tokens: int, merge: int = 0, run: int = 0) -> str:
    """The name of a run's folder."""
    return f"tk{tokens}" + (f"_AM{merge}" if merge else "") + (f"_run{run}" if run else "")


def chunk_results(splits: DataFrame, suffix: str = ".txt") -> DataFrame:
    """One row per file (file, result): the result holds its splits, in order, as [text, level] pairs."""
    lists = splits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("split_idx", "text", "level"))).alias("s"))
    pairs = F.transform("s", lambda x: F.concat(F.lit("["), F.to_json(F.array(x["text"])).substr(F.lit(2), F.char_length(F.to_json(F.array(x["text"]))) - 2), F.lit(", "), x["level"].cast("string"), F.lit("]")))
    return lists.select(F.concat(F.col("doc_id").cast("string"), F.lit(suffix)).alias("file"), F.concat(F.lit('{"splits": ['), F.array_join(pairs, ", "), F.lit("]}")).alias("result"))


def write_chunk_results(splits: DataFrame, path: str, suffix: str = ".txt", mode: str = "errorifexists") -> None:
    """Writes text files of JSON objects, one line for each document, that map the file's name to its result."""
    name = F.to_json(F.array("file"))
    rows = chunk_results(splits, suffix).select(F.concat(F.lit("{"), name.substr(F.lit(2), F.char_length(name) - 2), F.lit(": "), "result", F.lit("}")).alias("value"))
    rows.write.mode(mode).text(path)


def write_training_set(samples: DataFrame, name: str, path: str, mode: str = "errorifexists") -> None:
    """Writes Parquet and puts the set into the register beside it: one row for each set, the last of a name stands."""
    spark = samples.sparkSession
    samples.write.mode(mode).parquet(f"{path}/{name}")
    columns = F.array(*map(F.lit, samples.columns))
    spark.range(1).select(F.lit(name).alias("name"), F.lit(f"{path}/{name}").alias("location"), columns.alias("columns"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{path}/_register_of_sets")


def training_sets(spark: SparkSession, path: str) -> DataFrame:
    """(name, location, columns) of the sets registered under a folder."""
    rows = spark.read.parquet(f"{path}/_register_of_sets")
    return rows.groupBy("name").agg(F.max_by(F.struct("location", "columns"), "at").alias("_r")).select("name", "_r.*")


def write_sorted(df: DataFrame, path: str, by: str = "index", mode: str = "errorifexists") -> None:
    """Writes JSON lines, with nulls, whose files follow each other in the order of ``by``."""
    df.orderBy(by).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] = (), mode: str = "errorifexists") -> None:
    """Writes Parquet, or JSON lines that keep nulls, split into folders by the columns ``by``."""
    writer = df.write.mode(mode)
    if kind == "json":
        writer = writer.option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).format(kind).save(path)
