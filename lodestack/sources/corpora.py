"""Raw training corpora as heading-marked lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 50_000


def paper_lines(papers: DataFrame) -> DataFrame:
    """(doc_id, text) of papers (doc_id, title, abstract, full_text): section paths end in headings of their depth."""
    path = lambda s: F.split(s["section_name"], " ?::: ?")
    heading = lambda s: F.concat(F.repeat(F.lit("#"), F.size(path(s))), F.lit(" "), F.element_at(path(s), -1))
    section = F.transform("full_text", lambda s: F.concat(F.array(heading(s)), s["paragraphs"]))
    lines = F.concat(F.array(F.concat(F.lit("# "), F.col("title")), F.col("abstract")), F.flatten(section))
    return papers.select("doc_id", F.array_join(lines, "\n").alias("text"))


def report_lines(sections: DataFrame, least: int = LONG) -> DataFrame:
    """(doc_id, text) of sections (doc_id, path array<int>, title, paragraphs) in order of their paths.

    A document with a section of blank title and no paragraphs goes, and so does
    one of fewer than ``least`` characters.
    """
    blank = (F.trim(F.coalesce("title", F.lit(""))) == "") & (F.size(F.coalesce("paragraphs", F.array().cast("array<string>"))) == 0)
    lines = F.concat(F.array(F.concat(F.repeat(F.lit("#"), F.size("path")), F.lit(" "), F.col("title"))), F.col("paragraphs"))
    whole = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("path", lines.alias("lines")))).alias("s"), F.bool_or(blank).alias("bad"))
    text = F.array_join(F.flatten(F.transform("s", lambda x: x["lines"])), "\n")
    return whole.where(~F.col("bad")).select("doc_id", text.alias("text")).where(F.char_length("text") >= least)


def flatten_sections(reports: DataFrame) -> DataFrame:
    """(doc_id, path, title, paragraphs) of nested JSON sections: ``report`` holds a JSON array of sections.

    Sections nest by JSON text, which is unfolded until no level has rows; each level is one small query.
    """
    schema = "array<struct<section_title: string, paragraphs: array<string>, subsections: string>>"
    level = reports.select("doc_id", F.array().cast("array<int>").alias("path"), F.col("report").alias("json"))
    out = None
    while out is None or not level.isEmpty():
        found = level.select("doc_id", "path", F.posexplode(F.from_json("json", schema)).alias("i", "s"))
        part = found.select("doc_id", F.concat("path", F.array("i")).alias("path"), F.col("s.section_title").alias("title"), F.coalesce("s.paragraphs", F.array().cast("array<string>")).alias("paragraphs"), F.col("s.subsections").alias("json"))
        out = part.drop("json") if out is None else out.unionByName(part.drop("json"))
        level = part.where("json is not null").select("doc_id", "path", "json")
    return out


def wiki_lines(docs: DataFrame, least: int = LONG) -> DataFrame:
    """(doc_id, text) with "========,level,title" lines as headings; with at most one of level 1, deeper ones move up by one."""
    pattern = "^========,([0-9]+),(.*)$"
    lines = F.split("text", "\n")
    level = lambda x: F.regexp_extract(x, pattern, 1)
    marked = docs.withColumn("_top", F.size(F.filter(lines, lambda x: level(x) == "1")))

    def line(x):
        n = level(x).try_cast("int")
        depth = F.when((F.col("_top") <= 1) & (n > 1), n - 1).otherwise(n)
        return F.when(level(x) != "", F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), F.regexp_extract(x, pattern, 2))).otherwise(x)

    return marked.select("doc_id", F.array_join(F.transform(lines, line), "\n").alias("text")).where(F.char_length("text") >= least)


def heading_histogram(docs: DataFrame) -> DataFrame:
    """(level, n) of heading lines."""
    from lodestack.functions.text import heading_level

    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(heading_level(F.col("line")).alias("level")).where("level > 0").groupBy("level").agg(F.count(F.lit(1)).alias("n"))
