"""Quality rules: per-text measures, and how often each line occurs across a host's documents.

All of it is DataFrame expressions. Measures come from one pass over the texts.
For the line rule, each normalised line is hashed, the distinct documents that
hold it are counted per host (exact copies of one text count once), and lines
above the host's limit are taken out everywhere but in the first document that
holds them. A document of which too few words are left is rejected.

Defined results: a null text has no words and fails; a null host is a host of
its own; a null key loses the lines of which a document with a key is the first;
rows that share a key are judged by their own texts, repeated rows alike; an
empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.runtime import materialize

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class LineRule:
    """A line is common where at least ``min_docs`` documents and ``min_share`` of the host's documents hold it."""

    min_docs: int = 10
    min_share: float = 0.05
    #: Rejected with a smaller part of its words left.
    min_left: float = 0.3


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def _repeat_words(grams: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice; ``grams`` has one hash per window."""
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(sorted_pairs: Column) -> Column:
        at = F.filter(
            F.transform(
                sorted_pairs,
                lambda p, k: F.when(
                    (F.get(sorted_pairs, k + 1)["h"] == p["h"]) | (F.when(k > 0, F.get(sorted_pairs, k - 1)["h"]) == p["h"]),
                    p["i"],
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.aggregate(
            F.sort_array(at),
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
            lambda s: s["n"],
        )

    # The one-element array binds the sorted pairs once; without repeats nothing is sorted.
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(F.element_at(F.transform(F.array(pairs), covered), 1))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    staged = docs.withColumn("_words", words_of(F.col(text))).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    staged = staged.withColumn(
        "_grams",
        F.when(
            F.size("_words") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    out = (
        staged.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", _repeat_words(F.col("_grams")).cast("long"))
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("_words", "_lines", "_grams")


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, f"{SPACE}+", " "))))


def _lines(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """One row per document, text and line that has a word: host, line hash and the line's number of words.

    Repeated rows give equal rows here, and count once.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        F.coalesce(F.col(host), F.lit("")).alias("_host"),
        F.col(key).alias("_doc"),
        F.xxhash64(t).alias("_text"),
        F.posexplode(F.transform(lines, lambda x: F.struct(_line_key(x).alias("k"), F.size(words_of(x)).alias("n")))).alias("_at", "_l"),
    ).select("_host", "_doc", "_text", "_at", F.col("_l.k").alias("_line"), F.col("_l.n").alias("_n"))


def common_lines(docs: DataFrame, rule: LineRule = LineRule(), key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The lines above their host's limit: ``_host``, ``_line``, ``_first`` (the smallest key that holds it) and ``_docs``.

    Copies of one text count once: each host's texts are grouped by their hash
    first, with the counts of a hot host summed on the map side.
    """
    texts = docs.groupBy(F.coalesce(F.col(host), F.lit("")).alias("_host"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text")).agg(F.min(key).alias("_doc"))
    hosts = texts.groupBy("_host").agg(F.count(F.lit(1)).alias("_texts"))
    tagged = docs.select(
        F.coalesce(F.col(host), F.lit("")).alias("_host"),
        F.col(key).alias("_doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text"),
        F.explode(F.array_distinct(F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), _line_key))).alias("_line"),
    )
    # A line's distinct texts: one row per host, line and text, then a plain count.
    per_text = tagged.groupBy("_host", "_line", "_text").agg(F.min("_doc").alias("_doc"))
    counted = per_text.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs"), F.min("_doc").alias("_first")).where(F.col("_docs") >= rule.min_docs)
    return counted.join(hosts, "_host").where(F.col("_docs") >= rule.min_share * F.col("_texts")).select("_host", "_line", "_first", "_docs")


def _judged(docs: DataFrame, rule: LineRule, key: str, text: str, host: str) -> DataFrame:
    base = measures(docs.select(key, text, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text")), text).drop(text)
    common = common_lines(docs, rule, key, text, host)
    held = _lines(docs, key, text, host).join(common, ["_host", "_line"]).where(~F.col("_doc").eqNullSafe(F.col("_first")))
    lost = held.dropDuplicates(["_host", "_doc", "_text", "_at"]).groupBy("_doc", F.col("_text").alias("_own")).agg(F.sum("_n").alias("_lost"))
    out = base.join(lost, base[key].eqNullSafe(lost["_doc"]) & (base["_text"] == lost["_own"]), "left").drop("_doc", "_own").withColumn("words_left", F.col("n_words") - F.coalesce(F.col("_lost"), F.lit(0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= rule.min_left * F.col("n_words"))).drop("_lost")


def quality_rules(docs: DataFrame, rule: LineRule = LineRule(), key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document: its key, the measures, ``words_left`` and ``kept``."""
    return _judged(docs, rule, key, text, host).drop("_text")


def kept_documents(docs: DataFrame, rule: LineRule = LineRule(), key: str = "doc_id") -> DataFrame:
    """The documents that the rules keep, with all their columns; rows are told apart by key, null or not, and text.

    The verdicts are written first: a filter on them would be pushed below the
    measures, and their definitions copied into it once for each use.
    """
    judged = materialize(_judged(docs, rule, key, "text", "source").select(F.col(key).alias("_kept_key"), F.col("_text").alias("_kept_text"), "kept"), "verdicts")
    kept = judged.where("kept").select("_kept_key", "_kept_text").distinct()
    same_text = F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["_kept_text"]
    return docs.join(kept, docs[key].eqNullSafe(kept["_kept_key"]) & same_text, "left_semi")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as host from documents),
w as (select doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as gram from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
again as (select doc_id, i from g qualify count(*) over (partition by doc_id, gram) > 1),
reps as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from again) group by doc_id),
l as (select doc_id, host, pos, line from (select doc_id, host, unnest(string_split(t, chr(10))) as line, unnest(range(0, len(string_split(t, chr(10))))) as pos from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from l group by doc_id),
k as (select doc_id, host, pos, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) as key, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n from l),
texts as (select host, t, min(doc_id) as first from d group by host, t),
hosts as (select host, count(*) as n_texts from texts group by host),
common as (select k.host, k.key, min(k.doc_id) as first from k join d using (doc_id) join hosts h on h.host = k.host group by k.host, k.key, h.n_texts having count(distinct d.t) >= 10 and count(distinct d.t) >= 0.05 * h.n_texts),
lost as (select k.doc_id, sum(k.n) as lost from k join common c on c.host = k.host and c.key = k.key and c.first <> k.doc_id group by k.doc_id),
m as (select d.doc_id, len(ws)::bigint as n_words, coalesce(length(array_to_string(ws, '')), 0)::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    (len(ws) - coalesce(lost, 0))::bigint as words_left
  from d join w using (doc_id) left join dup using (doc_id) left join reps using (doc_id) left join lost using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select *, not base_failed and words_left >= 0.3 * n_words as kept from f
"""
