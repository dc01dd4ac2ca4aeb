"""Scores over predictions, evidences, facts and chunk borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import metrics
from lodestack.functions import text as fn

TINY = 1e-20


def evidence_recall(rows: DataFrame, keys: list[str], evidence: str, text: str) -> DataFrame:
    """Share of evidence found in the text, by length, per group of rows (one evidence each)."""
    size = F.char_length(evidence)
    hit = metrics.evidence_hit(F.col(evidence), F.col(text))
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(hit * size), F.lit(0.0)).alias("_h"), F.coalesce(F.sum(size), F.lit(0)).alias("_s")).select(*keys, (F.col("_h") / (F.col("_s") + TINY)).alias("recall"))


def evidence_recall_of(evidences: Column, text: Column) -> Column:
    """The same for an array of evidences; none gives 0."""
    sums = F.aggregate(F.coalesce(evidences, F.array().cast("array<string>")), F.struct(F.lit(0.0).alias("h"), F.lit(0).alias("n")), lambda s, e: F.struct((s["h"] + metrics.evidence_hit(e, text) * F.char_length(e)).alias("h"), (s["n"] + F.char_length(e)).alias("n")))
    return sums["h"] / (sums["n"] + TINY)


def _by_evidence(dataset: Column, evidences: Column) -> Column:
    """Where a row of these data sets has evidences, even an empty list of them, they count and not the answers."""
    return dataset.rlike("OHRBench|GutenQA|HiCBench") & evidences.isNotNull()


def _retrieval_parts(dataset: Column, evidences: Column, answers: Column) -> Column:
    """Structs (text, n) of what a retrieval is held against: n is the length before cleaning."""
    part = lambda text, raw: F.struct(text.alias("text"), F.char_length(raw).alias("n"))
    whole = F.transform(evidences, lambda e: part(fn.evidence_text(e), e))
    by_sentence = F.flatten(F.transform(evidences, lambda e: F.transform(fn.sentences_en(e), lambda x: part(fn.strip_heading(x), x))))
    return F.when(_by_evidence(dataset, evidences), whole).when(dataset == "qasper_all", by_sentence).otherwise(F.transform(answers, lambda a: part(a, a)))


def retrieval_target(dataset: Column, evidences: Column, answers: Column) -> Column:
    """What a retrieval is held against: cleaned evidences, sentences of evidences, or the answers."""
    return _retrieval_parts(dataset, evidences, answers)["text"]


def retrieval_recall(dataset: Column, evidences: Column, answers: Column, text: Column) -> Column:
    """Share of the target that stands in the text, by length before cleaning; no target gives 0."""
    parts = F.coalesce(_retrieval_parts(dataset, evidences, answers), F.array().cast("array<struct<text: string, n: int>>"))

    def share(t: Column) -> Column:
        add = lambda s, x: F.struct((s["h"] + F.contains(t, fn.normalize_answer(x["text"])).cast("double") * x["n"]).alias("h"), (s["n"] + x["n"]).alias("n"))
        return F.aggregate(parts, F.struct(F.lit(0.0).alias("h"), F.lit(0).alias("n")), add, lambda s: s["h"] / (s["n"] + TINY))

    return metrics.bound(fn.normalize_answer(F.coalesce(text, F.lit(""))), share)


def retrieval_scores(rows: DataFrame, dataset: str, evidences: str, answers: str, text: str) -> DataFrame:
    """(dataset, retrieval): 100 times the mean recall of evidence, where that is 0 of answers, else null."""
    name = F.col(dataset)
    scored = rows.select(dataset, (_by_evidence(name, F.col(evidences)) | (name == "qasper_all")).alias("_e"), retrieval_recall(name, F.col(evidences), F.col(answers), F.col(text)).alias("_r"))
    mean = lambda on: F.round(100 * F.coalesce(F.sum(F.when(on, F.col("_r"))), F.lit(0.0)) / (F.count(F.lit(1)) + TINY), 2)
    return scored.groupBy(dataset).agg(mean(F.col("_e")).alias("_a"), mean(~F.col("_e")).alias("_b")).select(dataset, retrieval_score(F.col("_a"), F.col("_b")).alias("retrieval"))


def class_filter(rows: DataFrame, flag: str | None, classes: str = "all_classes") -> DataFrame:
    """Rows whose classes hold the flag; rows without classes stay, as do all rows without a flag."""
    return rows if flag is None else rows.where(F.col(classes).isNull() | F.array_contains(classes, flag))


def dataset_scores(rows: DataFrame, group: list[str], item: str, score: Column) -> DataFrame:
    """100 times the mean over items of the best answer's mean over samples: rows are (item, sample, answer)."""
    by_answer = rows.groupBy(*group, item, "answer_idx").agg(F.avg(score).alias("_m"))
    best = by_answer.groupBy(*group, item).agg(F.greatest(F.max("_m"), F.lit(0.0)).alias("_b"))
    return best.groupBy(*group).agg(F.round(100 * F.sum("_b") / (F.count(F.lit(1)) + TINY), 2).alias("score"), F.count(F.lit(1)).alias("n"))


def context_summary(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group: the mean length of contexts, and all merges."""
    return rows.groupBy(*group).agg(F.avg("context_length").alias("mean_context_length"), F.coalesce(F.sum("merge_count"), F.lit(0)).cast("long").alias("merges"), F.count(F.lit(1)).alias("n"))


def macro_average(scores: DataFrame, score: str = "score") -> DataFrame:
    """One row: the mean of the data sets' scores, each counted alike, and how many have one."""
    return scores.agg(F.avg(score).alias("macro"), F.count(score).alias("n_datasets"))


def chunk_statistics(results: DataFrame, group: list[str], key: str = "doc_id", time: str = "time_cost", splits: str = "n_splits") -> DataFrame:
    """Per group of documents (key, time, splits): their mean time and number of chunks; rows that repeat a document count once."""
    one = results.groupBy(*group, key).agg(F.max(time).alias("_t"), F.max(splits).alias("_n"))
    return one.groupBy(*group).agg(F.avg("_t").alias("mean_time"), F.avg("_n").alias("mean_chunks"), F.count(F.lit(1)).alias("n_docs"))


def retrieval_score(evidence: Column, answer: Column) -> Column:
    """The evidence score, else the answer score, else null; 0 counts as missing."""
    return F.coalesce(F.nullif(evidence, F.lit(0.0)), F.nullif(answer, F.lit(0.0)))


def valid_facts(facts: Column) -> Column:
    return F.filter(facts, lambda x: x.isNotNull() & x.rlike(fn.NOT_SPACE))


def valid_classifications(reply: Column) -> Column:
    """The reply's statements with ``attributed`` 0 or 1; null where it can't be read."""
    schema = "classifications array<struct<statement: string, attributed: int>>"
    return F.filter(F.from_json(fn.json_object(reply), schema)["classifications"], lambda c: c["attributed"].isin(0, 1))


def fact_recall(rows: DataFrame, item: str) -> DataFrame:
    """(item, response, rate, n_facts): the share of attributed statements of each response, over all its replies."""
    return rows.groupBy(item, "response").agg(F.avg("attributed").alias("rate"), F.count(F.lit(1)).alias("n_facts"))


def micro_recall(rates: DataFrame, item: str) -> DataFrame:
    """100 times the mean rate weighted by facts, and the mean spread of an item's rates."""
    per = rates.groupBy(item).agg(F.avg("rate").alias("_r"), F.max("n_facts").alias("_n"), F.stddev_pop("rate").alias("_d"))
    return per.agg((100 * F.sum(F.col("_r") * F.col("_n")) / (F.sum("_n") + TINY)).alias("recall"), F.avg("_d").alias("spread"))


def boundary_counts(truth: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per level: borders in truth, found, and in both at that level, from (key, p, level) tables."""
    a = truth.select(key, "p", F.col("level").alias("level_a")).distinct()
    b = found.select(key, "p", F.col("level").alias("level_b")).distinct()
    joined = a.join(b, [key, "p"], "full_outer")
    sides = joined.select(F.explode(F.array_distinct(F.array_compact(F.array("level_a", "level_b")))).alias("level"), "level_a", "level_b")
    count = lambda c: F.sum(c.cast("long"))
    level, has_a, has_b = F.col("level"), F.coalesce(F.col("level_a") == F.col("level"), F.lit(False)), F.coalesce(F.col("level_b") == F.col("level"), F.lit(False))
    return sides.groupBy(level).agg(count(has_a).alias("n_truth"), count(has_b).alias("n_found"), count(has_a & has_b).alias("n_both"))


def boundary_any(truth: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same for borders of any level, as one row."""
    a, b = truth.select(key, "p").distinct(), found.select(key, "p").distinct()
    joined = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), [key, "p"], "full_outer")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return joined.agg(count(F.col("a")).alias("n_truth"), count(F.col("b")).alias("n_found"), count(F.col("a") * F.col("b")).alias("n_both"))


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    p = F.col("n_both") / (F.col("n_found") + TINY)
    r = F.col("n_both") / (F.col("n_truth") + TINY)
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2 * p * r / (p + r + TINY))
