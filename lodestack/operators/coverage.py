"""Fact coverage of answers: facts of a reference are extracted, and judged against each response, by a generator.

A generator (prompts to replies) is made once per Python worker's stream. A
reply that can't be read is asked for again a bounded number of times, then left
out. The stand-ins read the prompt's own parts and need no model.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as fn
from lodestack.operators import evaluation
from lodestack.operators.deciders import Generator, retried
from lodestack.runtime import materialize

EXTRACT = 'List the facts that the reference states, as JSON {{"facts": [...]}}.\nQuestion: {question}\nReference:\n{reference}'
CHECK = 'For each fact say whether the response states it (1) or not (0), as JSON {{"classifications": [{{"statement": ..., "attributed": ...}}]}}.\nQuestion: {question}\nFacts: {facts}\nResponse:\n{response}'


def sentence_facts() -> Generator:
    """Each sentence of the reference is a fact."""

    def answer(prompt: str) -> str:
        reference = prompt.split("\nReference:\n", 1)[-1]
        return json.dumps({"facts": [s for s in re.split(r"(?<=[.!?])\s+", reference) if s.strip()]})

    return lambda prompts: [answer(p) for p in prompts]


def containing_judge() -> Generator:
    """A fact is stated if it stands in the response, in any case."""

    def answer(prompt: str) -> str:
        head, response = prompt.split("\nResponse:\n", 1)
        facts = json.loads(head.rsplit("\nFacts: ", 1)[1])
        return json.dumps({"classifications": [{"statement": f, "attributed": int(f.lower() in response.lower())} for f in facts]})

    return lambda prompts: [answer(p) for p in prompts]


def _readable(reply: str | None, name: str) -> bool:
    try:
        found = re.search(r"\{.+\}", (reply or "").rsplit("</think>", 1)[-1], re.S)
        return isinstance(json.loads(found[0]).get(name), list) if found else False
    except (ValueError, AttributeError):
        return False


def replies(prompt: Column, name: str, load: Callable[[], Generator], samples: int = 1, times: int = 3) -> Column:
    """``samples`` replies to each prompt that hold a JSON list ``name``; null for one that could not be read ``times`` times."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = None
        for part in parts:
            drawn: list[list[str | None]] = [[] for _ in part]
            for _ in range(samples):
                open_ = [i for i, p in enumerate(part) if p is not None]
                got: dict[int, str] = {}
                for _ in range(times):
                    if open_:
                        call = call or retried(load())
                        got |= {i: r for i, r in zip(open_, call([part.iloc[i] for i in open_])) if _readable(r, name)}
                        open_ = [i for i in open_ if i not in got]
                for i, own in enumerate(drawn):
                    own.append(got.get(i))
            yield pd.Series(drawn)

    return run(prompt)


def extract_facts(rows: DataFrame, question: str = "input", reference: str = "reference", facts: str = "facts", load: Callable[[], Generator] = sentence_facts) -> DataFrame:
    """Adds ``ref_facts``: the facts given, without blank ones, or else those extracted from the reference; null if no reply was readable."""
    given = evaluation.valid_facts(F.col(facts))
    has = F.coalesce(F.size(given) > 0, F.lit(False))
    prompt = F.when(~has, fn.fill_template(EXTRACT, question=F.coalesce(F.col(question), F.lit("")), reference=F.coalesce(F.col(reference), F.lit(""))))
    asked = rows.withColumn("_reply", replies(prompt, "facts", load)[0])
    read = evaluation.valid_facts(F.from_json(fn.json_object(F.col("_reply")), "facts array<string>")["facts"])
    return asked.withColumn("ref_facts", F.when(has, given).otherwise(read)).drop("_reply")


def check_facts(rows: DataFrame, key: str = "index", question: str = "input", responses: str = "pred", load: Callable[[], Generator] = containing_judge, samples: int = 1) -> DataFrame:
    """(key, ref_facts_cov, facts_recall): for each response, in order, its replies' judgements, and the share of stated facts over all of them."""
    each = rows.select(key, question, "ref_facts", F.posexplode(responses).alias("_r", "_response")).where(F.size("ref_facts") > 0)
    prompt = fn.fill_template(CHECK, question=F.coalesce(F.col(question), F.lit("")), facts=F.to_json("ref_facts"), response=F.coalesce(F.col("_response"), F.lit("")))
    judged = each.withColumn("_replies", replies(prompt, "classifications", load, samples))
    judged = judged.withColumn("_cov", F.transform(F.filter("_replies", lambda r: r.isNotNull()), evaluation.valid_classifications))
    stated = F.transform(F.flatten("_cov"), lambda c: c["attributed"])
    rate = F.try_divide(F.aggregate(stated, F.lit(0.0), lambda s, a: s + a), F.size(stated))
    lists = judged.withColumn("_rate", rate).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", "_cov", "_rate"))).alias("_l"))
    return lists.select(key, F.transform("_l", lambda x: x["_cov"]).alias("ref_facts_cov"), F.transform("_l", lambda x: x["_rate"]).alias("facts_recall"))


def coverage_run(rows: DataFrame, load_facts: Callable[[], Generator] = sentence_facts, load_judge: Callable[[], Generator] = containing_judge, samples: int = 1, key: str = "index") -> DataFrame:
    """Evaluation rows (key, input, answers, pred, facts) with ``ref_facts_metrics``; rows that hold it already are not asked again.

    A blank reference has recall 1; without facts it is null.
    """
    metrics = "ref_facts_metrics"
    todo = rows.where(F.col(metrics).isNull()).drop(metrics) if metrics in rows.columns else rows
    # Written, so that no prompt is answered twice.
    made = materialize(extract_facts(todo.withColumn("_reference", F.get("answers", 0)), reference="_reference", load=load_facts), "facts")
    judged = materialize(check_facts(made, key, load=load_judge, samples=samples), "judgements")
    # A blank reference is covered by any response.
    blank = F.coalesce(fn.is_blank(F.col("_reference")), F.lit(True))
    recall = F.when(blank, F.array(F.lit(1.0))).otherwise(F.col("facts_recall")).alias("facts_recall")
    one = F.struct(recall, F.coalesce("ref_facts", F.array().cast("array<string>")).alias("ref_facts"), "ref_facts_cov")
    out = made.join(judged, key, "left").withColumn(metrics, F.array(one)).drop("_reference", "ref_facts", "ref_facts_cov", "facts_recall")
    if metrics not in rows.columns:
        return out
    return out.unionByName(rows.where(F.col(metrics).isNotNull()))


def coverage_recall(rows: DataFrame, key: str = "index") -> DataFrame:
    """One row: the recall of facts over all samples that have any, weighted by facts, and the mean spread between a sample's responses."""
    one = rows.select(key, F.explode("ref_facts_metrics").alias("m")).select(key, F.size("m.ref_facts").alias("n_facts"), F.posexplode("m.facts_recall").alias("response", "rate"))
    return evaluation.micro_recall(one.where("rate is not null and n_facts > 0"), key)
