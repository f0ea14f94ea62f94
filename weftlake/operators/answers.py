"""Answers generated from retrieved chunks and their judgement by a model, as tables.

A transport is called once for each request that the cache lacks; what it replies is kept with its key, so a run that is
repeated calls nothing. A failed call is a row with its error, never a label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.operators import labels, prompts
from weftlake.sources import models

CACHE = "key string, text string, latency_ms double, completion_tokens long, prompt_tokens long, error string"


def _ask(requests: DataFrame, cache: DataFrame | None, transport: Callable[[str, str], dict], policy: models.Policy | None, settings: str) -> DataFrame:
    """requests (id, system, user) with the reply to each; equal requests under equal settings are called once."""
    keyed = requests.withColumn("key", F.sha2(F.concat_ws("\0", F.lit(settings), "system", "user"), 256))
    known = (requests.sparkSession.createDataFrame([], CACHE) if cache is None else cache.select(*(f.split()[0] for f in CACHE.split(", ")))).where("error IS NULL AND text IS NOT NULL").dropDuplicates(["key"])
    wanted = keyed.select("key", "system", "user").dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
    return keyed.drop("system", "user").join(known.unionByName(models.complete(wanted, transport, policy)), "key")


def generate(items: DataFrame, contexts: DataFrame, template: str, now: str, transport: Callable[[str, str], dict], cache: DataFrame | None = None, policy: models.Policy | None = None, settings: str = "") -> DataFrame:
    """(id, key, text, latency_ms, completion_tokens, prompt_tokens, error) for items (id, query, lang).

    contexts: (id, context); an item without one is answered from the fixed line that says so. Items without a question
    are left out.
    """
    asked = items.where("query IS NOT NULL").join(contexts.select("id", "context"), "id", "left")
    return _ask(asked.select("id", prompts.system_prompt(template, F.lit(now), F.col("lang"), F.col("context")).alias("system"), F.col("query").alias("user")), cache, transport, policy, settings)


def judge(answers: DataFrame, contexts: DataFrame, rubric: str, transport: Callable[[str, str], dict], human: str = "nhan_tay", cache: DataFrame | None = None, policy: models.Policy | None = None, settings: str = "") -> DataFrame:
    """(id, label, reason, error) for answers (id, query, text and the human label).

    Refuses with an error while an answer lacks a human label: the judge must not be seen first. Answers that failed are
    left out; a reply that holds no label is an error of its row.
    """
    given = answers.where("text IS NOT NULL AND query IS NOT NULL")
    labels.require_labelled(given, "id", human)
    asked = given.join(contexts.select("id", "context"), "id", "left")
    replies = _ask(asked.select("id", F.lit(rubric).alias("system"), prompts.judge_prompt(F.col("query"), F.col("context"), F.col("text")).alias("user")), cache, transport, policy, settings)
    read = labels.parse_label(F.col("text"))
    return replies.select("id", F.when(F.col("error").isNull(), read).alias("p"), F.col("error").alias("failed")).select("id", "p.label", "p.reason", F.coalesce("failed", "p.error").alias("error"))


def run_summary(answers: DataFrame, run: str) -> DataFrame:
    """(run, answers, failed, p50_ms, p95_ms, tokens_per_s): of a run's answers; the rate is the median, null without tokens."""
    done = answers.where("error IS NULL").withColumn(run, F.col(run).cast("string"))
    times = labels.nearest_rank(done, [run], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}).drop("n")
    rates = labels.nearest_rank(done.withColumn("rate", labels.throughput(F.col("completion_tokens"), F.col("latency_ms"))), [run], "rate", {"tokens_per_s": 0.5}).drop("n")
    counts = answers.withColumn(run, F.col(run).cast("string")).groupBy(run).agg(F.count(F.lit(1)).alias("answers"), F.count("error").alias("failed"))
    return counts.join(times, run, "left").join(rates, run, "left")
