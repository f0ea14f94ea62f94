"""Queries of windows by event time, of the cache, of metric sinks and of the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.operators import bm25, classifier
from weftlake.plans.search import retrieval_metrics
from weftlake.session import table
from weftlake.sources import files
from weftlake.streaming.questions import windowed_turns


def turns_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    return windowed_turns(table(spark, sf, "chat_turn_metrics")).withColumn("start", F.col("start").cast("string"))


def metrics_json(spark: SparkSession, sf: str) -> DataFrame:
    return files.to_json_rows(retrieval_metrics(spark, sf))


def _network(spark: SparkSession, sf: str):
    rows = table(spark, sf, "embeddings").where("embedding IS NOT NULL AND label IS NOT NULL").withColumn("split", classifier.split_of("vec_id"))
    labels = rows.agg(F.max("label") + 1).first()[0]
    return classifier.train(rows.where("split = 'train'"), [16], labels), rows


def network_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return classifier.accuracy(*_network(spark, sf))


def network_losses(spark: SparkSession, sf: str) -> DataFrame:
    return classifier.losses(_network(spark, sf)[0], spark)


def network_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """How many vectors were judged, and whether no part has more right answers than vectors and the loss fell."""
    model, rows = _network(spark, sf)
    fell = model.summary().objectiveHistory
    return classifier.accuracy(model, rows).agg(F.sum("n").alias("vectors"), F.bool_and(F.col("correct") <= F.col("n")).alias("possible"), F.lit(fell[-1] < fell[0]).alias("fell"))


def metrics_json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of `metrics_json` read back: configuration, questions and two of the metrics."""
    fields = F.from_json("json", "config string, n long, recall_at_3 double, mrr double")
    return metrics_json(spark, sf).select(fields.alias("f")).select("f.*")


def embedding_texts(spark: SparkSession, sf: str) -> DataFrame:
    from weftlake.plans.corpus import chunks

    return chunks(spark, sf).select("doc_id", bm25.embedding_text(F.col("title"), F.col("content")).alias("text"))


QUERIES = {f.__name__: f for f in (turns_by_hour, metrics_json, metrics_json_fields, network_accuracy, network_losses, network_sizes, embedding_texts)}

from weftlake.plans.corpus import _EMBED, CHUNKS_SQL  # noqa: E402
from weftlake.plans.search import SQL as SEARCH_SQL  # noqa: E402

SQL = {
    "turns_by_hour": "WITH m AS (SELECT DISTINCT ON (metric_id) * FROM chat_turn_metrics WHERE created_at IS NOT NULL) SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS start, lower(trim(lang, ' ')) AS lang, count(*) AS turns, count(*) FILTER (WHERE lower(outcome) IN ('error', 'timeout')) AS errors, max(latency_ms) AS slowest FROM m GROUP BY ALL",
    "metrics_json_fields": f"SELECT config, n, recall_at_3, mrr FROM ({SEARCH_SQL['retrieval_metrics']})",
    "network_sizes": "SELECT count(*) AS vectors, true AS possible, true AS fell FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL",
    "embedding_texts": f"WITH {CHUNKS_SQL} SELECT doc_id, {_EMBED} AS text FROM corpus",
}
