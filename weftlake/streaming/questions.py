"""Streams: questions answered against a static index, and turn metrics in event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftlake.operators import bm25

QUESTION_SCHEMA = "qid string, query string, lang string"


def question_feed(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON files of questions as they arrive."""
    return spark.readStream.schema(QUESTION_SCHEMA).json(folder)


def answer_stream(questions: DataFrame, index: bm25.Index, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Searches every micro-batch of questions and hands (qid, doc_id, score, rank, batch) to the sink.

    A batch that is run again after a failure gives the same rows under the same number, so a sink that overwrites by
    batch number writes each result once.
    """

    def each(batch: DataFrame, number: int) -> None:
        hits = bm25.search(index, bm25.resolve(batch, index.languages), k)
        sink(hits.select("qid", "doc_id", "score", "rank").withColumn("batch", F.lit(number)), number)

    return questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_turns(metrics: DataFrame, window: str = "1 hour", late: str = "3 days") -> DataFrame:
    """(start, lang, turns, errors, slowest) of turn metrics (metric_id, created_at, lang, outcome, latency_ms) by event time.

    Re-delivered rows count once within the watermark; later rows are too late. Works on a stream and on a table alike.
    """
    rows = metrics.withColumn("created_at", F.col("created_at").cast("timestamp")).where("created_at IS NOT NULL")
    if rows.isStreaming:
        rows = rows.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["metric_id"])
    else:
        rows = rows.dropDuplicates(["metric_id"])
    grouped = rows.groupBy(F.window("created_at", window), F.lower(F.trim("lang")).alias("lang"))
    return grouped.agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.lower("outcome").isin("error", "timeout")).alias("errors"), F.max("latency_ms").alias("slowest")).select(F.col("window.start").alias("start"), "lang", "turns", "errors", "slowest")
