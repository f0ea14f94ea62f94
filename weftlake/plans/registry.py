"""All queries of the core library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftlake.operators import bm25
from weftlake.plans import corpus, diff, extras, judging, search

_PARTS = [corpus, diff, judging, search, extras]

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: s for part in _PARTS for name, s in part.SQL.items()}


def answer_all(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, doc_id, score, rank): the five best chunks of every question, in its language."""
    index = bm25.build(corpus.chunks(spark, sf))
    return bm25.search(index, bm25.resolve(corpus.questions(spark, sf), index.languages), search.K).select("qid", "doc_id", "score", "rank")
