"""Fusion of the two rankings of a question: reciprocal ranks, vector first with fill, and re-ranking.

Branch 0 is the semantic ranking, branch 1 the lexical one. All are one union and one aggregate by (qid, doc_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlake.operators.bm25 import PLACES

#: Fixed value of reciprocal ranks.
RRF_K = 60
FUSIONS = ("vector_fill", "rrf", "vector_rerank")


def _branches(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    pick = lambda df, no: df.select("qid", "doc_id", "rank", F.lit(no).alias("branch"))
    return pick(semantic, 0).unionByName(pick(lexical, 1))


def _ranked(scored: DataFrame, order: list, k: int) -> DataFrame:
    window = Window.partitionBy("qid").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window).cast("long")).where(F.col("rank") <= k)


def rrf(semantic: DataFrame, lexical: DataFrame, k: int, weights: tuple[float, float] = (1.0, 1.0), rrf_k: int = RRF_K) -> DataFrame:
    """(qid, doc_id, score, rank). weights are (lexical, semantic); a weight of 0 takes a branch out altogether.

    Equal scores go to what comes first: the semantic branch, then the rank within a branch.
    """
    if len(weights) != 2:
        raise ValueError("one weight for each branch")
    both = _branches(semantic, lexical).withColumn("w", F.when(F.col("branch") == 0, F.lit(float(weights[1]))).otherwise(F.lit(float(weights[0])))).where("w <> 0")
    scored = both.groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("w") / (rrf_k + F.col("rank"))), PLACES + 3).alias("score"), F.min(F.struct("branch", "rank")).alias("first"))
    return _ranked(scored, [F.desc("score"), "first"], k).select("qid", "doc_id", "score", "rank")


def vector_fill(semantic: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, rank): the semantic order as it is, lexical hits only after it."""
    first = _branches(semantic, lexical).groupBy("qid", "doc_id").agg(F.min(F.struct("branch", "rank")).alias("first"))
    return _ranked(first, ["first"], k).select("qid", "doc_id", "rank")


def vector_rerank(semantic: DataFrame, lexical: DataFrame, k: int, weights: tuple[float, float] = (1.0, 1.0), rrf_k: int = RRF_K) -> DataFrame:
    """(qid, doc_id, score, rank): reciprocal ranks, but lexical hits only re-rank what the semantic branch found.

    The surviving lexical hits are ranked anew. Questions without semantic hits keep their lexical ones.
    """
    inside = lexical.join(semantic.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
    alone = lexical.join(semantic.select("qid").distinct(), "qid", "left_anti")
    kept = inside.select("qid", "doc_id", "rank").unionByName(alone.select("qid", "doc_id", "rank"))
    again = kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).cast("long"))
    return rrf(semantic, again, k, weights, rrf_k)


def fuse(mode: str, semantic: DataFrame, lexical: DataFrame, k: int, **options) -> DataFrame:
    if mode not in FUSIONS:
        raise ValueError(f"fusion must be one of {FUSIONS}, not {mode!r}")
    return {"vector_fill": vector_fill, "rrf": rrf, "vector_rerank": vector_rerank}[mode](semantic, lexical, k, **options)


def fused_score(fused_input: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """(qid, doc_id, score) of united branches (qid, doc_id, rank): the diagnostic sum without a cut."""
    return fused_input.groupBy("qid", "doc_id").agg(F.round(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))), PLACES + 3).alias("score"))


def degradation(questions: DataFrame, embedded: DataFrame, fused: DataFrame) -> DataFrame:
    """(branches, questions, hits): how many questions had both branches or the lexical one only, for want of a vector."""
    had = embedded.select("qid", F.lit("both").alias("branches"))
    hits = fused.groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    rows = questions.select("qid").distinct().join(had, "qid", "left").join(hits, "qid", "left")
    return rows.groupBy(F.coalesce("branches", F.lit("lexical only")).alias("branches")).agg(F.count(F.lit(1)).alias("questions"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
