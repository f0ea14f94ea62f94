"""Queries of problem 1: the production copy of the knowledge base against its seed copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftlake.operators.diff import diff_by_key, diff_summary
from weftlake.session import table

FIELDS = ["title", "content", "category", "lang", "embedding_model", "dimensions", "content_hash", "active"]


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf, "knowledge_chunks"), table(spark, sf, "knowledge_chunks_seed")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return diff_by_key(*_sides(spark, sf), "doc_id", FIELDS, latest="chunk_id")


def p1_values(spark: SparkSession, sf: str) -> DataFrame:
    return diff_by_key(*_sides(spark, sf), "doc_id", FIELDS, latest="chunk_id", values=True)


def p1_summary(spark: SparkSession, sf: str) -> DataFrame:
    return diff_summary(p1_found(spark, sf))


QUERIES = {"p1_found": p1_found, "p1_values": p1_values, "p1_summary": p1_summary}


def _latest(name: str) -> str:
    return (
        f"SELECT regexp_replace(doc_id, '^[\\s\\x{{00A0}}\\x{{3000}}]+|[\\s\\x{{00A0}}\\x{{3000}}]+$', '', 'g') AS doc_id, * EXCLUDE (doc_id) "
        f"FROM {name} WHERE doc_id IS NOT NULL "
        "QUALIFY row_number() OVER (PARTITION BY regexp_replace(doc_id, '^[\\s\\x{00A0}\\x{3000}]+|[\\s\\x{00A0}\\x{3000}]+$', '', 'g') ORDER BY chunk_id DESC) = 1"
    )


_VALUES = (
    f"WITH l AS ({_latest('knowledge_chunks')}), r AS ({_latest('knowledge_chunks_seed')}), "
    "j AS (SELECT l.doc_id AS d, r.doc_id AS rd, " + ", ".join(f"l.{f} AS l_{f}, r.{f} AS r_{f}" for f in FIELDS) + " FROM l JOIN r ON l.doc_id = r.doc_id) "
    "SELECT doc_id, 'left_only' AS diff, CAST(NULL AS VARCHAR) AS left_value, CAST(NULL AS VARCHAR) AS right_value FROM l WHERE doc_id NOT IN (SELECT doc_id FROM r) "
    "UNION ALL SELECT doc_id, 'right_only', NULL, NULL FROM r WHERE doc_id NOT IN (SELECT doc_id FROM l) "
    + " ".join(f"UNION ALL SELECT d, '{f}', CAST(l_{f} AS VARCHAR), CAST(r_{f} AS VARCHAR) FROM j WHERE l_{f} IS DISTINCT FROM r_{f}" for f in FIELDS)
)

SQL = {
    "p1_found": f"SELECT doc_id, diff FROM ({_VALUES})",
    "p1_values": _VALUES,
    "p1_summary": f"SELECT diff, count(*) AS n FROM ({_VALUES}) GROUP BY diff",
}
