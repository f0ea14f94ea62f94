"""Export of named queries from a database into CSV files; a table that fails is skipped, the others go on."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from weftlake.sources.files import load_env_file, write_csv

#: The tables that are exported, with their columns and the order of the rows. No embeddings and no mail
#: addresses of users leave the database; of a log whose columns are not listed, all do, in the order of its first column.
COLUMNS = {
    "chat_messages": (["message_id", "session_id", "role", "content", "lang", "message_ref", "created_at"], ["created_at"]),
    "chat_turn_metrics": (["metric_id", "created_at", "lang", "authenticated", "streamed", "latency_ms", "question_chars", "answer_chars", "rag_chunks", "outcome"], ["created_at"]),
    "chat_feedback": (["feedback_id", "message_ref", "session_id", "rating", "reason", "question_snippet", "lang", "created_at"], ["created_at"]),
    "knowledge_chunks": (["chunk_id", "doc_id", "title", "content", "category", "lang", "embedding_model", "dimensions", "content_hash", "active"], ["doc_id"]),
    "payment_logs": ([], []),
}


def query_of(table: str, columns: list[str]) -> str:
    return f"SELECT {', '.join(columns) or '*'} FROM {table}"


#: table -> (query, order); an empty order is that of the first column.
EXPORTS = {table: (query_of(table, columns), order) for table, (columns, order) in COLUMNS.items()}


def database_url(variable: str = "DATABASE_URL", env_file: str | None = None) -> str:
    """The address of the database from the environment, else from an environment file; without one, an error."""
    if env_file and variable not in os.environ:
        load_env_file(env_file)
    url = os.environ.get(variable, "")
    if not url:
        raise LookupError(f"{variable} is not set")
    return url


def reader(spark: SparkSession, url: str, properties: Mapping[str, str]) -> Callable[[str], DataFrame]:
    return lambda query: spark.read.jdbc(url, f"({query}) AS q", properties=dict(properties))


def export(read: Callable[[str], DataFrame], folder: str, exports: Mapping[str, tuple[str, list[str]]] = EXPORTS) -> dict[str, str]:
    """Writes each query's rows under folder; returns the error of each table that failed."""
    failed = {}
    for name, (query, order) in exports.items():
        try:
            rows = read(query)
            write_csv(rows, f"{folder}/{name}", order or rows.columns[:1])
        except Exception as e:  # noqa: BLE001 - one table must not stop the others
            failed[name] = str(e).splitlines()[0]
    return failed
