"""Item features of answers for the consensus of their labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.llm import pairs

#: Kinds of answers; a brief one says yes or no without a fact.
KINDS = ["empty", "copy", "refusal", "brief", "answer"]
BRIEF_LETTERS, LONG_SENTENCES = 26, 3
WIDTH = len(KINDS) * 4 + 4


def kind_of(query: str | None, answer: str | None) -> str:
    if pairs.is_empty(answer):
        return "empty"
    if pairs.is_copy(query, answer):
        return "copy"
    if pairs.is_refusal(answer):
        return "refusal"
    return "brief" if len(pairs.letters(answer)) <= BRIEF_LETTERS and not any(c.isdigit() for c in answer) else "answer"


def of_answers(items: DataFrame) -> DataFrame:
    """(id, features) of one row per id: the kind of answer by whether the question has a document and it was found.

    Of conflicting rows of an id the greatest counts.
    """
    current = items.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("query", "tra_loi", (F.lower("loai") == "co_tai_lieu").alias("has"), F.col("hang_chunk_dung").alias("rank"))).alias("r")).select("id", "r.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, a, has, rank in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                x = [0.0] * WIDTH
                x[KINDS.index(kind_of(q, a)) * 4 + 2 * bool(has) + (rank is not None)] = 1.0
                found = pairs.sentences(a or "")
                x[-4] = float(rank or 0) / 4
                x[-3] = float(len(found) >= LONG_SENTENCES)
                x[-2] = float(bool(a) and pairs.unfinished(a)[0] is not None)
                x[-1] = float(bool(a) and any(c.isdigit() for c in a))
                rows.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "features"])

    return current.mapInArrow(run, "id string, features array<double>")
