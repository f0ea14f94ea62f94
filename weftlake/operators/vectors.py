"""Exact cosine search over embedding arrays.

Questions are searched in blocks of bounded bytes: a block is packed into a matrix that goes to every task, and tasks
multiply it with the vectors they scan, a bounded number of products at a time, keeping the best k per question over the
whole task; what is shuffled is k rows per question and task. Questions of a block with one scope and one vector are one
question until then. Each block reads the vectors once, and its result is kept before the next begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from weftlake.operators.bm25 import PLACES, named, top
from weftlake.session import durable

#: Bytes of the question vectors of a block, give or take a few by their hash, and products that a task holds at a time.
BLOCK_BYTES = 32 << 20
SIMS = 2_000_000


def guarded_cosine(a: str, b: str):
    """Cosine of two array columns in double precision; 0 if either has no length."""
    dot = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS double) * cast(y AS double)), 0D, (s, x) -> s + x)")
    norm = lambda c: F.sqrt(F.expr(f"aggregate({c}, 0D, (s, x) -> s + cast(x AS double) * cast(x AS double))"))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def load(corpus: DataFrame, vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """(ord, doc_id, lang, embedding): a corpus with its vectors (key, embedding); each row must have exactly one.

    A chunk without a vector, a vector without a chunk, a repeated key or vectors of several sizes are errors.
    """
    check_dimensions(vectors)
    both = corpus.select(key, "ord", "lang").join(vectors.select(F.col(key).alias("_k"), "embedding"), F.col(key) == F.col("_k"), "full")
    faults = both.agg(F.count_if(F.col("embedding").isNull()).alias("chunks"), F.count_if(F.col(key).isNull()).alias("vectors"), (F.count(key) - F.count_distinct(key)).alias("repeated")).first()
    if any(faults):
        raise ValueError(f"{faults.chunks} chunks without a vector, {faults.vectors} vectors without a chunk, {faults.repeated} repeated")
    return both.select("ord", F.col(key).alias("doc_id"), "lang", "embedding")


def check_dimensions(vectors: DataFrame, col: str = "embedding") -> int:
    """The one dimension of all vectors; an error names the fault. Null vectors are left out of a search."""
    sizes = vectors.where(F.col(col).isNotNull()).agg(F.min(F.size(col)).alias("a"), F.max(F.size(col)).alias("b")).first()
    if sizes.a != sizes.b:
        raise ValueError(f"vectors have {sizes.a} to {sizes.b} dimensions")
    return sizes.a or 0


def search(vectors: DataFrame, questions: DataFrame, k: int, min_similarity: float = 0.55, block: int | None = None) -> DataFrame:
    """(qid, ord, doc_id, score, rank): the k most similar vectors (ord, doc_id, lang, embedding) of each question.

    questions: (qid, scope, vector). Only similarities of at least min_similarity count; a vector without length has
    similarity 0; ties go to the lower ord. A scope other than `*` admits vectors of that language only. Questions with a
    null vector have no rows. A question whose vector has another dimension is an error.
    """
    out = None
    wanted = questions.where("vector IS NOT NULL").select("qid", "scope", "vector")
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("width")).first()
    block = block or max(1, BLOCK_BYTES // (8 * max(size.width, 1)))
    blocks = -(-size.n // block) if k > 0 else 0
    number = F.pmod(F.xxhash64("qid"), F.lit(max(blocks, 1)))
    for b in range(blocks):
        asked = wanted.where(number == b).collect()
        if asked:
            part = _search_block(vectors, asked, questions, k, min_similarity)
            part = part if blocks == 1 else durable(part)
            out = part if out is None else out.unionByName(part)
    if out is None:
        kinds = {f.name: f.dataType.simpleString() for f in [questions.schema["qid"], vectors.schema["ord"], vectors.schema["doc_id"]]}
        return vectors.sparkSession.createDataFrame([], f"qid {kinds['qid']}, ord {kinds['ord']}, doc_id {kinds['doc_id']}, score double, rank long")
    return top(out, k)


class _Best:
    """The k best (score, ord) of each question so far, in arrays; what cannot be among them is dropped at once."""

    def __init__(self, questions: int, k: int, least: float) -> None:
        self.k, self.limit = k, max(4 * questions * k, SIMS)
        self.floor = np.full(questions, least)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, question: np.ndarray, score: np.ndarray, order: np.ndarray, doc: np.ndarray) -> None:
        self.parts.append((question, score, order, doc))
        self.size += len(question)
        if self.size > self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        question, score, order, doc = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        at = np.lexsort((order, -score, question))
        begins = np.searchsorted(question[at], question[at])
        place = np.arange(len(at)) - begins
        full = at[place == self.k - 1]
        self.floor[question[full]] = np.maximum(self.floor[question[full]], score[full])
        at = at[place < self.k]
        self.parts, self.size = [(question[at], score[at], order[at], doc[at])], len(at)
        return self.parts[0]


def _search_block(vectors: DataFrame, asked: list, questions: DataFrame, k: int, min_similarity: float) -> DataFrame:
    distinct: dict[tuple, int] = {}
    numbers = [(distinct.setdefault((r.scope, *r.vector), len(distinct)), r.qid) for r in asked]
    q = np.array([v[1:] for v in distinct], np.float64)
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    q = np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)
    scopes = np.array([v[0] for v in distinct], object)
    types = [LongType(), vectors.schema["ord"].dataType, vectors.schema["doc_id"].dataType]
    schema = ", ".join(f"{n} {t.simpleString()}" for n, t in zip(("qid", "ord", "doc_id"), types, strict=True)) + ", score double"
    step = max(1, SIMS // len(q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(q), k, min_similarity)
        anywhere = scopes == "*"
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                n = part.num_rows
                x = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
                if x.shape[1] != q.shape[1]:
                    raise ValueError(f"question vectors have {q.shape[1]} dimensions, stored ones {x.shape[1]}")
                length = np.linalg.norm(x, axis=1, keepdims=True)
                sims = q @ np.divide(x, length, out=np.zeros_like(x), where=length > 0).T
                np.round(sims, PLACES, out=sims)
                ok = sims >= best.floor[:, None]
                if not anywhere.all():
                    langs = np.array([v or "" for v in part.column(2).to_pylist()], object)
                    ok &= anywhere[:, None] | (scopes[:, None] == langs[None, :])
                question, at = np.nonzero(ok)
                if len(question):
                    best.add(question, sims[question, at], part.column(0).to_numpy(zero_copy_only=False)[at], np.array(part.column(1).to_pylist(), object)[at])
        if best.parts:
            question, score, order, doc = best.cut()
            yield pa.RecordBatch.from_arrays([pa.array(question), pa.array(order), pa.array(doc.tolist()), pa.array(score)], names=["qid", "ord", "doc_id", "score"])

    fields = vectors.select("ord", "doc_id", "lang", "embedding").where("embedding IS NOT NULL")
    return named(top(fields.mapInArrow(_typed(run, schema), schema), k), numbers, questions.schema["qid"]).drop("rank")


def _typed(run, schema: str):
    """Casts what run yields to the declared types."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    want = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])

    def cast(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in want], schema=want)

    return cast
