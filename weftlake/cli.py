"""Evaluation from the command line: python -m weftlake.cli --kb 'kb/*.yml' --golden golden.yml

Compares lexical retrieval with and without the language filter and, if vectors are given, the semantic branch and its
fusions. Exit codes: 0 passed, 1 below a threshold, 2 questions expect documents that the base lacks, 3 vectors missing.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.operators import bm25, corpus, fusion, metrics, synonyms, vectors
from weftlake.session import durable, local_session
from weftlake.sources import files

PASSED, BELOW, BAD_DATA, NO_VECTORS = range(4)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--kb", required=True, help="YAML files of the knowledge base")
    p.add_argument("--golden", required=True, help="YAML file of questions")
    p.add_argument("--synonyms", help="YAML file of synonym tables")
    p.add_argument("--vectors", help="Parquet of (text, embedding array<float>) for all chunks' texts and questions")
    p.add_argument("--candidates", type=int, default=10)
    p.add_argument("--min-similarity", type=float, default=0.55)
    p.add_argument("--bm25-weight", type=float, default=1.0)
    p.add_argument("--variants", action="store_true", help="also the fusions that are not the default")
    p.add_argument("--min-recall3", type=float, default=metrics.MIN_RECALL3)
    p.add_argument("--min-mrr", type=float, default=metrics.MIN_MRR)
    p.add_argument("--no-gate", action="store_true")
    p.add_argument("--json", action="store_true")
    return p


def rankings(spark: SparkSession, args: argparse.Namespace, base: DataFrame, questions: DataFrame) -> tuple[DataFrame | None, list[str]]:
    """((config, qid, doc_id, rank), configurations); no rankings if vectors are asked for and some are missing."""
    k, depth = metrics.EVAL_K, max(metrics.EVAL_K, args.candidates)
    index = bm25.build(base)
    keys = synonyms.table_of(spark, files.load_synonyms(args.synonyms)) if args.synonyms else None

    def lexical(scoped: DataFrame, n: int) -> DataFrame:
        if keys is None:
            return bm25.search(index, scoped, n)
        return bm25.search(index, synonyms.expand(scoped, keys), n, tokens=F.col("tokens"))

    scopes = {"": questions.withColumn("scope", F.lit(bm25.ALL)), " + lang": bm25.resolve(questions, index.languages)}
    runs = [(f"BM25{name}", lexical(q, k)) for name, q in scopes.items()]
    if args.vectors:
        stored = spark.read.parquet(args.vectors).select(F.col("text").alias("_text"), "embedding").dropDuplicates(["_text"])
        docs = base.withColumn("_text", bm25.embedding_text(F.col("title"), F.col("content"))).join(stored, "_text", "left")
        asked = {name: q.join(stored, q.query == stored["_text"], "left") for name, q in scopes.items()}
        if not docs.where("embedding IS NULL").isEmpty() or not asked[""].where("embedding IS NULL").isEmpty():
            return None, []  # a branch that silently falls back would be measured under the wrong name
        for name, q in asked.items():
            sem = durable(vectors.search(docs, q.select("qid", "scope", F.col("embedding").alias("vector")), depth, args.min_similarity))
            lex = durable(lexical(scopes[name], depth))
            runs += [(f"Vector{name}", sem.where(F.col("rank") <= k)), (f"Hybrid{name}", fusion.vector_fill(sem, lex, k))]
            if args.variants:
                weights = (args.bm25_weight, 1.0)
                runs += [(f"RRF{name}", fusion.rrf(sem, lex, k, weights)), (f"Rerank{name}", fusion.vector_rerank(sem, lex, k, weights))]
    out = None
    for name, hits in runs:
        part = hits.select(F.lit(name).alias("config"), "qid", "doc_id", "rank")
        out = part if out is None else out.unionByName(part)
    return durable(out), [name for name, _ in runs]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    base = durable(files.load_knowledge_base(spark, args.kb))
    questions = durable(files.load_questions(spark, args.golden).select(F.concat_ws("#", "file", "pos").alias("qid"), "query", "expected", "lang"))
    missing = [r[0] for r in corpus.missing_documents(questions, base).orderBy("doc_id").limit(20).collect()]
    if missing:
        print("not in the knowledge base:", ", ".join(missing), file=sys.stderr)
        return BAD_DATA
    ranked, configs = rankings(spark, args, base, questions)
    if ranked is None:
        print("some texts have no vector", file=sys.stderr)
        return NO_VECTORS
    hits = metrics.judged(ranked, questions, configs)
    table = durable(metrics.evaluate_with_total(metrics.per_question(hits)))
    if args.json:
        for r in files.to_json_rows(table).collect():
            print(r.json)
    else:
        print("\n".join(metrics.text_table(table)))
        for r in metrics.misses(hits, questions).orderBy("config", "qid").collect():
            print(f"{r.config}: {r.miss}")
    if args.no_gate:
        return PASSED
    own = table.select("lang").distinct().withColumns({"min_recall3": F.lit(args.min_recall3), "min_mrr": F.lit(args.min_mrr)})
    best = table.where(F.col("config").endswith(" + lang"))
    found = metrics.gate(best, own).collect()
    for r in found:
        print(f"{r.config}, {r.lang}: {r.violation}", file=sys.stderr)
    return BELOW if found else PASSED


if __name__ == "__main__":
    sys.exit(main())
