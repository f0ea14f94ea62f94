"""Reports from the command line: python -m weftlake.reports NAME ...

by-category  retrieval by the category of the first expected document, worst first, with the kinds and sources of errors
embed-compare  the semantic branch alone, with and without a least similarity, for questions with and without accents
p1-diff      questions that the semantic branch answers and the fusion does not, and how many of them synonyms explain
blind-sheet  items of labelled sheets in a seeded order under new names, labels kept from an earlier sheet
run-table    runs side by side, by judge and by human
judge-check  whether the judge may run: every item needs a human label

Exit codes: 0 done, 2 bad data, 3 vectors missing.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.functions.text import has_accents
from weftlake.operators import bm25, corpus, fusion, labels, metrics, synonyms, vectors
from weftlake.operators.prompts import ranking_line
from weftlake.session import durable, local_session
from weftlake.sources import files

DONE, BAD_DATA, NO_VECTORS = 0, 2, 3
K, CANDIDATES, LEAST = metrics.EVAL_K, 10, 0.55
LABEL_FIELDS = ["nhan_tay", "chac_chan", "ghi_chu"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="report", required=True)
    for name in ("by-category", "p1-diff", "embed-compare"):
        s = sub.add_parser(name)
        s.add_argument("--kb", required=True)
        s.add_argument("--golden", required=True)
        s.add_argument("--vectors", required=True, help="Parquet of (text, embedding array<float>)")
        s.add_argument("--synonyms")
        s.add_argument("--lang", help="only questions of this language")
    for name in ("blind-sheet", "run-table", "judge-check"):
        s = sub.add_parser(name)
        s.add_argument("--items", required=True, help="YAML sheets")
        if name == "blind-sheet":
            s.add_argument("--out", required=True)
            s.add_argument("--earlier", help="a sheet whose labels are kept")
            s.add_argument("--seed", type=int, default=16)
    return p


def branches(spark: SparkSession, args: argparse.Namespace) -> tuple | int:
    """(base, questions, rankings of all branches) of the questions in the chosen language, or an exit code.

    For embed-compare, instead of the rankings: (chunks with vectors, questions with vectors).
    """
    base = durable(files.load_knowledge_base(spark, args.kb))
    asked = files.load_questions(spark, args.golden).select(F.concat_ws("#", "file", "pos").alias("qid"), "query", "expected", "lang")
    asked = durable(asked.where(F.col("lang") == args.lang) if args.lang else asked)
    missing = corpus.missing_documents(asked, base)
    if not missing.isEmpty():
        print("not in the knowledge base:", ", ".join(r[0] for r in missing.orderBy("doc_id").limit(20).collect()), file=sys.stderr)
        return BAD_DATA
    index = bm25.build(base)
    scoped = bm25.resolve(asked, index.languages)
    keys = synonyms.table_of(spark, files.load_synonyms(args.synonyms)) if args.synonyms else None
    plain = bm25.search(index, scoped, CANDIDATES)
    lexical = plain if keys is None else bm25.search(index, synonyms.expand(scoped, keys), CANDIDATES, tokens=F.col("tokens"))
    stored = spark.read.parquet(args.vectors).select(F.col("text").alias("_text"), "embedding").dropDuplicates(["_text"])
    docs = base.withColumn("_text", bm25.embedding_text(F.col("title"), F.col("content"))).join(stored, "_text", "left")
    embedded = scoped.join(stored, scoped.query == stored["_text"], "left")
    if not docs.where("embedding IS NULL").isEmpty() or not embedded.where("embedding IS NULL").isEmpty():
        print("some texts have no vector", file=sys.stderr)
        return NO_VECTORS
    embedded = embedded.select("qid", "scope", F.col("embedding").alias("vector"))
    if args.report == "embed-compare":
        return base, asked, docs, embedded
    semantic = durable(vectors.search(docs, embedded, CANDIDATES, LEAST))
    metrics.require_hits(semantic, "the semantic branch")
    lexical = durable(lexical)
    return base, asked, {"semantic": semantic, "lexical": lexical, "plain": plain, "filled": durable(fusion.vector_fill(semantic, lexical, K)), "rrf": durable(fusion.rrf(semantic, lexical, K))}


def by_category(base: DataFrame, asked: DataFrame, runs: dict[str, DataFrame]) -> list[str]:
    names = {"BM25": runs["lexical"].where(F.col("rank") <= K), "Hybrid": runs["filled"]}
    hits = None
    for config, ranking in names.items():
        part = ranking.select(F.lit(config).alias("config"), "qid", "doc_id", "rank")
        hits = part if hits is None else hits.unionByName(part)
    judged = durable(metrics.judged(hits, asked, list(names)))
    of = base.select("doc_id", "category")
    category = asked.select("qid", F.element_at("expected", 1).alias("doc_id")).join(of, "doc_id", "left").select("qid", F.coalesce("category", F.lit("?")).alias("category"))
    table = metrics.evaluate_with_total(metrics.per_question(judged).join(category, "qid"), "category")
    lines = [f"{r.place:>3} {r.category:<16} {r.n:>5} {r.p1_base:>8.1%} {r.p1_best:>8.1%}" for r in metrics.worst_first(table, "category", "BM25", "Hybrid").orderBy("place").collect()]
    kinds = metrics.error_kinds(judged.where("config = 'Hybrid'"), of)
    lines += [f"{r.kind}: {r.n}" for r in kinds.orderBy("kind").collect()]
    return lines + [f"first hit from {r.source}: {r.n}" for r in metrics.hit_sources(asked, runs["filled"], runs["semantic"]).orderBy("source").collect()]


def p1_diff(asked: DataFrame, runs: dict[str, DataFrame]) -> list[str]:
    found = metrics.fusion_losses(asked, runs["semantic"], runs["lexical"], runs["plain"], runs["rrf"])
    lines = [f"{r.outcome}: {r.n}, wrong document in both branches: {r.in_both}, by synonyms: {r.by_synonym}" for r in found.orderBy("outcome").collect()]
    top = lambda df: df.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id")))["doc_id"].alias("docs"))
    both = asked.join(top(runs["semantic"].where(F.col("rank") <= K)), "qid").withColumnRenamed("docs", "sem").join(top(runs["rrf"]), "qid")
    lost = both.where(F.array_contains("expected", F.col("sem")[0]) & ~F.array_contains("expected", F.col("docs")[0]))
    return lines + [f"{r.query!r}\n  semantic: {r.a}\n  fused:    {r.b}" for r in lost.select("query", ranking_line(F.col("sem"), F.col("expected")).alias("a"), ranking_line(F.col("docs"), F.col("expected")).alias("b")).orderBy("query").collect()]


def embed_compare(base: DataFrame, asked: DataFrame, docs: DataFrame, embedded: DataFrame) -> list[str]:
    """Lines of the semantic branch's metrics by least similarity and by whether a question has accents."""
    hits, names = None, []
    for least in (LEAST, 0.0):
        found = durable(metrics.require_hits(vectors.search(docs, embedded, CANDIDATES, least), f"similarity {least}"))
        names.append(f"least {least:.2f}")
        part = found.where(F.col("rank") <= K).select(F.lit(names[-1]).alias("config"), "qid", "doc_id", "rank")
        hits = part if hits is None else hits.unionByName(part)
    kind = asked.select("qid", F.when(has_accents(F.col("query")), "accents").otherwise("plain").alias("kind"))
    per = metrics.per_question(metrics.judged(hits, asked, names)).join(kind, "qid")
    table = metrics.evaluate_with_total(per, "kind").withColumnRenamed("kind", "lang")
    return metrics.text_table(table)


def _sheet(spark: SparkSession, pattern: str) -> DataFrame:
    """(run, id, query, answer and labels) of sheets; the run is the name of the file."""
    items = files.split_meta(files.read_items(spark, pattern))[1]
    of = lambda name: F.coalesce(F.get_json_object("json", f"$.{name}"), F.lit("")).alias(name)
    return items.select(F.col("file").alias("run"), *(of(n) for n in ("id", "query", "tra_loi", "nhan_judge", *LABEL_FIELDS)))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    if args.report in ("by-category", "p1-diff", "embed-compare"):
        found = branches(spark, args)
        if isinstance(found, int):
            return found
        print("\n".join(by_category(*found) if args.report == "by-category" else embed_compare(*found) if args.report == "embed-compare" else p1_diff(*found[1:])))
        return DONE
    items = durable(_sheet(spark, args.items))
    if args.report == "judge-check":
        try:
            labels.require_labelled(items, "id", "nhan_tay")
        except ValueError as e:
            print(e, file=sys.stderr)
            return BAD_DATA
    elif args.report == "run-table":
        for r in labels.compare_runs(items, "run", "nhan_tay", "nhan_judge").orderBy("run").collect():
            print("  ".join(f"{k} {v}" for k, v in r.asDict().items()))
    else:
        fresh = items.select("id", "query", "tra_loi", *(F.lit("").alias(c) for c in LABEL_FIELDS))
        if args.earlier:
            earlier = _sheet(spark, args.earlier)
            corpus.require_known(earlier, fresh, "id")
            fresh = labels.merge_sheets(fresh, earlier, "id", LABEL_FIELDS)
        files.write_items(labels.shuffled(fresh, "id", args.seed, "c").orderBy("number").select("name", "query", "tra_loi", *LABEL_FIELDS, "id"), args.out, f"seed {args.seed}")
    return DONE


if __name__ == "__main__":
    sys.exit(main())
