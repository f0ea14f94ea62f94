"""Corpora, questions and their integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.functions import text as T
from weftlake.session import broadcast_if_small, durable, is_blank, stripped


def current_chunks(rows: DataFrame) -> DataFrame:
    """(ord, doc_id, title, content, category, lang): the latest version of each document that has content.

    Rows without a document id are left out; ids are compared without white space around them; of rows with one chunk_id
    the greatest counts. The language is normalised, blank as null.
    """
    fields = ["title", "content", "category", "lang"]
    named = rows.select(stripped(F.col("doc_id")).alias("doc_id"), F.col("chunk_id").alias("ord"), *fields).where("doc_id IS NOT NULL AND doc_id <> ''")
    latest = named.groupBy("doc_id").agg(F.max(F.struct("ord", *fields)).alias("r")).select("doc_id", "r.*").where(~is_blank(F.col("content")))
    return latest.select("ord", "doc_id", "title", "content", "category", T.normalise_lang(F.col("lang")).alias("lang"))


def duplicate_ids(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n) of ids that occur more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows, or an error that names one of the ids that occur more than once."""
    found = duplicate_ids(rows, key).orderBy(key).first()
    if found is not None:
        raise ValueError(f"duplicate {key}: {found[0]!r}")
    return rows


def missing_documents(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """(doc_id) that questions expect and the corpus lacks."""
    wanted = questions.select(F.explode("expected").alias("doc_id")).distinct()
    return wanted.join(corpus.select("doc_id"), "doc_id", "left_anti")


def language_conflicts(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, doc_id) where an expected document is in another language than the question."""
    wanted = questions.select("qid", F.col("lang").alias("asked"), F.explode("expected").alias("doc_id"))
    return wanted.join(corpus.select("doc_id", "lang"), "doc_id").where("asked <> lang").select("qid", "doc_id").distinct()


def folded_matches(some: DataFrame, others: DataFrame, key: str, text: str) -> DataFrame:
    """(key) of the rows whose text, without case and accents, occurs among the others."""
    return some.withColumn("_f", T.normalise(F.trim(text))).join(others.select(T.normalise(F.trim(text)).alias("_f")).distinct(), "_f", "left_semi").select(key)


def contained_in(needles: DataFrame, haystacks: DataFrame, size: int = 3) -> DataFrame:
    """(nid) of the needles (nid, text) that stand verbatim in some haystack (text).

    Instead of comparing each with each, a needle is joined by its rarest character n-gram, which any haystack that holds
    it must hold. Of the haystacks' n-grams only those that some needle has are counted and joined, as (gram, number of the
    text); texts come in again for the few pairs that are left, which are then compared. Needles shorter than the n-gram
    are looked up among the n-grams' beginnings, so none is lost. Blank needles are in no haystack; repeated texts are
    compared once; two texts that share a number only add a comparison.
    """
    texts = haystacks.where("text IS NOT NULL").select("text").distinct().withColumn("hid", F.xxhash64("text"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: F.substring(c, i, size)))
    wanted = needles.where(~is_blank(F.col("text"))).select(F.col("text").alias("needle")).distinct().withColumn("nhash", F.xxhash64("needle"))
    long, short = wanted.where(F.length("needle") >= size), wanted.where(F.length("needle") < size)
    own = durable(long.select("needle", "nhash", F.explode(grams(F.col("needle"))).alias("gram")).select("nhash", "gram").distinct())
    index = texts.select("hid", F.explode(grams(F.col("text"))).alias("gram"))
    counts = index.join(broadcast_if_small(own.select("gram").distinct(), 500_000), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(counts, "gram", "left").groupBy("nhash").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("r")).where("r.n > 0").select("nhash", F.col("r.gram").alias("gram"))
    pairs = index.join(broadcast_if_small(durable(rarest), 500_000), "gram").select("nhash", "hid").distinct()
    found = pairs.join(long, "nhash").join(texts, "hid").where(F.contains("text", "needle")).select("needle")
    heads = texts.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(size - 1)), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - i + 1, F.lit(1))), lambda j: F.substring("text", j, i))))).alias("needle"))
    brief = short.join(heads.join(broadcast_if_small(short.select("needle"), 500_000), "needle", "left_semi").distinct(), "needle", "left_semi").select("needle") if not short.isEmpty() else short.select("needle")
    return needles.join(found.unionByName(brief).distinct(), F.col("text") == F.col("needle"), "left_semi").select("nid").distinct()


def require_known(ids: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """ids, or an error that names one that is no item's."""
    unknown = ids.select(key).join(items.select(key), key, "left_anti").orderBy(key).first()
    if unknown is not None:
        raise ValueError(f"unknown {key}: {unknown[0]!r}")
    return ids


def languages(corpus: DataFrame) -> DataFrame:
    return corpus.where("lang IS NOT NULL").select("lang").distinct()
