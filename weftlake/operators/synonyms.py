"""Query expansion by synonym tables.

A key matches in one of three ways: a CJK key as part of the compatibility-normalised question, a key with accents as
whole words of the lower-cased question, any other key as whole tokens. Instead of comparing every question with every
key, keys are joined by an anchor that a matching question must hold: a token, a word or a character pair of the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlake.functions import text as T
from weftlake.operators.bm25 import ALL
from weftlake.session import broadcast_if_small

SCHEMA = "lang string, ord int, key string, synonyms array<string>"


def table_of(spark: SparkSession, tables: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """Nested tables (language -> key -> synonyms) as rows; keys and synonyms must be strings."""
    rows = []
    for lang, entries in tables.items():
        for key, values in entries.items():
            if not isinstance(key, str) or not all(isinstance(v, str) for v in values):
                raise TypeError(f"{lang}: key and synonyms must be strings: {key!r}")
            rows.append((lang.strip().lower(), len(rows), key, list(values)))
    return spark.createDataFrame(rows, SCHEMA)


def _anchored(keys: DataFrame) -> DataFrame:
    """Keys with how they match, what must be found, and the anchor of the join."""
    accented = T.remove_accents(F.col("key")) != F.col("key")
    kind = F.when(T.contains_cjk(F.col("key")), "cjk").when(accented, "accented").otherwise("plain")
    words = F.split(F.col("key"), " ")
    grams = T.cjk_bigrams(F.col("key"))
    anchor = F.when(kind == "cjk", F.substring(F.element_at(grams, 1), 1, 1)).otherwise(F.element_at(words, 1))
    return keys.withColumn("kind", kind).withColumn("anchor", anchor)


def matched(questions: DataFrame, keys: DataFrame) -> DataFrame:
    """(qid, ord, key, synonyms) of the keys that match each question (qid, query, scope).

    A question whose scope has a table of its own uses that table only, others use all.
    """
    own = keys.select(F.col("lang").alias("scope")).distinct().withColumn("own", F.lit(True))
    q = questions.select("qid", "query", "scope").join(broadcast_if_small(own), "scope", "left")
    query = F.coalesce(F.col("query"), F.lit(""))
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    words = F.regexp_extract_all(T.composed(F.lower(query)), F.lit(r"([\p{L}\p{N}\p{M}]+)"), 1)
    q = q.withColumns({"plain": padded(T.tokenize(query)), "accented": padded(words), "cjk": T.compatibility(query)})
    anchors = F.array_distinct(F.concat(F.transform(T.tokenize(query), lambda t: F.struct(F.lit("plain").alias("kind"), t.alias("anchor"))), F.transform(words, lambda t: F.struct(F.lit("accented").alias("kind"), t.alias("anchor"))), F.transform(F.filter(F.split(F.col("cjk"), ""), lambda c: T.contains_cjk(c)), lambda t: F.struct(F.lit("cjk").alias("kind"), t.alias("anchor")))))
    q = q.withColumn("a", F.explode(anchors)).select("qid", "scope", "own", "plain", "accented", "cjk", "a.kind", "a.anchor")
    pairs = q.join(broadcast_if_small(_anchored(keys)), ["kind", "anchor"])
    in_reach = F.col("own").isNull() | (F.col("lang") == F.col("scope"))
    whole = F.concat(F.lit(" "), F.col("key"), F.lit(" "))
    fits = F.when(F.col("kind") == "cjk", F.contains("cjk", "key")).when(F.col("kind") == "accented", F.contains("accented", whole)).otherwise(F.contains("plain", whole))
    return pairs.where(in_reach & fits).select("qid", "ord", "key", "synonyms").distinct()


def expand(questions: DataFrame, keys: DataFrame) -> DataFrame:
    """(qid, query, scope, tokens): the question's tokens, then those of matching synonyms in table order, each once."""
    order = F.array_sort(F.collect_list(F.struct("ord", F.flatten(F.transform("synonyms", T.tokenize)).alias("t"))))
    added = matched(questions, keys).groupBy("qid").agg(F.flatten(order["t"]).alias("added"))
    own = T.tokenize(F.col("query"))
    return questions.join(added, "qid", "left").withColumn("tokens", F.array_distinct(F.concat(own, F.coalesce("added", F.array().cast("array<string>"))))).drop("added")


def first_key(questions: DataFrame, keys: DataFrame) -> DataFrame:
    """(qid, key): which key pulled a question first, for diagnosis."""
    order = Window.partitionBy("qid").orderBy("ord")
    return matched(questions, keys).withColumn("_r", F.row_number().over(order)).where("_r = 1").select("qid", "key")
