"""Queries over the corpus: tokens, statistics, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.functions import text as T
from weftlake.operators import bm25
from weftlake.operators import corpus as C
from weftlake.session import table


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.current_chunks(table(spark, sf, "knowledge_chunks"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, query, expected, chunks, lang, nguon, loai): each item once; its language is that of its documents' names."""
    rows = table(spark, sf, "faithfulness").select("id", "query", "expected", "chunks", "nguon", "loai").distinct()
    name = F.coalesce(F.get("expected", F.lit(0)), F.get("chunks", F.lit(0)), F.lit(""))
    return rows.select(F.col("id").alias("qid"), "query", "expected", "chunks", T.case_lang(F.regexp_extract(name, "-(en|ja|zh)$", 1)).alias("lang"), "nguon", "loai")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """The questions of the searches: every item whose number is divisible by 50."""
    return questions(spark, sf).where("cast(substring(qid, 2) AS bigint) % 50 = 0")


def tokenize_docs(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.tokens_of(chunks(spark, sf)).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def tokenize_documents(spark: SparkSession, sf: str) -> DataFrame:
    """How many tokens the long texts have, by language."""
    docs = table(spark, sf, "documents").select("lang", F.size(T.tokenize(F.col("text"))).alias("n"))
    return docs.groupBy(T.normalise_lang(F.col("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"), F.max("n").cast("long").alias("longest"))


def term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.postings_of(bm25.tokens_of(chunks(spark, sf))).select("doc_id", "term", "tf")


def doc_length(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.tokens_of(chunks(spark, sf)).select("doc_id", F.col("dl").alias("length"))


def doc_frequency_by_scope(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.document_frequencies(bm25.postings_of(bm25.tokens_of(chunks(spark, sf))))


def corpus_stats_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.corpus_stats(bm25.tokens_of(chunks(spark, sf))).select("scope", "n", F.round("avgdl", 6).alias("avgdl"))


def languages_present(spark: SparkSession, sf: str) -> DataFrame:
    return C.languages(chunks(spark, sf))


def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return C.duplicate_ids(table(spark, sf, "knowledge_chunks"))


def qrels_missing(spark: SparkSession, sf: str) -> DataFrame:
    return C.missing_documents(questions(spark, sf), chunks(spark, sf))


def qrels_language(spark: SparkSession, sf: str) -> DataFrame:
    return C.language_conflicts(questions(spark, sf), chunks(spark, sf))


def near_dup_questions(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf)
    return C.folded_matches(q.where("nguon = 'holdout'"), q.where("nguon = 'golden'"), "qid", "query")


def substring_leak(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets of the feedback that stand verbatim in a knowledge chunk or in a question of `faithfulness`; messages are not searched."""
    needles = table(spark, sf, "chat_feedback").select(F.col("feedback_id").alias("nid"), F.col("question_snippet").alias("text"))
    return C.contained_in(needles, table(spark, sf, "knowledge_chunks").select(F.col("content").alias("text")).unionByName(table(spark, sf, "faithfulness").select(F.col("query").alias("text"))))


def verbatim_questions(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf)
    return q.join(chunks(spark, sf), q.query == F.col("content"), "left_semi").select("qid")


def accented_split(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf).where("query IS NOT NULL")
    return q.groupBy("lang", T.has_accents(F.col("query")).alias("accented")).agg(F.count(F.lit(1)).alias("n"))


def embedding_cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of the production copy to embed that the seed copy's cache has no vector for."""
    from weftlake.sources.cache import cache_key

    key = lambda df: df.select("doc_id", cache_key("vector-base", 768, bm25.embedding_text(F.col("title"), F.col("content"))).alias("key"))
    cached = key(C.current_chunks(table(spark, sf, "knowledge_chunks_seed")))
    return key(chunks(spark, sf)).join(cached.select("key").distinct(), "key", "left_anti").select("doc_id", "key")


QUERIES = {
    f.__name__: f
    for f in (tokenize_docs, tokenize_documents, term_frequency, doc_length, doc_frequency_by_scope, corpus_stats_by_lang, languages_present, duplicate_ids, qrels_missing, qrels_language, near_dup_questions, substring_leak, verbatim_questions, accented_split, embedding_cache_misses)
}


def _chunks(name: str) -> str:
    return (
        f"SELECT {T.sql_strip('doc_id')} AS doc_id, chunk_id AS ord, title, content, category, {T.sql_lang('lang')} AS lang FROM {name} WHERE doc_id IS NOT NULL AND {T.sql_strip('doc_id')} <> '' "
        f"QUALIFY row_number() OVER (PARTITION BY {T.sql_strip('doc_id')} ORDER BY chunk_id DESC) = 1"
    )


CHUNKS_SQL = f"corpus AS (SELECT * FROM ({_chunks('knowledge_chunks')}) WHERE NOT regexp_full_match(coalesce(content, ''), '{T.SQL_WHITE}*'))"
TOKENS_SQL = f"{CHUNKS_SQL}, tok AS (SELECT ord, doc_id, lang, {T.sql_tokens(chr(40) + 'coalesce(title, ' + repr('') + ') || ' + repr(' ') + ' || content)')} AS tokens FROM corpus), lens AS (SELECT ord, doc_id, lang, tokens, len(tokens) AS dl FROM tok)"
POSTINGS_SQL = f"{TOKENS_SQL}, post AS (SELECT ord, doc_id, lang, dl, term, count(*) AS tf FROM (SELECT ord, doc_id, lang, dl, unnest(tokens) AS term FROM lens) GROUP BY ALL)"
STATS_SQL = f"{POSTINGS_SQL}, scopes AS (SELECT '*' AS scope, count(*) AS n, avg(dl) AS avgdl FROM lens UNION ALL SELECT lang, count(*), avg(dl) FROM lens WHERE lang IS NOT NULL GROUP BY lang), dfs AS (SELECT '*' AS scope, term, count(*) AS df FROM post GROUP BY term UNION ALL SELECT lang, term, count(*) FROM post WHERE lang IS NOT NULL GROUP BY lang, term)"
QUESTIONS_SQL = (
    "q AS (SELECT id AS qid, query, expected, chunks, coalesce(nullif(regexp_extract(coalesce(expected[1], chunks[1], ''), '-(en|ja|zh)$', 1), ''), 'vi') AS lang, nguon, loai "
    "FROM (SELECT DISTINCT id, query, expected, chunks, nguon, loai FROM faithfulness))"
)
ASKED_SQL = f"{QUESTIONS_SQL}, asked AS (SELECT * FROM q WHERE CAST(substring(qid, 2) AS BIGINT) % 50 = 0)"
_EMBED = "CASE WHEN trim(coalesce(title, ''), ' ') <> '' THEN title || '. ' || content ELSE content END"
_KEY = f"sha256('vector-base' || chr(0) || '768' || chr(0) || ({_EMBED}))"

SQL = {
    "tokenize_docs": f"WITH {TOKENS_SQL} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM lens",
    "tokenize_documents": f"WITH d AS (SELECT {T.sql_lang('lang')} AS lang, len({T.sql_tokens('text')}) AS n FROM documents) SELECT lang, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, max(n) AS longest FROM d GROUP BY lang",
    "term_frequency": f"WITH {POSTINGS_SQL} SELECT doc_id, term, tf FROM post",
    "doc_length": f"WITH {TOKENS_SQL} SELECT doc_id, dl AS length FROM lens",
    "doc_frequency_by_scope": f"WITH {STATS_SQL} SELECT scope, term, df FROM dfs",
    "corpus_stats_by_lang": f"WITH {STATS_SQL} SELECT scope, n, round(avgdl, 6) AS avgdl FROM scopes",
    "languages_present": f"WITH {CHUNKS_SQL} SELECT DISTINCT lang FROM corpus WHERE lang IS NOT NULL",
    "duplicate_ids": "SELECT doc_id, count(*) AS n FROM knowledge_chunks GROUP BY doc_id HAVING count(*) > 1",
    "qrels_missing": f"WITH {CHUNKS_SQL}, {QUESTIONS_SQL} SELECT DISTINCT doc_id FROM (SELECT unnest(expected) AS doc_id FROM q) WHERE doc_id NOT IN (SELECT doc_id FROM corpus)",
    "qrels_language": f"WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, w AS (SELECT qid, lang AS asked, unnest(expected) AS doc_id FROM q) SELECT DISTINCT qid, doc_id FROM w JOIN corpus USING (doc_id) WHERE asked <> lang",
    "near_dup_questions": f"WITH {QUESTIONS_SQL} SELECT qid FROM q WHERE nguon = 'holdout' AND {T.sql_normalise('trim(query)')} IN (SELECT {T.sql_normalise('trim(query)')} FROM q WHERE nguon = 'golden')",
    "substring_leak": f"WITH h AS (SELECT DISTINCT content AS t FROM knowledge_chunks WHERE content IS NOT NULL UNION SELECT DISTINCT query FROM faithfulness WHERE query IS NOT NULL) SELECT DISTINCT feedback_id AS nid FROM chat_feedback WHERE NOT regexp_full_match(coalesce(question_snippet, ''), '{T.SQL_WHITE}*') AND EXISTS (SELECT 1 FROM h WHERE contains(t, question_snippet))",
    "verbatim_questions": f"WITH {CHUNKS_SQL}, {QUESTIONS_SQL} SELECT qid FROM q WHERE query IN (SELECT content FROM corpus)",
    "accented_split": f"WITH {QUESTIONS_SQL} SELECT lang, {T.sql_normalise('query')} <> lower(query) AS accented, count(*) AS n FROM q WHERE query IS NOT NULL GROUP BY ALL",
    "embedding_cache_misses": f"WITH {CHUNKS_SQL}, seed AS (SELECT * FROM ({_chunks('knowledge_chunks_seed')}) WHERE NOT regexp_full_match(coalesce(content, ''), '{T.SQL_WHITE}*')) SELECT doc_id, {_KEY} AS key FROM corpus WHERE {_KEY} NOT IN (SELECT {_KEY} FROM seed)",
}
