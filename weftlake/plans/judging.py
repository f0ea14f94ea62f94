"""Queries over judgements, chat logs and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.functions import text as T
from weftlake.operators import labels as L
from weftlake.operators import prompts
from weftlake.plans.corpus import CHUNKS_SQL, QUESTIONS_SQL, chunks, questions
from weftlake.session import stripped, table

QS = {"p50": 0.5, "p95": 0.95}
QUOTA = {"co_tai_lieu": 40, "mo_ho": 3, "gia_ve": 3}
TEMPLATE = "Now: {{now}}. Language: {{lang}}.\n{{context}}"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Each judged item once, with plain labels."""
    rows = table(spark, sf, "faithfulness").distinct()
    return rows.withColumns({"human": L.plain_label(F.col("nhan_tay")), "judge": L.plain_label(F.col("nhan_judge"))})


def agreement(spark: SparkSession, sf: str) -> DataFrame:
    return L.agreement(_items(spark, sf))


def agreement_by_rubric(spark: SparkSession, sf: str) -> DataFrame:
    return L.judge_gate(L.agreement(_items(spark, sf), keys=["rubric"]))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return L.confusion(_items(spark, sf))


def caught_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Of the answers a human calls fabricated, by kind of question, how many the judge calls so."""
    fake = _items(spark, sf).where(F.col("human") == L.FAKE)
    return fake.groupBy("loai").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("judge") == L.FAKE).alias("caught"))


def run_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Judge runs side by side, with the human labels of the items they judged."""
    human = _items(spark, sf).groupBy("id").agg(F.max("human").alias("human"))
    runs = table(spark, sf, "judge_runs").distinct().join(human, "id", "left")
    return L.compare_runs(runs, "judge", "human", "nhan_judge")


def caught_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """As `caught_by_kind`, by an answer key: a kind for the items that a human calls fabricated."""
    key = _items(spark, sf).where(F.col("human") == L.FAKE).select("id", "nguon")
    runs = table(spark, sf, "judge_runs").distinct().select("id", L.plain_label(F.col("nhan_judge")).alias("judge"))
    return L.caught_by_key(runs, key, "id", "nguon", "judge")


def judge_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Items that a judge may not see yet, as no human has labelled them."""
    return L.unlabelled(table(spark, sf, "faithfulness").distinct(), "id", "nhan_tay").distinct()


def drifted_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose text in the production copy is no longer that of the seed copy."""
    from weftlake.operators.corpus import current_chunks

    return L.drifted(chunks(spark, sf), current_chunks(table(spark, sf, "knowledge_chunks_seed")), "doc_id", "content")


def pending_review(spark: SparkSession, sf: str) -> DataFrame:
    """Items that still lack a human label, with the titles of their chunks in order."""
    waiting = _items(spark, sf).where("human IS NULL").select("id", F.posexplode_outer("chunks").alias("pos", "doc_id"))
    named = waiting.join(chunks(spark, sf).select("doc_id", "title"), "doc_id", "left")
    return named.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("title", F.lit("?")).alias("title")))), lambda x: x["title"]), " | ").alias("titles"))


def percentile_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return L.nearest_rank(_metrics(spark, sf), ["lang"], "latency_ms", QS)


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "chat_turn_metrics").distinct()
    return rows.withColumns({"lang": T.normalise_lang(F.col("lang")), "outcome": F.nullif(F.lower(stripped(F.col("outcome"))), F.lit("")), "latency_ms": F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))})


def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Median (mean of the middle two), nearest-rank p95 and maximum of the event values by type."""
    e = table(spark, sf, "events").where("value IS NOT NULL")
    middle = {"low": lambda n: F.ceil(n / 2), "high": lambda n: F.floor(n / 2) + 1}
    found = L.at_ranks(e, ["event_type"], "value", {**middle, "p95": lambda n: F.bround(F.lit(0.95) * n), "longest": lambda n: n})
    return found.select("event_type", "n", F.round((F.col("low") + F.col("high")) / 2, 6).alias("p50"), "p95", "longest")


def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Shortest, upper median and longest user message in characters, by language."""
    rows = table(spark, sf, "chat_messages").distinct().where(F.lower(stripped(F.col("role"))).isin("user", "human") & F.col("content").isNotNull())
    chars = rows.select(T.normalise_lang(F.col("lang")).alias("lang"), F.length("content").cast("long").alias("chars"))
    return L.at_ranks(chars, ["lang"], "chars", {"shortest": lambda n: F.lit(1), "median": lambda n: F.floor(n / 2) + 1, "longest": lambda n: n})


def chat_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Messages, sessions and days by speaker, with a total."""
    rows = table(spark, sf, "chat_messages").distinct().withColumn("speaker", F.coalesce(F.nullif(F.lower(stripped(F.col("role"))), F.lit("")), F.lit("?")))
    found = rows.rollup("speaker").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("session_id").alias("sessions"), F.min(F.to_date("created_at")).cast("string").alias("first_day"), F.max(F.to_date("created_at")).cast("string").alias("last_day"), F.grouping("speaker").alias("g"))
    return found.select(F.when(F.col("g") == 1, "all").otherwise(F.col("speaker")).alias("speaker"), "messages", "sessions", "first_day", "last_day")


def user_questions(spark: SparkSession, sf: str) -> DataFrame:
    """User messages by language."""
    rows = table(spark, sf, "chat_messages").distinct().where(F.lower(stripped(F.col("role"))).isin("user", "human"))
    return rows.groupBy(T.normalise_lang(F.col("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Median (nearest rank) answer characters a second by language."""
    rows = _metrics(spark, sf).select("lang", F.round(L.throughput(F.col("answer_chars"), F.col("latency_ms")), 6).alias("rate"))
    return L.nearest_rank(rows, ["lang"], "rate", {"p50": 0.5})


def feedback_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings and reasons of the feedback, and how many lead to a message."""
    rows = table(spark, sf, "chat_feedback").distinct()
    refs = table(spark, sf, "chat_messages").where("message_ref IS NOT NULL").select("message_ref").distinct().withColumn("known", F.lit(True))
    return rows.join(refs, "message_ref", "left").groupBy("rating").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("with_message"))


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return L.stratified_sample(questions(spark, sf), "loai", "qid", QUOTA, 15).select("qid", "loai")


def blind_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """The items in a seeded order under padded names."""
    return L.shuffled(questions(spark, sf).select("qid"), "qid", 16, "c", 4).select("name", "qid")


def blind_sheet_names(spark: SparkSession, sf: str) -> DataFrame:
    """The names that `blind_sheet` gives, with how often each stands, and how many items have one."""
    sheet = blind_sheet(spark, sf)
    return sheet.groupBy("name").agg(F.count("qid").alias("n"))


def blind_sheet_items(spark: SparkSession, sf: str) -> DataFrame:
    return blind_sheet(spark, sf).groupBy("qid").agg(F.count("name").alias("n"))


def sample_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """How many items of each stratum `stratified_sample` draws, all of them different."""
    return stratified_sample(spark, sf).groupBy("loai").agg(F.count_distinct("qid").alias("n"))


def relabel_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A fresh sheet with the labels of the sheet before it."""
    new = questions(spark, sf).select(F.col("qid").alias("id"), *(F.lit("").alias(c) for c in ("nhan_tay", "ghi_chu")))
    old = table(spark, sf, "faithfulness").select("id", "nhan_tay", "ghi_chu").distinct()
    return L.merge_sheets(new, old, "id", ["nhan_tay", "ghi_chu"])


def label_override(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    return items.where("judge IS NOT NULL").select("id", L.override(F.col("nhan_tay"), F.col("judge")).alias("nhan"))


def unused_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items that no annotator has drawn yet."""
    drawn = table(spark, sf, "relabel_sheets").select("id").distinct()
    return questions(spark, sf).select(F.col("qid").alias("id")).join(drawn, "id", "left_anti")


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf).select("qid", F.posexplode("chunks").alias("rank", "doc_id"))
    return prompts.context_of(q.join(chunks(spark, sf), "doc_id"))


def rag_context(spark: SparkSession, sf: str) -> DataFrame:
    return _contexts(spark, sf)


def prompt_render(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf).join(_contexts(spark, sf), "qid", "left")
    return q.select("qid", prompts.system_prompt(TEMPLATE, F.lit("2021-01-20"), F.col("lang"), F.col("context")).alias("prompt"))


def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "faithfulness").select(F.col("id").alias("qid"), "query", "tra_loi").distinct().where("query IS NOT NULL")
    return items.join(_contexts(spark, sf), "qid", "left").select("qid", prompts.judge_prompt(F.col("query"), F.col("context"), F.col("tra_loi")).alias("prompt"))


def parse_label(spark: SparkSession, sf: str) -> DataFrame:
    """What is read from replies such as a judge gives: fenced JSON of the label and its reason."""
    items = _items(spark, sf).where("nhan_judge IS NOT NULL")
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("nhan_judge").alias("nhan"), F.coalesce("ly_do_judge", F.lit("")).alias("ly_do"))), F.lit("\n```"))
    return items.select("id", L.parse_label(reply).alias("p")).select("id", "p.label", "p.reason", "p.error")


def first_correct_rank(spark: SparkSession, sf: str) -> DataFrame:
    """How often a correct chunk is among the recorded ones, by its rank."""
    q = questions(spark, sf).where("size(expected) > 0").select("qid", "expected", F.posexplode_outer("chunks").alias("pos", "doc_id"))
    found = q.groupBy("qid").agg(F.min(F.when(F.array_contains("expected", F.col("doc_id")), F.col("pos") + 1)).cast("long").alias("rank"))
    return found.groupBy(F.coalesce("rank", F.lit(99)).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        agreement, agreement_by_rubric, confusion_matrix, caught_by_kind, run_compare, pending_review, percentile_nearest_rank, latency_summary, length_stats, chat_stats, user_questions, throughput, feedback_ratings,
        stratified_sample, sample_sizes, blind_sheet, blind_sheet_names, blind_sheet_items, relabel_merge, caught_by_key, judge_guard, drifted_questions, label_override, unused_items, rag_context, prompt_render, judge_prompts, parse_label, first_correct_rank,
    )
}


def _label(c: str) -> str:
    x = f"regexp_replace({T.sql_strip(f'lower({c})')}, '[-\\s\\x{{00A0}}\\x{{3000}}]+', '_', 'g')"
    return f"CASE WHEN {x} IN ('co_can_cu', 'bia', 'tu_choi_dung', 'tu_choi_thua') THEN {x} END"


_ITEMS = f"i AS (SELECT *, {_label('nhan_tay')} AS human, {_label('nhan_judge')} AS judge FROM (SELECT DISTINCT * FROM faithfulness))"
_AGREE = "count(*) AS n, count(*) FILTER (WHERE human = judge) AS exact, count(*) FILTER (WHERE (human = 'bia') = (judge = 'bia')) AS bia_match, count(*) FILTER (WHERE human = 'bia') AS bia_human, count(*) FILTER (WHERE human = 'bia' AND judge = 'bia') AS bia_caught, count(*) FILTER (WHERE human <> 'bia' AND judge = 'bia') AS bia_false FROM i WHERE human IS NOT NULL AND judge IS NOT NULL"
_N = "(SELECT unnest(['co_can_cu', 'bia', 'tu_choi_dung', 'tu_choi_thua']) AS human)"
_METRICS = f"m AS (SELECT * REPLACE ({T.sql_lang('lang')} AS lang, CASE WHEN latency_ms >= 0 THEN latency_ms END AS latency_ms) FROM (SELECT DISTINCT * FROM chat_turn_metrics))"
_CTX = "ctx AS (SELECT qid, string_agg('- ' || CASE WHEN regexp_full_match(coalesce(title, ''), '\\s*') THEN '' ELSE title || ': ' END || coalesce(content, '') || chr(10), '' ORDER BY rank) AS context FROM (SELECT qid, unnest(chunks) AS doc_id, unnest(range(len(chunks))) AS rank FROM q) JOIN corpus USING (doc_id) GROUP BY qid)"


def _nearest(value: str, source: str, keys: str, qs: dict[str, float]) -> str:
    r = ", ".join(f"list_sort(l)[CAST(greatest(1, least(n, round_even({q} * n, 0))) AS BIGINT)] AS {name}" for name, q in qs.items())
    return f"SELECT {keys}, n, {r} FROM (SELECT {keys}, count(*) AS n, list({value}) AS l FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys})"


_USER = f"u AS (SELECT *, {T.sql_lang('lang')} AS l FROM (SELECT DISTINCT * FROM chat_messages) WHERE lower({T.sql_strip('role')}) IN ('user', 'human'))"

SQL = {
    "agreement": f"WITH {_ITEMS} SELECT {_AGREE}",
    "agreement_by_rubric": f"WITH {_ITEMS} SELECT *, bia_human - bia_caught <= 1 AND bia_false <= 1 AND exact >= 0.8 * n AS passes FROM (SELECT rubric, {_AGREE} GROUP BY rubric)",
    "confusion_matrix": f"WITH {_ITEMS} SELECT k.human, " + ", ".join(f"count(*) FILTER (WHERE judge = '{x}') AS {x}" for x in L.LABELS) + f" FROM {_N} k LEFT JOIN i ON i.human = k.human GROUP BY k.human",
    "caught_by_kind": f"WITH {_ITEMS} SELECT loai, count(*) AS total, count(*) FILTER (WHERE judge = 'bia') AS caught FROM i WHERE human = 'bia' GROUP BY loai",
    "run_compare": f"WITH {_ITEMS}, h AS (SELECT id, max(human) AS human FROM i GROUP BY id), r AS (SELECT judge, {_label('nhan_judge')} AS j, human FROM (SELECT DISTINCT * FROM judge_runs) LEFT JOIN h USING (id)) SELECT judge AS run, count(*) AS answers, count(j) AS judged, CASE WHEN count(j) > 0 THEN count(*) FILTER (WHERE j = 'bia') END AS fake_judge, count(*) FILTER (WHERE human IS NULL) AS pending, count(*) FILTER (WHERE human = 'bia') AS fake_human, " + ", ".join(f"CASE WHEN count(j) > 0 THEN count(*) FILTER (WHERE j = '{x}') END AS {x}" for x in L.LABELS if x != "bia") + ", CASE WHEN count(j) > 0 THEN 'judged' ELSE 'not judged' END AS state FROM r GROUP BY judge",
    "caught_by_key": f"WITH {_ITEMS}, k AS (SELECT DISTINCT id, nguon FROM i WHERE human = 'bia' AND nguon IS NOT NULL) SELECT nguon, count(*) AS total, count(*) FILTER (WHERE {_label('nhan_judge')} = 'bia') AS caught FROM (SELECT DISTINCT * FROM judge_runs) JOIN k USING (id) GROUP BY nguon",
    "judge_guard": f"WITH {_ITEMS} SELECT DISTINCT id FROM i WHERE human IS NULL",
    "drifted_questions": f"WITH {CHUNKS_SQL}, {CHUNKS_SQL.replace('corpus AS', 'seed AS', 1).replace('FROM knowledge_chunks ', 'FROM knowledge_chunks_seed ')} SELECT c.doc_id FROM corpus c JOIN seed s ON s.doc_id = c.doc_id WHERE c.content IS DISTINCT FROM s.content",
    "blind_sheet_names": f"WITH {QUESTIONS_SQL}, m AS (SELECT count(*) AS n FROM q) SELECT 'c' || CASE WHEN i < 10000 THEN lpad(CAST(i AS VARCHAR), 4, '0') ELSE CAST(i AS VARCHAR) END AS name, 1 AS n FROM (SELECT unnest(range(1, n + 1)) AS i FROM m)",
    "blind_sheet_items": f"WITH {QUESTIONS_SQL} SELECT qid, count(*) AS n FROM q GROUP BY qid",
    "sample_sizes": f"WITH {QUESTIONS_SQL} SELECT loai, least(count(DISTINCT qid), CASE loai WHEN 'co_tai_lieu' THEN 40 ELSE 3 END) AS n FROM q WHERE loai IN ('co_tai_lieu', 'mo_ho', 'gia_ve') GROUP BY loai",
    "pending_review": f"WITH {CHUNKS_SQL}, {_ITEMS}, w AS (SELECT id, unnest(CASE WHEN len(chunks) > 0 THEN chunks ELSE [NULL] END) AS doc_id, unnest(range(greatest(len(chunks), 1))) AS pos FROM i WHERE human IS NULL) SELECT id, string_agg(coalesce(title, '?'), ' | ' ORDER BY pos) AS titles FROM w LEFT JOIN corpus USING (doc_id) GROUP BY id",
    "percentile_nearest_rank": f"WITH {_METRICS} " + _nearest("latency_ms", "m", "lang", QS),
    "latency_summary": "WITH p AS (" + _nearest("value", "events", "event_type", {"p95": 0.95}) + "), d AS (SELECT event_type, round(median(value), 6) AS p50, max(value) AS longest FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, n, p50, p95, longest FROM p JOIN d USING (event_type)",
    "length_stats": f"WITH {_USER} SELECT l AS lang, n, s[1] AS shortest, s[n // 2 + 1] AS median, s[n] AS longest FROM (SELECT l, count(*) AS n, list_sort(list(length(content))) AS s FROM u WHERE content IS NOT NULL GROUP BY l)",
    "chat_stats": f"WITH c AS (SELECT *, coalesce(nullif(lower({T.sql_strip('role')}), ''), '?') AS s FROM (SELECT DISTINCT * FROM chat_messages)) SELECT CASE WHEN grouping(s) = 1 THEN 'all' ELSE s END AS speaker, count(*) AS messages, count(DISTINCT session_id) AS sessions, CAST(min(CAST(created_at AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(created_at AS DATE)) AS VARCHAR) AS last_day FROM c GROUP BY ROLLUP (s)",
    "user_questions": f"WITH {_USER} SELECT l AS lang, count(*) AS n FROM u GROUP BY l",
    "throughput": f"WITH {_METRICS}, t AS (SELECT lang, round(answer_chars / (latency_ms / 1000.0), 6) AS rate FROM m WHERE answer_chars > 0 AND latency_ms > 0) " + _nearest("rate", "t", "lang", {"p50": 0.5}),
    "feedback_ratings": "WITH f AS (SELECT DISTINCT * FROM chat_feedback), r AS (SELECT DISTINCT message_ref, true AS known FROM chat_messages WHERE message_ref IS NOT NULL) SELECT rating, count(*) AS n, count(known) AS with_message FROM f LEFT JOIN r USING (message_ref) GROUP BY rating",
    "relabel_merge": "SELECT f.id, CASE WHEN trim(coalesce(nhan_tay, ''), ' ') <> '' OR trim(coalesce(ghi_chu, ''), ' ') <> '' THEN nhan_tay ELSE '' END AS nhan_tay, CASE WHEN trim(coalesce(nhan_tay, ''), ' ') <> '' OR trim(coalesce(ghi_chu, ''), ' ') <> '' THEN ghi_chu ELSE '' END AS ghi_chu FROM (SELECT DISTINCT id, nhan_tay, ghi_chu FROM faithfulness) f",
    "label_override": f"WITH {_ITEMS} SELECT id, CASE WHEN judge <> 'bia' THEN judge WHEN human IS NOT NULL THEN nhan_tay ELSE '' END AS nhan FROM i WHERE judge IS NOT NULL",
    "unused_items": f"WITH {QUESTIONS_SQL} SELECT qid AS id FROM q WHERE qid NOT IN (SELECT id FROM relabel_sheets WHERE id IS NOT NULL)",
    "rag_context": f"WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, {_CTX} SELECT qid, context FROM ctx",
    "prompt_render": f"WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, {_CTX} SELECT qid, 'Now: 2021-01-20. Language: ' || lang || '.' || chr(10) || coalesce(context, '{prompts.NO_CONTEXT}') AS prompt FROM q LEFT JOIN ctx USING (qid)",
    "judge_prompts": f"WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, {_CTX} SELECT a.id AS qid, 'QUESTION:' || chr(10) || a.query || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || coalesce(context, '{prompts.NO_JUDGE_CONTEXT}') || chr(10) || chr(10) || 'ANSWER:' || chr(10) || coalesce(a.tra_loi, '') AS prompt FROM (SELECT DISTINCT id, query, tra_loi FROM faithfulness WHERE query IS NOT NULL) a LEFT JOIN ctx ON ctx.qid = a.id",
    "parse_label": f"WITH {_ITEMS}, p AS (SELECT id, ly_do_judge, lower(trim(nhan_judge, ' ')) AS l FROM i WHERE nhan_judge IS NOT NULL) SELECT id, CASE WHEN l IN ('co_can_cu', 'bia', 'tu_choi_dung', 'tu_choi_thua') THEN l END AS label, CASE WHEN l IN ('co_can_cu', 'bia', 'tu_choi_dung', 'tu_choi_thua') THEN coalesce(ly_do_judge, '') END AS reason, CASE WHEN l NOT IN ('co_can_cu', 'bia', 'tu_choi_dung', 'tu_choi_thua') THEN 'unknown label' END AS error FROM p",
    "first_correct_rank": f"WITH {QUESTIONS_SQL}, x AS (SELECT qid, expected, chunks FROM q WHERE len(expected) > 0), r AS (SELECT qid, list_min(list_filter(range(1, coalesce(len(chunks), 0) + 1), lambda p: list_contains(expected, chunks[p]))) AS rank FROM x) SELECT coalesce(rank, 99) AS rank, count(*) AS n FROM r GROUP BY ALL",
}
