"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlake.llm import abuse, consensus, consensus_features, conversations, language, packing, pairs, privacy, quantiles, tokens
from weftlake.session import durable, stripped, table

QS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
#: Labelled rows that the profiles of prompts and responses are fitted on.
PAIR_FIT_ROWS = 4000
METRIC_KEYS = ["lang", "outcome", "day"]
_WHITE_SQL = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


# Problem 2: conversations


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.dropped_sessions(table(spark, sf, "chat_messages"))


def p2_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.conversations(table(spark, sf, "chat_messages"))


def _pointers(spark: SparkSession, sf: str) -> DataFrame:
    """(message_id, up): each message once with a pointer to an earlier one, with orphans and cycles planted.

    The pointer is a rule of the number alone: every 97th message begins a thread, every 89th points to a message that is
    not there, and of each thousand, the numbers 11, 12 and 13 point at each other in a circle.
    """
    m = F.col("message_id")
    of_1000 = m % 1000
    up = F.when(of_1000.isin(12, 13), m - 1).when(of_1000 == 11, m + 2).when(m % 97 == 0, F.lit(None)).when(m % 89 == 0, -m).otherwise(m - m % 13 - 1)
    return table(spark, sf, "chat_messages").select("message_id").where("message_id IS NOT NULL").distinct().select("message_id", up.alias("up"))


def p2_threads(spark: SparkSession, sf: str) -> DataFrame:
    """The root, depth and state of every message in threads given by pointers."""
    return conversations.resolve_parents(_pointers(spark, sf), "message_id", "up").select("message_id", "root", F.col("offset").alias("depth"), "state")


# Told from the words of the problem alone: rows are walked in pairs (a row and the one after it), sessions are taken from
# all rows, and each rule is a question of its own.
_P2_SQL = (
    f"WITH plain AS (SELECT session_id, message_id, created_at, content, CASE lower(regexp_replace(role, '^{_WHITE_SQL}+|{_WHITE_SQL}+$', '', 'g')) WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'ai' THEN 'assistant' WHEN 'system' THEN 'system' ELSE '?' END AS speaker, "
    f"length(regexp_replace(coalesce(content, ''), '{_WHITE_SQL}', '', 'g')) > 0 AS says FROM (SELECT DISTINCT session_id, message_id, created_at, role, content FROM chat_messages) WHERE session_id IS NOT NULL), "
    "turns AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, message_id) AS position FROM plain WHERE speaker <> 'system'), "
    "sessions AS (SELECT DISTINCT session_id FROM plain), "
    "speaking AS (SELECT DISTINCT session_id FROM turns WHERE says), "
    "faulty AS (SELECT session_id FROM turns WHERE created_at IS NULL OR speaker = '?' UNION SELECT session_id FROM turns WHERE position = 1 AND speaker <> 'user' "
    "UNION SELECT a.session_id FROM turns a JOIN turns b ON b.session_id = a.session_id AND b.position = a.position + 1 WHERE a.speaker = 'assistant' AND b.speaker = 'assistant'), "
    "waiting AS (SELECT a.session_id FROM turns a LEFT JOIN turns b ON b.session_id = a.session_id AND b.position = a.position + 1 AND b.speaker = 'assistant' AND b.says WHERE a.speaker = 'user' AND b.session_id IS NULL), "
    "s AS (SELECT session_id, CASE WHEN session_id NOT IN (SELECT session_id FROM speaking) THEN 'empty' WHEN session_id IN (SELECT session_id FROM faulty) THEN 'broken' WHEN session_id IN (SELECT session_id FROM waiting) THEN 'no_reply' END AS defect FROM sessions) "
)
_P2_SQLS = {
    "p2_found": _P2_SQL + "SELECT session_id, defect FROM s WHERE defect IS NOT NULL",
    "p2_conversations": _P2_SQL + "SELECT session_id, position, speaker, content, message_id, created_at FROM turns WHERE session_id IN (SELECT session_id FROM s WHERE defect IS NULL)",
    "p2_threads": (
        "WITH RECURSIVE n AS (SELECT DISTINCT message_id AS id, CASE WHEN message_id % 1000 IN (12, 13) THEN message_id - 1 WHEN message_id % 1000 = 11 THEN message_id + 2 WHEN message_id % 97 = 0 THEN NULL WHEN message_id % 89 = 0 THEN -message_id ELSE message_id - message_id % 13 - 1 END AS up FROM chat_messages WHERE message_id IS NOT NULL), "
        "t AS (SELECT id, id AS root, 0::BIGINT AS depth, up IS NOT NULL AS orphan FROM n WHERE up IS NULL OR up NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, t.root, t.depth + 1, t.orphan FROM n JOIN t ON n.up = t.id) "
        "SELECT n.id AS message_id, t.root, t.depth, CASE WHEN t.id IS NULL THEN 'cycle' WHEN t.orphan THEN 'orphan' WHEN t.depth = 0 THEN 'root' ELSE 'child' END AS state FROM n LEFT JOIN t ON t.id = n.id"
    ),
}


# Problem 3: consensus


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None)
    items = table(spark, sf, "faithfulness").select("id", "nhan_tay", "nhan_judge")
    row = lambda rater, certainty, label, at, row: [F.col("id"), rater.alias("rater"), certainty.cast("string").alias("certainty"), consensus.plain_label(F.col(label)).alias("label"), at.cast("timestamp_ntz").alias("at"), row.cast("long").alias("row")]
    own = [items.select(row(F.lit(c), none, c, none, none)) for c in ("nhan_tay", "nhan_judge")]
    sheets = table(spark, sf, "relabel_sheets").select(row(F.concat(F.lit("cham:"), stripped(F.col("nguoi_cham"))), F.lower(stripped(F.col("chac_chan"))), "nhan_tay", F.col("cham_luc"), F.col("row_no")))
    judges = table(spark, sf, "judge_runs").select(row(F.concat(F.lit("judge:"), stripped(F.col("judge"))), none, "nhan_judge", F.col("chay_luc"), F.col("row_no")))
    return consensus.latest_votes(own[0].unionByName(own[1]).unionByName(sheets).unionByName(judges))


def _consensus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    features = consensus_features.of_answers(table(spark, sf, "faithfulness"))
    return consensus.consensus(_votes(spark, sf), features, consensus_features.WIDTH)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _consensus(spark, sf)[0].where("raters >= 3").select("id", F.col("label").alias("nhan"))


def p3_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return _consensus(spark, sf)[0].select("id", F.col("label").alias("nhan"), F.round("confidence", 4).alias("confidence"), "raters", F.round("agreement", 4).alias("agreement"))


def p3_raters(spark: SparkSession, sf: str) -> DataFrame:
    """How many raters each item has, and how far they agree."""
    return _consensus(spark, sf)[0].select("id", "raters", F.round("agreement", 4).alias("agreement"))


def p3_votes(spark: SparkSession, sf: str) -> DataFrame:
    """The votes that each rater's reliability rests on, and whether it is a probability."""
    return _consensus(spark, sf)[1].select("rater", "votes", F.col("reliability").between(0, 1).alias("probable"))


def p3_reliability(spark: SparkSession, sf: str) -> DataFrame:
    return _consensus(spark, sf)[1].select("rater", "votes", F.round("reliability", 4).alias("reliability"))


def p3_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.krippendorff(_votes(spark, sf))


def _label_sql(c: str) -> str:
    x = f"regexp_replace(regexp_replace(lower({c}), '^{_WHITE_SQL}+|{_WHITE_SQL}+$', '', 'g'), '[-\\s\\x{{00A0}}\\x{{3000}}]+', '_', 'g')"
    return f"CASE WHEN {x} IN ('co_can_cu', 'bia', 'tu_choi_dung', 'tu_choi_thua') THEN {x} END"


_P3_SQL = (
    f"WITH v AS (SELECT id, 'nhan_tay' AS rater, {_label_sql('nhan_tay')} AS label, NULL::TIMESTAMP AS t, NULL::BIGINT AS rn FROM faithfulness UNION ALL SELECT id, 'nhan_judge', {_label_sql('nhan_judge')}, NULL, NULL FROM faithfulness "
    f"UNION ALL SELECT id, 'cham:' || trim(nguoi_cham, ' '), {_label_sql('nhan_tay')}, cham_luc, row_no FROM relabel_sheets UNION ALL SELECT id, 'judge:' || trim(judge, ' '), {_label_sql('nhan_judge')}, chay_luc, row_no FROM judge_runs), "
    "l AS (SELECT id, rater, label FROM v WHERE id IS NOT NULL AND rater IS NOT NULL AND label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, rater ORDER BY coalesce(t, TIMESTAMP '0001-01-01') DESC, coalesce(rn, -1) DESC, label DESC) = 1), "
    "c AS (SELECT id, label, count(*) AS n FROM l GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY id) AS m FROM c QUALIFY m >= 2), "
    "i AS (SELECT id, max(m) AS m, sum(n * (n - 1)) AS same FROM s GROUP BY id), o AS (SELECT count(*) AS items, CAST(sum(m) AS BIGINT) AS votes, sum(m - same / (m - 1)) AS differ FROM i), e AS (SELECT sum(n) AS total, sum(n * (n - 1)) AS alike FROM (SELECT label, sum(n) AS n FROM s GROUP BY label)) "
    "SELECT items, votes, round(1 - differ / (total - alike / (total - 1)), 6) AS alpha FROM o, e"
)


# Problem 4: languages


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """(id struct<tbl, row_id>, content, lang) of messages other than the system's, and of chunks."""
    row = lambda tbl, key: F.struct(F.lit(tbl).alias("tbl"), F.col(key).alias("row_id"), F.col("lang").alias("label")).alias("id")
    spoken = F.coalesce(conversations.speaker_of(F.col("role")) != "system", F.lit(True))
    messages = table(spark, sf, "chat_messages").where(spoken).select(row("chat_messages", "message_id"), "content", "lang")
    chunks = table(spark, sf, "knowledge_chunks").select(row("knowledge_chunks", "chunk_id"), "content", "lang")
    return messages.unionByName(chunks)


def _profiles(spark: SparkSession, sf: str) -> language.Profiles:
    return language.fit_on_sample(table(spark, sf, "chat_messages"), "content", "lang")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    found = language.detect(_texts(spark, sf), "id", "content", _profiles(spark, sf))
    label = F.coalesce(F.lower(stripped(F.col("id.label"))), F.lit(""))
    cases = found.where((F.size("languages") > 0) & (F.col("mixed") | (label != F.col("languages")[0])))
    return cases.select("id.tbl", "id.row_id", F.explode("languages").alias("lang")).distinct()


def p4_segments(spark: SparkSession, sf: str) -> DataFrame:
    found = language.segment(_texts(spark, sf), "id", "content", _profiles(spark, sf))
    return found.select("id.tbl", "id.row_id", "segment", "lang", F.round("confidence", 4).alias("confidence"), "content").distinct()


def p4_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the segments of every text are numbered from 0 without a gap, neighbours differ, and confidences are such."""
    parts = p4_segments(spark, sf)
    order = Window.partitionBy("tbl", "row_id").orderBy("segment")  # the segments of one text
    judged = parts.withColumns({"place": F.row_number().over(order) - 1, "before": F.lag("lang").over(order)})
    fine = (F.col("place") == F.col("segment")) & ~F.col("before").eqNullSafe(F.col("lang")) & F.col("confidence").between(0, 1) & (F.length("content") > 0)
    return judged.groupBy("tbl").agg(F.bool_and(fine).alias("fine"))


# Problem 5: defective pairs


def _pair_profiles(spark: SparkSession, sf: str) -> language.Profiles:
    return language.fit_on_sample(table(spark, sf, "chat_messages"), "content", "lang", PAIR_FIT_ROWS)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defects(table(spark, sf, "faithfulness"), "id", "query", "tra_loi", _pair_profiles(spark, sf))


def p5_limits(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.limits(table(spark, sf, "faithfulness"), "id", "query", "tra_loi", _pair_profiles(spark, sf))


# Problem 6: personal data


def _written(spark: SparkSession, sf: str) -> DataFrame:
    messages = table(spark, sf, "chat_messages").select(F.lit("chat_messages").alias("tbl"), F.col("message_id").alias("row_id"), "content")
    snippets = table(spark, sf, "chat_feedback").select(F.lit("chat_feedback").alias("tbl"), F.col("feedback_id").alias("row_id"), F.col("question_snippet").alias("content"))
    return messages.unionByName(snippets)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.findings(_written(spark, sf)).select("tbl", "row_id", "kind", "val").distinct()


def p6_texts(spark: SparkSession, sf: str) -> DataFrame:
    texts = _written(spark, sf)
    return privacy.sanitise(texts, privacy.findings(texts))


def p6_checked(spark: SparkSession, sf: str) -> DataFrame:
    """How many texts there are by table, and how many of the sanitised ones are changed without a finding or the same with one."""
    texts = _written(spark, sf).distinct()
    found = durable(privacy.findings(texts))
    clean = privacy.sanitise(texts, found).select("tbl", "row_id", F.col("content").alias("clean"))
    touched = found.select("tbl", "row_id").distinct().withColumn("touched", F.lit(True))
    both = texts.join(clean, ["tbl", "row_id"]).join(touched, ["tbl", "row_id"], "left")
    wrong = F.col("content").eqNullSafe(F.col("clean")) == F.coalesce("touched", F.lit(False))
    return both.groupBy("tbl").agg(F.count(F.lit(1)).alias("texts"), F.count_if(wrong).alias("wrong"))


# Problem 7: percentiles of latencies


def _latencies(spark: SparkSession, sf: str) -> DataFrame:
    """Each delivered row once, with its group; a latency below 0 is impossible and no measurement."""
    plain = lambda c: F.nullif(F.lower(stripped(F.col(c))), F.lit(""))
    rows = table(spark, sf, "chat_turn_metrics").select("metric_id", "created_at", "lang", "outcome", "latency_ms").dropDuplicates()
    return rows.select(F.substring(plain("lang"), 1, 2).alias("lang"), plain("outcome").alias("outcome"), F.to_date("created_at").alias("day"), F.when(F.col("latency_ms") >= 0, F.col("latency_ms")).alias("latency_ms"))


def p7_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.summarise(_latencies(spark, sf), METRIC_KEYS, "latency_ms")


def p7_daily(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.percentiles(p7_summaries(spark, sf), METRIC_KEYS, QS)


def p7_overall(spark: SparkSession, sf: str) -> DataFrame:
    """Per language and outcome, from the summaries of the days."""
    keys = ["lang", "outcome"]
    return quantiles.percentiles(quantiles.merge_summaries(p7_summaries(spark, sf), keys), keys, QS)


def _verified(rows: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of every group, whether all rows count and each percentile lies within its stated error and within half a percent."""
    same = None
    for k in keys:
        found = found.withColumnRenamed(k, f"_{k}")
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = c if same is None else same & c
    counts = [F.count_if(F.col(value) < F.col(q)).alias(f"{q}_below") for q in QS] + [F.count_if(F.col(value) <= F.col(q)).alias(f"{q}_upto") for q in QS]
    judged = rows.where(F.col(value).isNotNull()).join(found, same).groupBy(*keys, "n", "rank_error", "error_bound").agg(*counts, F.count(F.lit(1)).alias("rows"))
    wanted = lambda p: F.greatest(F.lit(1), F.ceil(F.col("n") * p - 1e-9))
    worst = F.greatest(*[F.greatest(F.col(f"{q}_below") + 1 - wanted(p), wanted(p) - F.col(f"{q}_upto"), F.lit(0)) for q, p in QS.items()])
    within = (F.col("rows") == F.col("n")) & (worst <= F.col("rank_error")) & (F.col("rank_error") <= F.col("error_bound")) & (F.col("error_bound") <= quantiles.EPSILON * F.col("n") + 1)
    return judged.select(*(F.col(k).cast("string").alias(k) for k in keys), "n", within.alias("within"))


def p7_verified(spark: SparkSession, sf: str) -> DataFrame:
    return _verified(_latencies(spark, sf), p7_daily(spark, sf), METRIC_KEYS, "latency_ms")


def p7_overall_verified(spark: SparkSession, sf: str) -> DataFrame:
    return _verified(_latencies(spark, sf), p7_overall(spark, sf), ["lang", "outcome"], "latency_ms")


def p7_large_verified(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of very many different values, put together from summaries of months: the prices of `lineitem`."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.trunc("l_shipdate", "month").alias("month"), F.col("l_extendedprice").cast("double").alias("price"))
    parts = quantiles.summarise(rows, ["l_returnflag", "month"], "price")
    found = quantiles.percentiles(quantiles.merge_summaries(parts, ["l_returnflag"]), ["l_returnflag"], QS)
    return _verified(rows, found, ["l_returnflag"], "price")


_P7_SQL = (
    f"WITH r AS (SELECT DISTINCT metric_id, created_at, lang, outcome, latency_ms FROM chat_turn_metrics) SELECT nullif(left(lower(regexp_replace(lang, '^{_WHITE_SQL}+|{_WHITE_SQL}+$', '', 'g')), 2), '') AS lang, "
    f"nullif(lower(regexp_replace(outcome, '^{_WHITE_SQL}+|{_WHITE_SQL}+$', '', 'g')), '') AS outcome, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n, true AS within FROM r WHERE latency_ms >= 0 GROUP BY ALL"
)


# Problem 8: token ids


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


def p8_small_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the ids are the same when texts are split down to a few characters, so that the tree does all the work."""
    docs = table(spark, sf, "documents")
    small = tokens.encode_corpus(docs, "doc_id", "text", leaf=48).withColumnRenamed("ids", "small")
    whole = tokens.encode_corpus(docs, "doc_id", "text", leaf=1 << 40)
    return whole.join(small, "doc_id").select("doc_id", (F.col("ids") == F.col("small")).alias("same"))


def p8_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by whether their decoded ids give the text again (a null text decodes as empty)."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    back = tokens.decode_corpus(p8_ids(spark, sf), "doc_id").withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").groupBy((F.coalesce("text", F.lit("")) == F.col("back")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


# Problem 9: windows


def p9_windows(spark: SparkSession, sf: str) -> DataFrame:
    sizes = tokens.count_tokens(table(spark, sf, "documents"), "doc_id", "text")
    kinds = [r.capacity_tokens for r in table(spark, sf, "context_windows").select("capacity_tokens").distinct().collect()]
    return packing.pack(sizes, "doc_id", "tokens", kinds)


def p9_complete(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents are placed, how many of them not whole or cut without need, and how many windows are overfull."""
    placed = p9_windows(spark, sf)
    sizes = tokens.count_tokens(table(spark, sf, "documents"), "doc_id", "text")
    largest = table(spark, sf, "context_windows").agg(F.max("capacity_tokens")).first()[0]
    docs = placed.groupBy("doc_id").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("pieces")).join(sizes, "doc_id", "full")
    wrong = F.coalesce((F.col("held") != F.col("tokens")) | ((F.col("pieces") > 1) & (F.col("tokens") <= largest)), F.lit(True))
    over = placed.where("bin IS NOT NULL").groupBy("bin", "capacity").agg(F.sum("size").alias("held")).agg(F.count_if(F.col("held") > F.col("capacity")).alias("overfull"), F.lit(1).alias("one"))
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(wrong).alias("wrong"), F.lit(1).alias("one")).join(over, "one").drop("one")


def p9_gain(spark: SparkSession, sf: str) -> DataFrame:
    """Whether several capacities leave no more space unused than each of them alone would."""
    sizes = durable(tokens.count_tokens(table(spark, sf, "documents"), "doc_id", "text"))
    kinds = [r.capacity_tokens for r in table(spark, sf, "context_windows").select("capacity_tokens").distinct().collect()]
    found = packing.compare_plans(sizes, "tokens", kinds)
    return spark.createDataFrame([(int(k), found["joint"][1] <= v[1]) for k, v in found.items() if k != "joint"], "capacity int, no_worse boolean")


def p9_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The windows that hold documents, by whether they are of a known kind, the smallest that holds their contents."""
    windows = p9_windows(spark, sf).where("bin IS NOT NULL").groupBy("bin", "capacity", "used").agg(F.sum("size").alias("held"))
    kinds = sorted(r.capacity_tokens for r in table(spark, sf, "context_windows").select("capacity_tokens").distinct().collect())
    fits = F.coalesce(*[F.when(F.col("held") <= c, F.lit(c)) for c in kinds])
    return windows.agg(F.bool_and((F.col("capacity") == fits) & (F.col("held") == F.col("used"))).alias("smallest"), F.count_distinct("bin").alias("_n"), F.count(F.lit(1)).alias("_m")).select("smallest", (F.col("_n") == F.col("_m")).alias("one_kind_each"))


def p9_summary(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packing_summary(p9_windows(spark, sf))


# Problem 10: abusive content


def _abuse_weights(spark: SparkSession, sf: str) -> abuse.Weights:
    """Fitted once per session and folder: knowledge chunks and replies are clean by who wrote them, users' messages have no label."""
    known = (spark.sparkContext.applicationId, sf)
    if known not in _ABUSE:
        spoken = table(spark, sf, "chat_messages").select("content", conversations.speaker_of(F.col("role")).alias("speaker"))
        clean = table(spark, sf, "knowledge_chunks").select("content").unionByName(spoken.where("speaker = 'assistant'").select("content"))
        _ABUSE[known] = abuse.fit_on_sample(clean, "content", spoken.where("speaker = 'user'").select("content"))
    return _ABUSE[known]


_ABUSE: dict[tuple[str, str], abuse.Weights] = {}


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.score(table(spark, sf, "documents"), "doc_id", "text", _abuse_weights(spark, sf), keep=["source"])


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_scores(spark, sf).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p10_sources(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents of each source have a score, and whether all scores are probabilities."""
    return p10_scores(spark, sf).groupBy("source").agg(F.count("score").alias("documents"), F.bool_and(F.col("score").between(0, 1)).alias("probable"))


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.rates(p10_scores(spark, sf), "source")


QUERIES = {f.__name__: f for f in (p2_found, p2_conversations, p2_threads, p3_found, p3_consensus, p3_raters, p3_votes, p3_reliability, p3_agreement, p4_found, p4_segments, p4_checked, p5_found, p5_limits, p6_found, p6_texts, p6_checked, p7_daily, p7_overall, p7_verified, p7_overall_verified, p7_large_verified, p8_ids, p8_small_leaves, p8_roundtrip, p9_windows, p9_complete, p9_gain, p9_kinds, p9_summary, p10_found, p10_scores, p10_sources, p10_rates)}

SQL = {
    **_P2_SQLS,
    "p3_agreement": _P3_SQL,
    "p3_raters": _P3_SQL[: _P3_SQL.index("s AS (SELECT *")] + "i AS (SELECT id, sum(n) AS m, sum(n * (n - 1)) AS same FROM c GROUP BY id) SELECT id, CAST(m AS INTEGER) AS raters, CASE WHEN m > 1 THEN round(same / (m * (m - 1)), 4) END AS agreement FROM i",
    "p3_votes": _P3_SQL[: _P3_SQL.index("c AS (SELECT id")].rstrip(", ") + " SELECT rater, count(*) AS votes, true AS probable FROM l GROUP BY rater",
    "p4_checked": "SELECT tbl, true AS fine FROM (VALUES ('chat_messages'), ('knowledge_chunks')) t(tbl)",
    "p10_sources": "SELECT source, count(*) AS documents, true AS probable FROM documents GROUP BY source",
    "p7_verified": _P7_SQL,
    "p7_overall_verified": f"SELECT lang, outcome, CAST(sum(n) AS BIGINT) AS n, true AS within FROM ({_P7_SQL}) GROUP BY lang, outcome",
    "p7_large_verified": "SELECT l_returnflag, count(*) AS n, true AS within FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag",
    "p9_complete": "SELECT count(*) AS documents, 0 AS wrong, 0 AS overfull FROM documents",
    "p6_checked": "SELECT 'chat_messages' AS tbl, count(*) AS texts, 0 AS wrong FROM (SELECT DISTINCT message_id, content FROM chat_messages) UNION ALL SELECT 'chat_feedback', count(*), 0 FROM (SELECT DISTINCT feedback_id, question_snippet FROM chat_feedback)",
    "p9_gain": "SELECT CAST(capacity_tokens AS INTEGER) AS capacity, true AS no_worse FROM context_windows",
    "p9_kinds": "SELECT true AS smallest, true AS one_kind_each",
    "p8_small_leaves": "SELECT doc_id, true AS same FROM documents",
    "p8_roundtrip": "SELECT true AS same, count(*) AS n FROM documents",
}
