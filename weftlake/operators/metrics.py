"""Retrieval metrics from rankings and judgements, per question language with a total, and the quality gate.

A ranking is (config, qid, doc_id, rank); judgements are questions with an array of expected documents. All metrics come
from one aggregate per question and one per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hits that are judged, the name of the total row, and the thresholds of the gate.
EVAL_K = 5
TOTAL = "gộp"
MIN_RECALL3, MIN_MRR = 0.85, 0.70
NUMBERS = ["precision_at_1", "recall_at_1", "recall_at_3", "recall_at_5", "precision_at_3", "f1_at_3", "mrr", "ndcg_at_5"]


def recall_at(k: int) -> Column:
    """1 if a relevant document is among the first k, else 0: a hit rate, no share."""
    return F.coalesce(F.max((F.col("relevant") & (F.col("rank") <= k)).cast("double")), F.lit(0.0))


def precision_at(k: int) -> Column:
    """Relevant ones among the first k over k, also when fewer were found; 0 for k <= 0."""
    return F.lit(0.0) if k <= 0 else F.coalesce(F.sum((F.col("relevant") & (F.col("rank") <= k)).cast("double")), F.lit(0.0)) / k


def reciprocal_rank() -> Column:
    return F.coalesce(1 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0))


def ndcg_at(k: int) -> Column:
    """Binary gain over the ideal of as many relevant documents as there are, k at most; 0 if none are expected."""
    gain = F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1)))
    ideal = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i <= F.first("n_expected")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return F.coalesce(F.try_divide(gain, ideal), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def judged(rankings: DataFrame, questions: DataFrame, configs: list[str]) -> DataFrame:
    """(config, qid, lang, expected, doc_id, rank, relevant): the first five hits of every question and configuration.

    Questions without a hit keep one row without a document.
    """
    hits = rankings.where(F.col("rank") <= EVAL_K).select("config", "qid", "doc_id", "rank")
    asked = questions.select("qid", "lang", "expected", F.explode(F.array(*[F.lit(c) for c in configs])).alias("config"))
    return asked.join(hits, ["config", "qid"], "left").withColumns({"relevant": F.coalesce(F.array_contains("expected", F.col("doc_id")), F.lit(False)), "n_expected": F.size(F.array_distinct("expected"))})


def per_question(hits: DataFrame) -> DataFrame:
    return hits.groupBy("config", "qid", "lang").agg(
        recall_at(1).alias("p1"), recall_at(3).alias("r3"), recall_at(5).alias("r5"), precision_at(3).alias("p3"), reciprocal_rank().alias("rr"), ndcg_at(EVAL_K).alias("ndcg"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_relevant"),
    )


def _numbers() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.avg("p1").alias("p1"), F.avg("r3").alias("r3"), F.avg("r5").alias("r5"), F.avg("p3").alias("p3"), F.avg("rr").alias("rr"), F.avg("ndcg").alias("ndcg")]


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    r = lambda c: F.round(c, 6)
    p3, r3 = F.col("p3"), F.col("r3")
    return df.select(*keys, "n", r(F.col("p1")).alias("precision_at_1"), r(F.col("p1")).alias("recall_at_1"), r(r3).alias("recall_at_3"), r(F.col("r5")).alias("recall_at_5"), r(p3).alias("precision_at_3"), r(f1(p3, r3)).alias("f1_at_3"), r(F.col("rr")).alias("mrr"), r(F.col("ndcg")).alias("ndcg_at_5"))


def evaluate(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics per group; F1 is that of the group's averages."""
    return _named(scored.groupBy(*keys).agg(*_numbers()), keys)


def evaluate_with_total(scored: DataFrame, key: str = "lang", total: str = TOTAL) -> DataFrame:
    """Metrics per config and key, with a total row per config that has at least two values of the key."""
    rows = scored.rollup("config", key).agg(*_numbers(), F.grouping_id().alias("g"), F.count_distinct(key).alias("kinds"))
    kept = rows.where("g = 0 OR (g = 1 AND kinds > 1)").withColumn(key, F.when(F.col("g") == 1, F.lit(total)).otherwise(F.col(key)))
    return _named(kept, ["config", key])


def gate(metrics: DataFrame, thresholds: DataFrame | None = None, total: str = TOTAL) -> DataFrame:
    """(config, lang, violation) of every language below its threshold (lang, min_recall3, min_mrr); the total is exempt.

    Without thresholds the defaults hold for all; with them, a language that lacks one is a violation.
    """
    m = metrics.where(F.col("lang") != total)
    if thresholds is None:
        m = m.withColumns({"min_recall3": F.lit(MIN_RECALL3), "min_mrr": F.lit(MIN_MRR)})
    else:
        m = m.join(thresholds, "lang", "left")
    low = lambda c, t: F.when(F.col(c) < F.col(t), F.format_string(f"{c} %.3f < %.3f", F.col(c), F.col(t)))
    found = F.array_compact(F.array(F.when(F.col("min_recall3").isNull() | F.col("min_mrr").isNull(), "no threshold"), low("recall_at_3", "min_recall3"), low("mrr", "min_mrr")))
    return m.select("config", "lang", F.explode(found).alias("violation"))


def misses(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(config, qid, miss): one line for each question without a relevant document among the first five."""
    lines = hits.groupBy("config", "qid").agg(F.max("relevant").alias("any"), F.array_sort(F.collect_list(F.when(F.col("doc_id").isNotNull(), F.struct("rank", "doc_id")))).alias("top")).where("NOT any")
    text = F.format_string('"%s" -> mong đợi [%s], nhận được [%s]', "query", F.array_join(F.array_sort("expected"), ", "), F.array_join("top.doc_id", ", "))
    return lines.join(questions.select("qid", "query", "expected"), "qid").select("config", "qid", text.alias("miss"))


def win_loss(scored: DataFrame, a: str, b: str) -> DataFrame:
    """(outcome, n): questions whose first hit is right in a only, in b only, in both or in neither."""
    one = lambda name, col: scored.where(F.col("config") == name).select("qid", (F.col("p1") == 1).alias(col))
    both = one(a, "x").join(one(b, "y"), "qid")
    outcome = F.when(F.col("x") & F.col("y"), "both").when(F.col("x"), f"{a} only").when(F.col("y"), f"{b} only").otherwise("neither")
    return both.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _first(ranking: DataFrame, name: str) -> DataFrame:
    return ranking.where("rank = 1").select("qid", F.col("doc_id").alias(name))


def fusion_losses(questions: DataFrame, semantic: DataFrame, lexical: DataFrame, plain: DataFrame, fused: DataFrame) -> DataFrame:
    """(outcome, n, in_both, by_synonym) of the questions that only one of semantic branch and fusion answers first.

    `lost`: the fusion's first hit is wrong, the semantic one right. Of these, in_both counts where both branches hold the
    wrong document, and by_synonym where the lexical branch ranks it above the right one with expansion, but not without
    (plain); a document that a ranking lacks stands at the end. `gained` is the other way round, with counts of 0.
    """
    right = lambda doc: F.coalesce(F.array_contains("expected", F.col(doc)), F.lit(False))
    one = questions.select("qid", "expected").join(_first(semantic, "sdoc"), "qid", "left").join(_first(fused, "fdoc"), "qid", "left").withColumns({"sok": right("sdoc"), "fok": right("fdoc")}).where("sok <> fok")
    for name, ranking, doc in (("ws", semantic, "fdoc"), ("wl", lexical, "fdoc"), ("rl", lexical, "sdoc"), ("wp", plain, "fdoc"), ("rp", plain, "sdoc")):
        one = one.join(ranking.select("qid", F.col("doc_id").alias(doc), F.col("rank").alias(name)), ["qid", doc], "left")
    at = lambda c: F.coalesce(F.col(c), F.lit(99))
    driven = (at("wl") < at("rl")) & ~(at("wp") < at("rp"))
    return one.groupBy(F.when(F.col("sok"), "lost").otherwise("gained").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sok") & F.col("ws").isNotNull() & F.col("wl").isNotNull()).alias("in_both"), F.count_if(F.col("sok") & driven).alias("by_synonym"))


def hit_sources(questions: DataFrame, fused: DataFrame, semantic: DataFrame) -> DataFrame:
    """(source, n) of the questions whose first hit is wrong: `empty` (no hit), `vector`, or `filled by bm25`."""
    found = semantic.select("qid", "doc_id", F.lit(True).alias("seen"))
    top1 = questions.select("qid", "expected").join(_first(fused, "doc_id"), "qid", "left").where(~F.coalesce(F.array_contains("expected", F.col("doc_id")), F.lit(False)))
    source = F.when(F.col("doc_id").isNull(), "empty").when(F.col("seen"), "vector").otherwise("filled by bm25")
    return top1.join(found, ["qid", "doc_id"], "left").groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"))


def worst_first(table: DataFrame, key: str, base: str, best: str, total: str = TOTAL) -> DataFrame:
    """(place, key, n, p1_base, p1_best): groups by P@1 of the better configuration, then of the other, then by name.

    The total comes last. One row per group, so one task orders them.
    """
    one = lambda config, name: table.where(F.col("config") == config).select(key, "n", F.col("precision_at_1").alias(name))
    both = one(base, "p1_base").join(one(best, "p1_best").drop("n"), key)
    order = Window.orderBy((F.col(key) == total).cast("int"), "p1_best", "p1_base", key)
    return both.select(F.row_number().over(order).cast("long").alias("place"), key, "n", "p1_base", "p1_best")


def require_hits(ranking: DataFrame, name: str) -> DataFrame:
    """ranking, or an error if it is empty: a branch that answers nothing at all must not be measured."""
    if ranking.isEmpty():
        raise ValueError(f"{name} found nothing for any question")
    return ranking


def error_kinds(hits: DataFrame, categories: DataFrame) -> DataFrame:
    """(config, kind, n) of the questions whose first hit is wrong.

    `miss`: nothing relevant among the five; else by the first hit's category: that of the first expected document or not.
    categories: (doc_id, category).
    """
    q = hits.groupBy("config", "qid").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("found"), F.min_by("doc_id", "rank").alias("doc_id"), F.first(F.element_at("expected", 1)).alias("wanted"))
    wrong = q.where("found IS NULL OR found > 1")
    c = categories.select("doc_id", "category")
    named = wrong.join(c, "doc_id", "left").join(c.withColumnsRenamed({"doc_id": "wanted", "category": "wanted_category"}), "wanted", "left")
    kind = F.when(F.col("found").isNull(), "miss").when(F.col("category") == F.col("wanted_category"), "same category").otherwise("other category")
    return named.groupBy("config", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def text_table(metrics: DataFrame) -> list[str]:
    """Aligned lines of a metrics table of a few rows, for people."""
    lines = [f"{'config':<24}{'lang':<8}{'n':>5}{'P@1':>8}{'R@3':>8}{'R@5':>8}{'P@3':>8}{'F1@3':>8}{'MRR':>8}"]
    for r in metrics.orderBy("config", "lang").collect():
        lines.append(f"{r.config:<24}{r.lang:<8}{r.n:>5}{r.precision_at_1:>8.1%}{r.recall_at_3:>8.1%}{r.recall_at_5:>8.1%}{r.precision_at_3:>8.3f}{r.f1_at_3:>8.3f}{r.mrr:>8.3f}")
    return lines
