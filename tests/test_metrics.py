import math

import pytest

from weftlake.operators import corpus, labels, metrics

Q = "qid string, query string, lang string, expected array<string>"
R = "config string, qid string, doc_id string, rank long"


@pytest.fixture()
def four(spark):
    q = spark.createDataFrame([("q1", "one", "vi", ["k", "m"]), ("q2", "two", "vi", ["n"]), ("q3", "three", "en", ["p"]), ("q4", "four", "en", ["r"])], Q)
    lists = {"q1": ["s", "k", "m", "t"], "q2": ["n"], "q3": ["s", "t", "u", "v", "p"], "q4": ["s", "t", "u", "v", "w", "r"]}
    r = spark.createDataFrame([("c", q_, d, i + 1) for q_, docs in lists.items() for i, d in enumerate(docs)], R)
    return metrics.judged(r, q, ["c"]), q


def test_evaluate(four):
    m = metrics.evaluate(metrics.per_question(four[0]), ["config"]).first()
    assert (m.n, m.precision_at_1, m.recall_at_3, m.recall_at_5, m.mrr) == (4, 0.25, 0.5, 0.75, round((1 / 2 + 1 + 1 / 5) / 4, 6))
    p3 = (2 / 3 + 1 / 3) / 4
    assert m.precision_at_3 == round(p3, 6) and m.f1_at_3 == round(2 * p3 * 0.5 / (p3 + 0.5), 6)
    both = (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3))
    assert m.ndcg_at_5 == round((both + 1 + 1 / math.log2(6)) / 4, 6)


def test_total_only_for_several_languages(four):
    per = metrics.per_question(four[0])
    assert {r.lang for r in metrics.evaluate_with_total(per).collect()} == {"vi", "en", metrics.TOTAL}
    assert {r.lang for r in metrics.evaluate_with_total(per.where("lang = 'vi'")).collect()} == {"vi"}


def test_gate(spark, four):
    m = metrics.evaluate_with_total(metrics.per_question(four[0]))
    assert {(r.lang, r.violation.split()[0]) for r in metrics.gate(m).collect()} == {("en", "recall_at_3"), ("en", "mrr")}
    own = spark.createDataFrame([("vi", 0.5, 0.5)], "lang string, min_recall3 double, min_mrr double")
    assert [(r.lang, r.violation) for r in metrics.gate(m, own).collect()] == [("en", "no threshold")]


def test_misses_and_no_hits(spark, four):
    assert [r.miss for r in metrics.misses(*four).collect()] == ['"four" -> mong đợi [r], nhận được [s, t, u, v, w]']
    q = spark.createDataFrame([("q9", "none", "vi", [])], Q)
    empty = spark.createDataFrame([], R)
    m = metrics.evaluate(metrics.per_question(metrics.judged(empty, q, ["c"])), ["config"]).first()
    assert (m.n, m.mrr, m.ndcg_at_5, m.f1_at_3) == (1, 0.0, 0.0, 0.0)


def test_agreement(spark):
    pairs = spark.createDataFrame([("bia", "bia"), ("co_can_cu", "bia"), ("tu_choi_dung", "tu_choi_thua"), ("co_can_cu", "co_can_cu"), (None, "bia")], "human string, judge string")
    assert tuple(labels.agreement(pairs).first()) == (4, 2, 3, 1, 1, 1)
    assert {tuple(r) for r in labels.confusion(pairs).collect()} == {("co_can_cu", 1, 1, 0, 0), ("bia", 0, 1, 0, 0), ("tu_choi_dung", 0, 0, 0, 1), ("tu_choi_thua", 0, 0, 0, 0)}
    assert tuple(labels.agreement(pairs.where("false")).first()) == (0, 0, 0, 0, 0, 0)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 50])
def test_nearest_rank(spark, n):
    values = [(i * 7) % n for i in range(n)]
    got = labels.nearest_rank(spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v int"), ["g"], "v", {"a": 0.5, "b": 0.95}).first()
    at = lambda q: sorted(values)[min(n - 1, max(0, round(q * n) - 1))]
    assert (got.n, got.a, got.b) == (n, at(0.5), at(0.95))


@pytest.mark.parametrize("text, wanted", [('```json\n{"nhan": "bia", "ly_do": "x"}\n```', ("bia", "x", None)), ('{"nhan": "other"}', (None, None, "unknown label")), ("no", (None, None, "no JSON")), (None, (None, None, "no JSON"))])
def test_parse_label(spark, text, wanted):
    from pyspark.sql import functions as F

    assert tuple(spark.createDataFrame([(text,)], "t string").select(labels.parse_label(F.col("t")).alias("p")).first().p) == wanted


def test_sheets(spark):
    new = spark.createDataFrame([("1", "", "new"), ("2", "", "new")], "id string, label string, note string")
    old = spark.createDataFrame([("1", "bia", ""), ("2", " ", "")], "id string, label string, note string")
    assert {tuple(r) for r in labels.merge_sheets(new, old, "id", ["label"]).collect()} == {("1", "bia", "new"), ("2", "", "new")}
    run = spark.createDataFrame([("1", "a ", None), ("2", "b", None)], "id string, text string, label string")
    before = spark.createDataFrame([("1", "a", "bia"), ("2", "b", "x")], "id string, text string, label string")
    assert {r.label for r in labels.copy_if_verbatim(run, before, "id", "text", ["label"]).collect()} == {"bia", "x"}
    assert {r.label for r in labels.copy_if_verbatim(run, before.where("id = '1'"), "id", "text", ["label"]).collect()} == {None}


def test_samples(spark):
    rows = spark.range(1000).selectExpr("id", "if(id < 900, 'a', 'b') AS s")
    one = {tuple(r) for r in labels.stratified_sample(rows, "s", "id", {"a": 5, "b": 3}, 7).collect()}
    assert one == {tuple(r) for r in labels.stratified_sample(rows.repartition(7), "s", "id", {"a": 5, "b": 3}, 7).collect()} and len(one) == 8
    named = labels.shuffled(rows, "id", 3, "c", 4).orderBy("number").collect()
    assert [r.name for r in named[:2]] == ["c0001", "c0002"] and [r.number for r in named] == list(range(1, 1001))


def test_contained_in(spark):
    needles = spark.createDataFrame([(1, "lo w"), (2, "xyz"), (3, "h"), (4, ""), (5, None), (6, "d"), (7, "q"), (8, "or")], "nid long, text string")
    hay = spark.createDataFrame([("hello world",), ("hello world",), (None,), ("ab",)], "text string")
    assert {r.nid for r in corpus.contained_in(needles, hay).collect()} == {1, 3, 6, 8}


def test_unique_and_missing(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "doc_id string")
    with pytest.raises(ValueError, match="'a'"):
        corpus.require_unique(rows)
    q = spark.createDataFrame([("1", "x", "vi", ["b", "z"])], Q)
    assert [r.doc_id for r in corpus.missing_documents(q, rows).collect()] == ["z"]


def test_ranks_whatever_the_ranges(spark):
    """Few and many ranges, hot groups, null keys, NaN and infinite values."""
    import random

    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 50)) for _ in range(5000)] + [(None, float(rng.randrange(4))) for _ in range(90)] + [("one", 7.5), ("none", None), ("nan", float("nan")), ("inf", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    for splits in (2, 7, 64):
        got = {r.g: r for r in labels.at_ranks(df, ["g"], "v", {"lo": lambda n: n * 0 + 1, "mid": lambda n: (n + 1) / 2, "hi": lambda n: n}, splits).collect()}
        assert set(got) == {"hot", None, "one", "inf"}
        for g in got:
            xs = sorted(v for k, v in rows if k == g)
            assert (got[g].n, got[g].lo, got[g].mid, got[g].hi) == (len(xs), xs[0], xs[(len(xs) + 1) // 2 - 1], xs[-1])
    assert labels.nearest_rank(df.where("false"), ["g"], "v", {"a": 0.5}).collect() == []


def test_shuffled_keeps_wide_rows(spark):
    wide = spark.range(1_000_000).selectExpr("cast(id AS string) AS qid", *(f"md5(cast(id * {i} AS string)) AS c{i}" for i in range(1, 4)))
    r = labels.shuffled(wide, "qid", 16, "c", 4).selectExpr("count(*) AS n", "count(DISTINCT number) AS numbers", "count(DISTINCT qid) AS ids", "min(number) AS a", "max(number) AS b", "count(DISTINCT name) AS names").first()
    assert tuple(r) == (1_000_000, 1_000_000, 1_000_000, 1, 1_000_000, 1_000_000)
    assert labels.shuffled(wide.where("false"), "qid", 1, "c").collect() == []


def test_guards_and_runs(spark):
    items = spark.createDataFrame([("r1", "1", "bia", "bia"), ("r1", "2", "?", "co_can_cu"), ("r2", "3", None, None)], "run string, id string, h string, j string")
    assert [r.id for r in labels.unlabelled(items, "id", "h").orderBy("id").collect()] == ["2", "3"]
    with pytest.raises(ValueError):
        labels.require_labelled(items, "id", "h")
    assert labels.require_labelled(items.where("id = '1'"), "id", "h").count() == 1
    got = {r.run: r for r in labels.compare_runs(items, "run", "h", "j").collect()}
    assert (got["r1"].judged, got["r1"].fake_judge, got["r1"].fake_human, got["r1"].pending, got["r2"].state, got["r2"].fake_judge) == (2, 1, 1, 1, "not judged", None)
    key = spark.createDataFrame([("1", "price"), ("2", None)], "id string, kind string")
    assert [tuple(r) for r in labels.caught_by_key(items, key, "id", "kind", "j").collect()] == [("price", 1, 1)]
