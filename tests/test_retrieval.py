import math

import pytest
from pyspark.sql import functions as F

from weftlake.operators import bm25, fusion, synonyms, vectors

CORPUS = [
    (0, "bag", "Hành lý", "Mỗi khách mang 7kg hành lý xách tay lên tàu", "b", "vi"),
    (1, "pet", "Thú cưng", "Chó và mèo phải nằm trong lồng", "p", "vi"),
    (2, "ref", "Hoàn vé", "Tiền hoàn về thẻ sau ba ngày", "r", "vi"),
    (3, "bag-en", "Baggage", "Each passenger may carry one bag of 7kg", "b", "en"),
    (4, "pet-ja", "ペット", "犬と猫はケージに入れてください", "p", " JA "),
]
CORPUS_SCHEMA = "ord long, doc_id string, title string, content string, category string, lang string"
Q = "qid string, query string, lang string"


@pytest.fixture(scope="module")
def index(spark):
    return bm25.build(spark.createDataFrame(CORPUS, CORPUS_SCHEMA))


def ask(spark, index, *rows, k=5):
    hits = bm25.search(index, bm25.resolve(spark.createDataFrame(list(rows), Q), index.languages), k)
    return [(r.qid, r.doc_id) for r in hits.orderBy("qid", "rank").collect()]


def test_lexical(spark, index):
    assert ask(spark, index, ("1", "hanh ly 7 kg", None))[0] == ("1", "bag")
    assert ask(spark, index, ("1", "犬", "ja")) == []  # a run of one character is a token of its own
    assert ask(spark, index, ("1", "猫はケージ", "ja")) == [("1", "pet-ja")]


def test_guards(spark, index):
    assert ask(spark, index, ("1", None, "vi"), ("2", "  ", "vi"), ("3", "!!", None), ("4", "zzz", None)) == []
    assert ask(spark, index, ("1", "hành lý", "vi"), k=0) == []
    empty = bm25.build(spark.createDataFrame([], CORPUS_SCHEMA))
    assert ask(spark, empty, ("1", "hành lý", "vi")) == []


def test_language_filter_and_unknown_language(spark, index):
    assert ask(spark, index, ("1", "7kg", "en")) == [("1", "bag-en")]
    assert ask(spark, index, ("1", "7kg hanh ly", " FR ")) == ask(spark, index, ("1", "7kg hanh ly", None))


def test_statistics_of_a_language_stand_alone(spark, index):
    more = CORPUS + [(10 + i, f"zh{i}", "", "手荷物規定" * 40, "x", "zh") for i in range(5)]
    other = bm25.build(spark.createDataFrame(more, CORPUS_SCHEMA))
    q = spark.createDataFrame([("1", "hành lý 7kg", "vi"), ("2", "hành lý 7kg", None)], Q)
    score = lambda ix: {(r.qid, r.doc_id): r.score for r in bm25.search(ix, bm25.resolve(q, ix.languages), 5).collect()}
    a, b = score(index), score(other)
    assert all(a[x] == b[x] for x in a if x[0] == "1") and any(a[x] != b[x] for x in a if x[0] == "2")


def test_score_by_hand(spark):
    ix = bm25.build(spark.createDataFrame([(0, "a", "", "xx yy", "", "en"), (1, "b", "", "xx xx zz", "", "en")], CORPUS_SCHEMA))
    got = {r.doc_id: r.score for r in bm25.search(ix, spark.createDataFrame([("1", "xx", "*")], "qid string, query string, scope string"), 5).collect()}
    idf = math.log(1 + (2 - 2 + 0.5) / 2.5)
    by_hand = lambda tf, dl: round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 2.5)), 6)
    assert got == {"a": by_hand(1, 2), "b": by_hand(2, 3)}


def test_ties_go_to_load_order(spark):
    ix = bm25.build(spark.createDataFrame([(5, "late", "", "xx yy", "", ""), (1, "early", "", "xx yy", "", None)], CORPUS_SCHEMA))
    assert ask(spark, ix, ("1", "xx", None)) == [("1", "early"), ("1", "late")]


TABLES = {"vi": {"chó": ["thú cưng"], "huy ve": ["hoàn tiền"], "phí": ["cước"]}, "ja": {"犬": ["ペット"]}}


def expand(spark, query, scope):
    q = spark.createDataFrame([("1", query, scope)], "qid string, query string, scope string")
    return synonyms.expand(q, synonyms.table_of(spark, TABLES)).first().tokens


def test_synonyms(spark):
    assert expand(spark, "hủy vé hoàn tiền", "vi")[:4] == ["huy", "ve", "hoan", "tien"]
    assert "cung" in expand(spark, "chó lên tàu", "vi") and "cung" in expand(spark, "chó lên tàu", "vi")
    assert "cung" not in expand(spark, "cho lên tàu", "vi") and "cung" not in expand(spark, "chọn ghế", "vi")
    assert "ペッ" in expand(spark, "小犬は", "ja") and "ペッ" not in expand(spark, "小犬は", "vi")
    assert "ペッ" in expand(spark, "小犬は", "*") and len(set(expand(spark, "huy ve huy ve", "vi"))) == len(expand(spark, "huy ve huy ve", "vi"))
    assert expand(spark, None, "vi") == []


V = "ord long, doc_id string, lang string, embedding array<float>"
QV = "qid string, scope string, vector array<float>"


def test_vectors(spark):
    store = spark.createDataFrame([(0, "a", "vi", [1.0, 0.0]), (1, "b", "en", [0.8, 0.6]), (2, "c", "vi", [0.0, 1.0]), (3, "zero", "vi", [0.0, 0.0]), (4, "null", "vi", None)], V)
    got = lambda least, scope="*", k=5: [(r.doc_id, r.score) for r in vectors.search(store, spark.createDataFrame([("1", scope, [1.0, 0.0]), ("2", scope, None)], QV), k, least).orderBy("rank").collect()]
    assert got(0.5) == [("a", 1.0), ("b", 0.8)]
    assert got(0.0)[-1] == ("zero", 0.0) and got(0.1, "vi") == [("a", 1.0)] and got(-1, k=1) == [("a", 1.0)] and got(-1, k=0) == []
    with pytest.raises(Exception, match="dimensions"):
        vectors.search(store, spark.createDataFrame([("1", "*", [1.0])], QV), 5, 0).collect()
    with pytest.raises(ValueError):
        vectors.check_dimensions(store.unionByName(spark.createDataFrame([(9, "x", "", [1.0])], V)))
    blocks = vectors.search(store, spark.createDataFrame([(str(i), "*", [1.0, 0.0]) for i in range(9)], QV), 1, 0.5, block=2)
    assert {(r.qid, r.doc_id) for r in blocks.collect()} == {(str(i), "a") for i in range(9)}
    pair = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>").select(vectors.guarded_cosine("a", "b").alias("c"))
    assert [round(r.c, 6) for r in pair.collect()] == [0.6, 0.0]


R = "qid string, doc_id string, rank long"


def ranks(spark, *docs):
    return spark.createDataFrame([("1", d, i + 1) for i, d in enumerate(docs)], R)


def order(df):
    return [r.doc_id for r in df.orderBy("qid", "rank").collect()]


def test_fusion(spark):
    sem, lex, none = ranks(spark, "a", "b", "c"), ranks(spark, "d", "b"), ranks(spark).where("false")
    assert order(fusion.rrf(sem, lex, 3))[0] == "b"
    assert order(fusion.rrf(ranks(spark, "x", "y"), ranks(spark, "y", "x"), 2)) == ["x", "y"]
    assert order(fusion.rrf(sem, lex, 9, weights=(0.0, 1.0))) == ["a", "b", "c"]
    assert order(fusion.vector_fill(sem, lex, 4)) == ["a", "b", "c", "d"]
    assert set(order(fusion.vector_rerank(sem, lex, 9))) == {"a", "b", "c"}
    assert [r.score for r in fusion.vector_rerank(sem, lex, 1).collect()] == [round(1 / 61 + 1 / 62, 9)]  # the survivor is ranked anew
    assert all(order(fusion.fuse(m, none, lex, 5)) == ["d", "b"] for m in fusion.FUSIONS)
    with pytest.raises(ValueError):
        fusion.fuse("other", sem, lex, 3)
    with pytest.raises(ValueError):
        fusion.rrf(sem, lex, 3, weights=(1.0,))


def test_indexed_text(spark):
    df = spark.createDataFrame([("T", "c"), (" ", "c"), (None, "c")], "t string, c string")
    got = df.select(bm25.indexed_text(F.col("t"), F.col("c")).alias("i"), bm25.embedding_text(F.col("t"), F.col("c")).alias("e")).collect()
    assert [tuple(r) for r in got] == [("T c", "T. c"), ("  c", "c"), (" c", "c")]


def test_saved_index_and_salts(spark, index, tmp_path, monkeypatch):
    questions = spark.createDataFrame([("1", "hành lý 7kg", "vi"), ("2", "one bag", None)], Q)
    ranked = lambda ix: sorted(tuple(r) for r in bm25.search(ix, bm25.resolve(questions, ix.languages), 5).collect())
    monkeypatch.setattr(bm25, "SALT_ROWS", 1)
    salted = bm25.build(spark.createDataFrame(CORPUS, CORPUS_SCHEMA))
    assert salted.terms.where("salts > 1").count() > 0
    bm25.save(salted, str(tmp_path / "ix"))
    again = bm25.load(spark, str(tmp_path / "ix"))
    assert ranked(index) == ranked(salted) == ranked(again) and bm25.size(again) == len(CORPUS)


def test_vectors_are_loaded_one_to_one(spark):
    corpus = spark.createDataFrame(CORPUS[:2], CORPUS_SCHEMA)
    v = spark.createDataFrame([("bag", [1.0, 0.0]), ("pet", [0.0, 1.0])], "doc_id string, embedding array<float>")
    assert vectors.load(corpus, v).count() == 2
    for wrong in (v.limit(1), v.unionByName(v), v.unionByName(spark.createDataFrame([("x", [1.0, 1.0])], v.schema))):
        with pytest.raises(ValueError):
            vectors.load(corpus, wrong)


def test_vectors_in_small_steps(spark, monkeypatch):
    """The k best over a task, however few products it holds at a time."""
    import numpy as np

    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    store = spark.createDataFrame([(i, str(i), None, [float(a) for a in r]) for i, r in enumerate(x)], V)
    asked = spark.createDataFrame([(str(i), "*", [float(a) for a in r]) for i, r in enumerate(q)], QV)
    monkeypatch.setattr(vectors, "SIMS", 20)
    got = {(r.qid, r.rank): r.ord for r in vectors.search(store, asked, 3, -1.0).collect()}
    sims = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
    for i in range(7):
        assert [got[(str(i), r)] for r in (1, 2, 3)] == np.lexsort((np.arange(300), -sims[i]))[:3].tolist()


def test_sources_losses_and_degradation(spark):
    from weftlake.operators import metrics

    q = spark.createDataFrame([("1", ["a"]), ("2", ["b"]), ("3", ["z"]), ("4", ["c"])], "qid string, expected array<string>")
    rank = lambda rows: spark.createDataFrame([(a, d, i) for a, docs in rows.items() for i, d in enumerate(docs, 1)], R)
    sem, lex, plain = rank({"1": ["a", "x"], "2": ["y"]}), rank({"1": ["x", "a"], "2": ["b"], "4": ["w"]}), rank({"1": ["a", "x"]})
    fused = rank({"1": ["x"], "2": ["b"], "4": ["w"]})
    assert {tuple(r) for r in metrics.fusion_losses(q, sem, lex, plain, fused).collect()} == {("lost", 1, 1, 1), ("gained", 1, 0, 0)}
    assert {tuple(r) for r in metrics.hit_sources(q, fused, sem).collect()} == {("vector", 1), ("empty", 1), ("filled by bm25", 1)}
    assert {tuple(r) for r in fusion.degradation(q, q.where("qid < '3'"), fused).collect()} == {("both", 2, 2), ("lexical only", 2, 1)}
    with pytest.raises(ValueError):
        metrics.require_hits(sem.where("false"), "vectors")


def test_scan_equals_join(spark, index, monkeypatch):
    """Many questions scan the documents instead of shuffling every pair; blocks of questions and of documents change nothing."""
    more = [(20 + i, f"m{i:02}", None, f"bag ticket {'refund ' * (i % 5)}" + "犬と猫 " * (i % 3), "x", ["vi", "en", "ja", None][i % 4]) for i in range(60)]
    ix = bm25.build(spark.createDataFrame(CORPUS + more, CORPUS_SCHEMA).repartition(3))
    rows = [(str(i), q, lang) for i, (q, lang) in enumerate((q, lang) for q in ["bag refund ticket", "refund", "犬と猫 ticket", "zzz", None, "hành lý 7kg bag bag"] for lang in ["vi", "en", "ja", None, "fr"])]
    questions = bm25.resolve(spark.createDataFrame(rows + rows[:3], Q), ix.languages)
    ranked = lambda k: sorted(tuple(r) for r in bm25.search(ix, questions, k).collect())
    for k in (0, 1, 4):
        monkeypatch.setattr(bm25, "JOIN_HITS", 1_000_000)
        joined = ranked(k)
        monkeypatch.setattr(bm25, "JOIN_HITS", -1)
        for terms, docs in ((500_000, 32_768), (20, 7)):
            monkeypatch.setattr(bm25, "BLOCK_TERMS", terms)
            monkeypatch.setattr(bm25, "BLOCK_DOCS", docs)
            assert ranked(k) == joined and (k == 0 or len(joined) > 15)


def test_scan_shuffles_no_pairs(spark, monkeypatch):
    """What is shuffled of a large search is k rows of each question and task, not a row of each question and document."""
    docs = spark.range(0, 2000, 1, 2).selectExpr("id AS ord", "cast(id AS string) AS doc_id", "'' AS title", "concat('aa bb ', id + 100) AS content", "'' AS category", "'en' AS lang")
    questions = spark.range(100).selectExpr("cast(id AS string) AS qid", "concat('aa bb ', id + 100) AS query", "'*' AS scope")
    monkeypatch.setattr(bm25, "JOIN_HITS", 1000)
    hits = bm25.search(bm25.build(docs), questions, 2)
    hits.collect()
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan
    assert {(r.qid, r.doc_id) for r in hits.where("rank = 1").collect()} == {(str(i), str(i)) for i in range(100)}


def test_saved_documents(spark, index, tmp_path):
    bm25.save_docs(spark.createDataFrame(CORPUS, CORPUS_SCHEMA), str(tmp_path / "ix"))
    again = bm25.load_docs(spark, str(tmp_path / "ix"))
    for rows in ([("1", "hanh ly 7 kg", None), ("2", "one bag", "en"), ("3", "猫はケージ", "ja")], [("1", None, "vi"), ("2", "zzz", None)]):
        assert sorted(ask(spark, again, *rows)) == sorted(ask(spark, index, *rows))
    assert bm25.size(again) == len(CORPUS) and ask(spark, again, ("1", "bag", None), k=0) == []


def test_equal_questions_are_searched_once(spark, monkeypatch):
    """Questions of one scope and vector are multiplied once, and each has its ranking."""
    import numpy as np

    seen = []
    array = np.array
    store = spark.createDataFrame([(i, str(i), ["en", "vi"][i % 2], [1.0, i / 10]) for i in range(20)], V)
    asked = spark.createDataFrame([(str(i), ["*", "en"][i % 2], [1.0, float(i % 4 > 1)]) for i in range(40)], QV)
    monkeypatch.setattr(vectors.np, "array", lambda x, *a: seen.append(len(x)) or array(x, *a))
    hits = vectors.search(store, asked, 3, -1.0)
    monkeypatch.undo()
    assert seen[0] == 4
    got = {}
    for r in hits.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.ord, r.score, r.rank))
    assert len(got) == 40 and all(got[str(i)] == got[str(i % 4)] and [x[2] for x in got[str(i)]] == [1, 2, 3] for i in range(40))
