import json

import pytest
from pyspark.sql import functions as F

from weftlake.operators import bm25, prompts
from weftlake.sources import cache, files, jdbc, models
from weftlake.streaming import questions as S

KB = """
- docId: a
  title: T
  category: C
  content: one
- doc_id: " b "
  lang: " EN "
  content: two
- docId: ""
  content: skipped
- docId: c
  content: "  "
"""


def test_knowledge_base(spark, tmp_path):
    (tmp_path / "1.yml").write_text(KB)
    rows = {r.doc_id: r for r in files.load_knowledge_base(spark, str(tmp_path / "*.yml")).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].lang == "vi" and rows["b"].lang == "en" and rows["a"].ord < rows["b"].ord
    (tmp_path / "2.yml").write_text("- docId: a\n  lang: zh\n  content: again\n")
    with pytest.raises(ValueError, match="duplicate"):
        files.load_knowledge_base(spark, str(tmp_path / "*.yml"), lang="en")


def test_questions_synonyms_marker(spark, tmp_path):
    (tmp_path / "q.yml").write_text("- query: hi\n  expected: [a, b]\n- expected: [c]\n")
    assert [(r.query, r.expected, r.lang) for r in files.load_questions(spark, str(tmp_path / "q.yml")).collect()] == [("hi", ["a", "b"], "vi")]
    (tmp_path / "s.yml").write_text("en:\n  no: [x]\n")
    with pytest.raises(TypeError):
        files.load_synonyms(str(tmp_path / "s.yml"))
    assert files.after_marker("a\n# mark\nb\n", "# mark") == "b\n"
    with pytest.raises(ValueError):
        files.after_marker("a", "mark")


def test_sheets_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("1", "two\nlines", None), ("2", 'quo"te', 3)], "id string, text string, n int")
    files.write_items(df, str(tmp_path / "i.yml"), "head")
    back = files.read_items(spark, str(tmp_path / "i.yml")).orderBy("pos").collect()
    assert [json.loads(r.json)["text"] for r in back] == ["two\nlines", 'quo"te'] and (tmp_path / "i.yml").read_text().startswith("# head")
    failed = jdbc.export(lambda q: df if "good" in q else 1 / 0, str(tmp_path / "out"), {"good": ("SELECT good", ["id"]), "bad": ("SELECT bad", ["id"])})
    assert set(failed) == {"bad"}
    assert files.read_csv(spark, str(tmp_path / "out/good"), "id string, text string, n int").orderBy("id").collect() == df.collect()


def test_env_file(tmp_path, monkeypatch):
    monkeypatch.setenv("WL_B", "kept")
    monkeypatch.delenv("WL_A", raising=False)
    (tmp_path / ".env").write_text("# c\nexport WL_A='x y'\nWL_B=new\nnonsense\n")
    assert files.load_env_file(str(tmp_path / ".env")) == ["WL_A"]
    monkeypatch.delenv("WL_A")


def test_cache_and_embedding(spark):
    wanted = spark.createDataFrame([("k1", "a"), ("k2", "bb"), ("k2", "bb"), ("k3", "ccc")], "key string, text string")
    stored = cache.parsed_vectors(spark.createDataFrame([("k1", "[1.0, 2.0]"), ("k3", "broken")], "key string, json string"))
    quick = models.Policy(interval=0.0)
    got = {r.key: r for r in models.embed(wanted, stored, lambda texts: [[float(len(t))] for t in texts], quick).collect()}
    assert {k: r.value for k, r in got.items()} == {"k2": [2.0], "k3": [3.0]}
    bad = models.embed(wanted, stored, lambda texts: [], quick)
    assert models.failures(bad) == 2
    with pytest.raises(LookupError):
        cache.hits_only(wanted, stored)
    assert cache.hits_only(wanted.where("key = 'k1'"), stored).count() == 1


def test_retry():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise models.TransientError("429", wait=7.0 if len(calls) == 1 else None)
        return "ok"

    assert models.with_retry(call, models.Policy(), waits.append) == "ok" and waits == [7.0, 20.0]
    with pytest.raises(models.TransientError):
        models.with_retry(lambda: (_ for _ in ()).throw(models.TransientError("503")), models.Policy(attempts=2), waits.append)


def test_complete(spark):
    requests = spark.createDataFrame([("1", "s", "hello"), ("2", "s", "")], "key string, system string, user string")
    got = {r.key: r for r in models.complete(requests, lambda s, u: {"text": u, "completion_tokens": 3 if u else None}, models.Policy(interval=0.0)).collect()}
    assert (got["1"].text, got["1"].completion_tokens, got["1"].prompt_tokens, got["1"].error) == ("hello", 3, None, None) and got["2"].error == "blank reply"


def test_prompts(spark):
    ranked = spark.createDataFrame([("1", 2, "", "two"), ("1", 1, "T", "one")], "qid string, rank int, title string, content string")
    assert prompts.context_of(ranked).first().context == "- T: one\n- two\n"
    df = spark.createDataFrame([(None, None)], "lang string, context string")
    assert df.select(prompts.system_prompt("{{now}} {{lang}} {{context}}", F.lit("N"), F.col("lang"), F.col("context")).alias("p")).first().p == f"N vi {prompts.NO_CONTEXT}"


def test_question_stream(spark, tmp_path):
    index = bm25.build(spark.createDataFrame([(0, "a", "", "xx yy", "", "en")], "ord long, doc_id string, title string, content string, category string, lang string"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"qid": "1", "query": "xx", "lang": "en"}\n')
    got = []
    S.answer_stream(S.question_feed(spark, str(tmp_path / "in")), index, 3, lambda df, n: got.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert [(r.qid, r.doc_id, r.rank) for r in got] == [("1", "a", 1)]


def test_windowed_stream(spark, tmp_path):
    schema = "metric_id long, created_at timestamp, lang string, outcome string, latency_ms long"
    rows = spark.createDataFrame([(1, "2021-01-01 00:10:00", "vi", "ok", 5), (1, "2021-01-01 00:10:00", "vi", "ok", 5), (2, "2021-01-01 00:20:00", "vi", "error", 9), (3, None, "vi", "ok", 1), (4, "2021-01-01 02:00:00", "en", "ok", None)], "metric_id long, created_at string, lang string, outcome string, latency_ms long").selectExpr("metric_id", "cast(created_at AS timestamp) AS created_at", "lang", "outcome", "latency_ms")
    rows.write.parquet(str(tmp_path / "m"))
    S.windowed_turns(spark.readStream.schema(schema).parquet(str(tmp_path / "m"))).writeStream.format("memory").queryName("turns").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    wanted = {tuple(r) for r in S.windowed_turns(rows).collect()}
    assert {tuple(r) for r in spark.table("turns").collect()} == wanted and len(wanted) == 2
