import pytest
from pyspark.sql import functions as F

from weftlake.operators import answers, prompts
from weftlake.sources import models

QUICK = models.Policy(interval=0.0)


@pytest.fixture()
def items(spark):
    return spark.createDataFrame([("1", "when?", "en"), ("2", "where?", None), ("3", "when?", "en"), ("4", None, "vi"), ("5", "fail", "en")], "id string, query string, lang string")


@pytest.fixture()
def contexts(spark):
    return spark.createDataFrame([("1", "- noon\n"), ("3", "- noon\n")], "id string, context string")


def reply(system, user):
    if user == "fail":
        raise RuntimeError("down")
    return {"text": f"{user} {'noon' if 'noon' in system else prompts.NO_CONTEXT}", "completion_tokens": 7}


def test_generate(spark, items, contexts):
    got = {r.id: r for r in answers.generate(items, contexts, "{{lang}} {{now}} {{context}}", "N", reply, policy=QUICK).collect()}
    assert set(got) == {"1", "2", "3", "5"} and got["1"].text == "when? noon" and got["2"].text.endswith(prompts.NO_CONTEXT) and "down" in got["5"].error
    assert got["1"].key == got["3"].key != got["2"].key
    first = answers.generate(items, contexts, "{{lang}} {{now}} {{context}}", "N", reply, policy=QUICK).drop("id").distinct()
    kept = spark.createDataFrame(first.collect(), answers.CACHE)

    def never(system, user):
        return {"text": "called"}

    again = {r.id: r.text for r in answers.generate(items, contexts, "{{lang}} {{now}} {{context}}", "N", never, cache=kept, policy=QUICK).collect()}
    assert again["1"] == "when? noon" and again["5"] == "called"  # failures are asked again


def test_judge(spark, contexts):
    given = spark.createDataFrame([("1", "when?", "noon", "bia"), ("2", "where?", "here", "co_can_cu"), ("3", "x", None, None)], "id string, query string, text string, nhan_tay string")
    said = lambda system, user: {"text": '```json\n{"nhan": "bia", "ly_do": "r"}\n```' if "noon" in user else "no idea"}
    got = {r.id: tuple(r)[1:] for r in answers.judge(given, contexts, "rubric", said, policy=QUICK).collect()}
    assert got == {"1": ("bia", "r", None), "2": (None, None, "no JSON")}
    with pytest.raises(ValueError):
        answers.judge(given.withColumn("nhan_tay", F.lit("?")), contexts, "rubric", said, policy=QUICK)


def test_summary(spark):
    rows = spark.createDataFrame([("a", 100.0, 10, None), ("a", 300.0, None, None), ("a", 5.0, None, "down"), ("b", 1.0, None, "down")], "run string, latency_ms double, completion_tokens long, error string")
    got = {r.run: tuple(r)[1:] for r in answers.run_summary(rows, "run").collect()}
    assert got == {"a": (3, 1, 100.0, 300.0, 100.0), "b": (1, 1, None, None, None)}
