from weftlake.operators.diff import diff_by_key, diff_summary

SCHEMA = "k string, v long, a string, n int, extra string"
FIELDS = ["a", "n"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_differences(spark):
    left = spark.createDataFrame([("x", 1, "old", 1, "l"), (" x ", 2, "new", 1, "l"), ("only", 1, None, None, ""), ("same", 1, None, 2, "p"), ("same", 1, None, 2, "p"), (None, 9, "q", 1, "")], SCHEMA)
    right = spark.createDataFrame([("x", 7, "new ", None, "r"), ("same", 3, None, 2, "q"), ("\t r", 1, "", 0, "")], SCHEMA)
    assert rows(diff_by_key(left, right, "k", FIELDS, latest="v")) == [("only", "left_only"), ("r", "right_only"), ("x", "a"), ("x", "n")]
    assert ("x", "a", "new", "new ") in rows(diff_by_key(left, right, "k", FIELDS, latest="v", values=True))
    assert rows(diff_summary(diff_by_key(left, right, "k", FIELDS, latest="v"))) == [("a", 1), ("left_only", 1), ("n", 1), ("right_only", 1)]


def test_null_is_not_empty(spark):
    left, right = spark.createDataFrame([("x", 1, None, 1, "")], SCHEMA), spark.createDataFrame([("x", 1, "", 1, "")], SCHEMA)
    assert rows(diff_by_key(left, right, "k", FIELDS, latest="v")) == [("x", "a")]


def test_empty_sides(spark):
    some, none = spark.createDataFrame([("x", 1, "a", 1, "")], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert rows(diff_by_key(none, none, "k", FIELDS)) == []
    assert rows(diff_by_key(some, none, "k", FIELDS)) == [("x", "left_only")]


def test_ties_are_settled_by_values(spark):
    left = spark.createDataFrame([("x", 1, "a", 1, ""), ("x", 1, "b", 1, "")], SCHEMA)
    right = spark.createDataFrame([("x", 1, "b", 1, "")], SCHEMA)
    assert rows(diff_by_key(left.repartition(3), right, "k", FIELDS, latest="v")) == []


def test_hot_key_and_awkward_names(spark):
    schema = "`the key` string, k long, l string, `o'dd` string"
    left = spark.range(5000).selectExpr("'hot' AS `the key`", "id AS k", "'x' AS l", "cast(id AS string) AS `o'dd`")
    right = spark.createDataFrame([("hot", 1, "y", "4999")], schema)
    assert rows(diff_by_key(left, right, "the key", ["l", "o'dd"], latest="k")) == [("hot", "l")]


def test_one_exchange(spark):
    d = spark.createDataFrame([("x", 1, "a", 1, "")], SCHEMA)
    plan = diff_by_key(d, d, "k", FIELDS, latest="v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
