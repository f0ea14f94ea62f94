import random

from pyspark.sql import functions as F

from weftlake.llm import consensus as C
from weftlake.llm import consensus_features as CF

LABELS = ["x", "y", "z"]


def simulated(seed=5, n=600):
    rng = random.Random(seed)
    skill = {"good1": 0.92, "good2": 0.88, "bad1": 0.45, "bad2": 0.4, "bad3": 0.42}
    truth = {f"i{i}": rng.choice(LABELS) for i in range(n)}
    votes = []
    for i, t in truth.items():
        for r, p in skill.items():
            if rng.random() < 0.8:
                # The bad ones err alike.
                votes.append((i, r, "s", t if rng.random() < p else (LABELS[0] if r[0] == "b" else rng.choice(LABELS))))
    feats = [(i, [float(t == "x"), rng.random()] if rng.random() < 0.9 else [0.0, rng.random()]) for i, t in truth.items()]
    return truth, votes, feats, skill


def test_beats_the_majority(spark):
    truth, votes, feats, skill = simulated()
    v = spark.createDataFrame(votes, "id string, rater string, certainty string, label string")
    f = spark.createDataFrame(feats, "id string, features array<double>")
    items, raters = C.consensus(v, f, 2, LABELS)
    got = {r.id: r for r in items.collect()}
    right = sum(got[i].label == t for i, t in truth.items() if i in got) / len(got)
    by_item = {}
    for i, _, _, lab in votes:
        by_item.setdefault(i, []).append(lab)
    majority = sum(max(sorted(set(x)), key=x.count) == truth[i] for i, x in by_item.items()) / len(by_item)
    assert right > majority and right > 0.9
    rel = {r.rater: r.reliability for r in raters.collect()}
    assert all(abs(rel[r] - p) < 0.15 for r, p in skill.items() if r[0] == "g") and min(rel["good1"], rel["good2"]) > max(rel[r] for r in rel if r[0] == "b")


def test_edges(spark):
    schema = "id string, rater string, certainty string, label string"
    none = spark.createDataFrame([], "id string, features array<double>")
    items, raters = C.consensus(spark.createDataFrame([], schema), none, 2, LABELS)
    assert items.collect() == [] and raters.collect() == []
    items, _ = C.consensus(spark.createDataFrame([("a", "r", None, "y"), ("b", "r", None, "x"), ("b", "q", None, "x")], schema), none, 2, LABELS)
    got = {r.id: r for r in items.collect()}
    assert (got["a"].label, got["a"].raters, got["a"].agreement) == ("y", 1, None) and (got["b"].label, got["b"].agreement) == ("x", 1.0)


def test_latest_votes(spark):
    rows = [("a", "r", "x", "2021-01-02", 1), ("a", "r", "y", "2021-01-01", 9), ("a", "r", None, "2021-01-05", 10), ("a", "q", "z", None, None), (None, "q", "z", None, None)]
    df = spark.createDataFrame(rows, "id string, rater string, label string, t string, row long").selectExpr("id", "rater", "cast(null AS string) AS certainty", "label", "cast(t AS timestamp_ntz) AS at", "row")
    assert {(r.rater, r.label) for r in C.latest_votes(df).collect()} == {("r", "x"), ("q", "z")}


def test_plain_label(spark):
    rows = [(" BIA\n", "bia"), ("co-can cu", "co_can_cu"), ("?", None), (None, None), ("", None)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "x string").select(C.plain_label(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [b for _, b in rows]


def test_krippendorff(spark):
    schema = "id string, rater string, certainty string, label string"
    same = spark.createDataFrame([(str(i), r, None, LABELS[i % 3]) for i in range(9) for r in "ab"], schema)
    assert C.krippendorff(same).first().alpha == 1.0
    assert C.krippendorff(spark.createDataFrame([("1", "a", None, "x"), ("1", "b", None, "y")], schema)).first().alpha == 0.0
    assert C.krippendorff(same.where("false")).count() == 1


def test_features(spark):
    assert [CF.kind_of("where?", a) for a in (None, "where ?", "Sorry, I do not have any details on that.", "Yes.", "The bus leaves at 5.")] == ["empty", "copy", "refusal", "brief", "answer"]
    df = spark.createDataFrame([("a", None, None, None, None), ("a", "q", "t", "co_tai_lieu", 2), (None, "q", "t", "x", 1)], "id string, query string, tra_loi string, loai string, hang_chunk_dung int")
    rows = CF.of_answers(df).collect()
    assert len(rows) == 1 and len(rows[0].features) == CF.WIDTH


def test_any_number_of_raters(spark):
    """Matrices as arrays and as a table give the same result."""
    _, votes, feats, _ = simulated(n=200)
    votes += [(f"i{i}", f"once{i}", None, LABELS[i % 3]) for i in range(40)]
    v = spark.createDataFrame(votes, "id string, rater string, certainty string, label string")
    f = spark.createDataFrame(feats, "id string, features array<double>")
    a, b = (C.consensus(v, f, 2, LABELS, rounds=4, bound=bound) for bound in (C.BOUND, 3))
    x, y = ({r.id: r for r in t[0].collect()} for t in (a, b))
    assert x.keys() == y.keys() and all((x[i].label, x[i].raters) == (y[i].label, y[i].raters) and abs(x[i].confidence - y[i].confidence) < 1e-6 and abs((x[i].agreement or 0) - (y[i].agreement or 0)) < 1e-9 for i in x)
    p, q = ({r.rater: (r.votes, round(r.reliability, 6)) for r in t[1].collect()} for t in (a, b))
    assert p == q and len(p) == 45
