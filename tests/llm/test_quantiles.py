import numpy as np
import pytest

from weftlake.llm import quantiles as Q

QS = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}


def true_error(values, q, v):
    xs = np.sort(values)
    r = max(1, int(np.ceil(q * len(xs) - 1e-9)))
    return max(0, np.searchsorted(xs, v, "left") + 1 - r, r - np.searchsorted(xs, v, "right"))


@pytest.mark.parametrize("seed", range(12))
def test_bound_holds_and_is_small(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.choice([1, 7, 900, 60_000, 200_000]))
    x = rng.integers(0, int(rng.choice([1, 3, 60, 10**6])), n).astype(float) if seed % 2 else rng.lognormal(5, 2, n).round(int(rng.choice([0, 5])))
    parts = []
    for p in np.array_split(x, int(rng.choice([1, 5, 40]))):
        if len(p):
            c = Q.Collector(Q.EPSILON)
            for b in np.array_split(p, int(rng.choice([1, 6]))):
                c.add(b)
            parts.append(c.summary())
    while len(parts) > 1:
        parts = [Q.compress(Q.merge(*parts[i : i + 2]), Q.EPSILON) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    assert parts[0][0] == n and Q.error(parts[0]) <= Q.EPSILON * n + 1 and len(parts[0][1]) <= 2 * Q.LEVELS / Q.EPSILON
    for q in QS.values():
        v, e = Q.query(parts[0], q)
        assert true_error(x, q, v) <= e <= Q.EPSILON * n + 1


def test_tables(spark):
    rows = [("a", i % 2, float(i)) for i in range(1000)] + [("a", None, None), (None, 1, 5.0), ("b", 1, float("nan"))]
    df = spark.createDataFrame(rows, "g string, d int, n double").repartition(7)
    daily = Q.summarise(df, ["g", "d"], "n")
    got = {(r.g, r.d): r for r in Q.percentiles(daily, ["g", "d"], QS).collect()}
    assert set(got) == {("a", 0), ("a", 1), (None, 1)} and got[("a", 0)].p50 == 498.0 and got[(None, 1)].p99 == 5.0
    total = Q.percentiles(Q.merge_summaries(daily, ["g"]), ["g"], QS)
    r = {x.g: x for x in total.collect()}["a"]
    assert (r.n, r.p0, r.p50, r.p100, r.rank_error) == (1000, 0.0, 499.0, 999.0, 0)
    assert Q.percentiles(Q.summarise(df.where("false"), ["g"], "n"), ["g"], QS).collect() == []
    one = Q.percentiles(Q.summarise(df, [], "n"), [], QS).first()
    assert one.n == 1001


def test_partitions_do_not_change_exact_results(spark):
    df = spark.range(3000).selectExpr("id % 3 AS g", "cast(id % 50 AS double) AS x")
    a = Q.percentiles(Q.summarise(df.repartition(1), ["g"], "x"), ["g"], QS).orderBy("g").collect()
    b = Q.percentiles(Q.summarise(df.repartition(13), ["g"], "x"), ["g"], QS).orderBy("g").collect()
    assert a == b


def test_compression_by_permitted_uncertainty():
    """What is left out lies between tuples whose gap is within twice the permitted error; ends stay exact."""
    s = Q.build(np.arange(100_000.0))
    c = Q.compress(s, 0.01)
    permitted = 0.01 * 100_000 / Q.LEVELS
    assert len(c[1]) < 1700 and Q.error(c) <= permitted and (c[1][0], c[1][-1]) == (0.0, 99_999.0)
    assert len(Q.compress(c, 0.01)[1]) < len(c[1]) and Q.error(Q.compress(c, 0.01)) <= 2 * permitted
    small = Q.build(np.arange(50.0))
    assert Q.compress(small, 0.01) is small


def test_many_groups_are_handed_on(spark, monkeypatch):
    """Tasks that hold too much hand their summaries on; the results are those of holding all."""
    df = spark.range(60_000).selectExpr("id % 500 AS g", "cast(pmod(hash(id), 1000) AS double) AS x").repartition(2)
    a = Q.percentiles(Q.summarise(df, ["g"], "x"), ["g"], QS).orderBy("g").collect()
    monkeypatch.setattr(Q, "HELD_TUPLES", 1000)
    monkeypatch.setattr(Q, "CHUNK_ROWS", 5000)
    b = Q.percentiles(Q.summarise(df, ["g"], "x"), ["g"], QS).orderBy("g").collect()
    assert a == b and len(a) == 500
