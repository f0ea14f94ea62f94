import random

import pytest

from weftlake.llm import packing


def check(rows, sizes, capacities):
    """Everything is placed once, whole unless too large, and no bin is overfull."""
    largest = max(capacities)
    held, parts = {}, {}
    for r in rows:
        parts.setdefault(r.id, []).append((r.piece, r.start, r.size))
        if r.bin is not None:
            held.setdefault(r.bin, [r.capacity, r.used, 0])[2] += r.size
            assert held[r.bin][:2] == [r.capacity, r.used]
    assert all(used == total <= cap and cap in capacities for cap, used, total in held.values())
    assert all(not any(c < cap and c >= used for c in capacities) for cap, used, _ in held.values())
    for i, size in sizes.items():
        got = sorted(parts.pop(i))
        assert sum(s for _, _, s in got) == size and (len(got) == 1 or size > largest) and all(s == largest for _, _, s in got[:-1])
        assert [a for _, a, _ in got] == [k * largest for k in range(len(got))]
    assert not parts
    return sum(c for c, _, _ in held.values())


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    rng = random.Random(seed)
    sizes = {i: rng.choice([0, 3, rng.randrange(1, 40), rng.randrange(1, 900)]) for i in range(3000)}
    capacities = [64, 256, 300]
    df = spark.createDataFrame([(i, s, "clash") for i, s in sizes.items()], "id long, n long, piece string")
    space = check(packing.pack(df, "id", "n", capacities).collect(), sizes, capacities)
    assert space <= 1.03 * sum(sizes.values()) + 300


def test_most_items_of_one_size(spark):
    sizes = {i: 7 if i % 3 else 5 for i in range(2000)}
    df = spark.createDataFrame(list(sizes.items()), "id long, n long")
    check(packing.pack(df, "id", "n", [16, 12]).collect(), sizes, [16, 12])


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, 0)], "id long, n long")
    assert {(r.id, r.bin, r.size) for r in packing.pack(df, "id", "n", [8]).collect()} == {(1, None, 0), (2, None, 0)}
    assert packing.pack(df.where("false"), "id", "n", [8]).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, "id", "n", [])


def test_partitioning_does_not_matter(spark):
    df = spark.range(500).selectExpr("id", "id % 37 AS n")
    a = {tuple(r) for r in packing.pack(df, "id", "n", [50]).collect()}
    assert a == {tuple(r) for r in packing.pack(df.repartition(9), "id", "n", [50]).collect()}


def test_opening_takes_the_kind_that_fills_best():
    """What is left over to fill the rest decides, not the sum of what is left."""
    kinds = [256, 512, 1024]
    open_ = lambda counts, size, policy="smaller": packing.opening(size, sorted(counts), len(counts), counts, kinds, policy)
    assert open_({250: 1}, 250) == 256
    assert open_({300: 1, 212: 1, 724: 1}, 300) == 512  # 300 + 212 fill it
    assert open_({300: 1, 724: 1}, 300) == 1024 and open_({300: 1, 200: 1}, 300) == 512
    assert open_({256: 9}, 256, "larger") == 1024 and open_({256: 9}, 256, "smaller") == 256 and open_({256: 9}, 256, "largest") == 1024
    assert packing.expected_fill(10, [3, 4], 2, {3: 5, 4: 1}) == 10


def test_joint_plan_is_no_worse_than_one_kind(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.choice([rng.randrange(1, 60), rng.randrange(200, 900)])) for i in range(400)], "id long, n long")
    found = packing.compare_plans(df, "n", [64, 256, 1024])
    assert all(found["joint"][1] <= v[1] for v in found.values())
    plans = [packing.best_fit({5: 3, 7: 2, 60: 1}, [16, 64], p) for p in packing.POLICIES]
    assert packing.unused(packing.plan_histogram({5: 3, 7: 2, 60: 1}, [16, 64])) == min(map(packing.unused, plans))
