"""Filling containers of several capacities with items (problem 9): variable-capacity best-fit on the size histogram.

What is packed is the histogram of sizes: at most `largest capacity` different sizes whatever the number of items, so
the planning runs on the driver in bounded memory and sees the whole corpus at once. Sizes are taken in decreasing order
and put, many items at a time, into the fullest open bins they fit; if none fits, the bin kind of least expected cost is
opened: for each kind, the room beside the item is filled in thought with what the histogram still holds, largest first,
the bin is downsized to its contents, and the cost is the share of its space that stays empty. Where kinds cost the same,
smaller or larger ones may be opened; both plans are made, and with them the one that opens the largest kind only, and the
plan that leaves the least space unused is kept. In the end every bin is downsized to the smallest capacity that holds its
contents. The plan says, for each size, which run of its items goes to which bins; items find their bin by their rank
among the items of their size, which is counted in salted buckets so that no size, however frequent, is ranked in one task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlake.session import durable

RANK_BUCKETS = 64
#: How to choose among bin kinds of equal cost; `largest` opens no other kind.
POLICIES = ("smaller", "larger", "largest")


@dataclass
class Plan:
    """Runs of items: the items of `size` with rank from `first` on fill `bins` bins from `bin` on, `each` to a bin."""

    size: np.ndarray
    first: np.ndarray
    each: np.ndarray
    bin: np.ndarray
    bin_first: np.ndarray  # of each pattern: its first bin
    capacity: np.ndarray  # of each pattern
    used: np.ndarray  # of each pattern
    bins: np.ndarray  # of each pattern: how many bins hold it


def expected_fill(room: int, ascending: list[int], upto: int, counts: dict[int, int]) -> int:
    """How much of a room the sizes ascending[:upto] fill, largest first, as many of each as there are and fit."""
    filled = 0
    while upto and room:
        upto = bisect.bisect_right(ascending, room, 0, upto)
        if upto:
            size = ascending[upto - 1]
            taken = min(counts[size], room // size) * size
            filled, room, upto = filled + taken, room - taken, upto - 1
    return filled


def opening(size: int, ascending: list[int], upto: int, counts: dict[int, int], capacities: list[int], policy: str = "smaller") -> int:
    """The capacity to open for an item of this size: least expected share of unused space, after downsizing.

    ascending[:upto] are the sizes that are still to be packed, this one included, counts how many there are of each.
    """
    if policy == "largest":
        return capacities[-1]
    best, best_cost = capacities[-1], None
    for c in capacities if policy == "smaller" else reversed(capacities):
        if c >= size:
            counts[size] -= 1
            filled = size + expected_fill(c - size, ascending, upto, counts)
            counts[size] += 1
            cost = (capacities[bisect.bisect_left(capacities, filled)] - filled) / filled
            if best_cost is None or cost < best_cost:
                best, best_cost = c, cost
    return best


def plan_histogram(sizes: dict[int, int], capacities: list[int]) -> Plan:
    """The plan of least unused space over a histogram size -> number of items; every size must fit the largest capacity."""
    plans = [best_fit(sizes, capacities, policy) for policy in POLICIES]
    return min(plans, key=lambda p: (unused(p), len(p.used)))


def unused(plan: Plan) -> int:
    """The space that a plan leaves empty."""
    return int(((plan.capacity - plan.used) * plan.bins).sum())


def best_fit(sizes: dict[int, int], capacities: list[int], policy: str) -> Plan:
    """Best-fit decreasing with one way to choose among the capacities."""
    capacities = sorted(set(capacities))
    ascending, counts = sorted(sizes), dict(sizes)
    # Open bins by space left: space -> list of [bins, pattern], a pattern being a tuple of (size, each) in filling order.
    space: dict[int, list[list]] = {}
    spaces: list[int] = []

    def put(room: int, bins: int, pattern: tuple, cap: int) -> None:
        if room not in space:
            space[room] = []
            bisect.insort(spaces, room)
        space[room].append([bins, pattern, cap])

    for upto, size in zip(range(len(ascending), 0, -1), reversed(ascending), strict=True):
        while counts[size]:
            todo = counts[size]
            at = bisect.bisect_left(spaces, size)
            if at < len(spaces):
                room = spaces[at]
                group = space[room]
                bins, pattern, cap = group.pop()
                if not group:
                    del space[room]
                    spaces.pop(at)
            else:
                cap = opening(size, ascending, upto, counts, capacities, policy)
                room, pattern = cap, ()
                bins = -(-todo // (cap // size))
            each = min(room // size, todo)
            take = min(bins, todo // each)
            put(room - each * size, take, (*pattern, (size, each)), cap)
            counts[size] -= take * each
            if take < bins and pattern:
                put(room, bins - take, pattern, cap)
    out = {k: [] for k in ("size", "first", "each", "bin")}
    bin_first, caps, used, number = [], [], [], []
    next_bin, rank = 0, dict.fromkeys(sizes, 0)
    for room in sorted(space):
        for bins, pattern, _ in space[room]:
            contents = sum(s * e for s, e in pattern)
            bin_first.append(next_bin)
            caps.append(capacities[bisect.bisect_left(capacities, contents)])
            used.append(contents)
            number.append(bins)
            for size, each in pattern:
                for k, v in (("size", size), ("first", rank[size]), ("each", each), ("bin", next_bin)):
                    out[k].append(v)
                rank[size] += bins * each
            next_bin += bins
    order = np.lexsort((np.array(out["first"], np.int64), np.array(out["size"], np.int64)))
    runs = {k: np.array(v, np.int64)[order] for k, v in out.items()}
    return Plan(**runs, bin_first=np.array(bin_first, np.int64), capacity=np.array(caps, np.int64), used=np.array(used, np.int64), bins=np.array(number, np.int64))


def pieces_of(items: DataFrame, id_col: str, size_col: str, largest: int) -> DataFrame:
    """(_id, piece, start, size): items above the largest capacity are cut into full pieces and a rest, others stay whole."""
    sized = items.select(F.col(id_col).alias("_id"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("_all"))
    last = F.greatest(F.ceil(F.col("_all") / F.lit(largest)).cast("long"), F.lit(1)) - 1
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return cut.select("_id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest), F.col("_all") - F.col("piece") * largest).alias("size"))


def pack(items: DataFrame, id_col: str, size_col: str, capacities: list[int], rank_buckets: int = RANK_BUCKETS) -> DataFrame:
    """The bin of every item or piece: (id, piece, start, size, bin, capacity, used).

    Items of size 0 or null need no space: they get one row with null bin, capacity and used. Repeated rows are items of
    their own; further columns play no part. Nothing is dropped; only items above the largest capacity are cut. Ties in
    size are ordered by id and piece within a bucket, so the result does not depend on the partitioning.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    capacities = sorted(set(int(c) for c in capacities))
    pieces = durable(pieces_of(items, id_col, size_col, capacities[-1]).withColumn("_b", F.pmod(F.xxhash64("_id", "piece"), F.lit(rank_buckets))))
    counts = pieces.where("size > 0").groupBy("size", "_b").agg(F.count(F.lit(1)).alias("n"))
    counted = counts.toPandas().astype(np.int64)  # at most capacity x rank_buckets rows, whatever the number of items
    counted = counted.sort_values(["size", "_b"])
    plan = plan_histogram({int(s): int(n) for s, n in counted.groupby("size")["n"].sum().items()}, capacities)
    counted["offset"] = counted.groupby("size")["n"].cumsum() - counted["n"]
    # A row per size and bucket that occur, in their order.
    cells, offsets = counted["size"].to_numpy() * rank_buckets + counted["_b"].to_numpy(), counted["offset"].to_numpy()
    within = Window.partitionBy("size", "_b").orderBy("_id", "piece")
    ranked = pieces.where("size > 0").withColumn("_r", F.row_number().over(within).cast("long") - 1)
    id_type = items.schema[id_col].dataType.simpleString()
    radix = np.int64(1) << np.int64(40)
    keys = plan.size * radix + plan.first
    names = ["_id", "piece", "start", "size"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, bucket, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "_b", "_r"))
            index = offsets[np.searchsorted(cells, size * rank_buckets + bucket)] + rank
            run = np.searchsorted(keys, size * radix + index, side="right") - 1
            number = plan.bin[run] + (index - plan.first[run]) // plan.each[run]
            pattern = np.searchsorted(plan.bin_first, number, side="right") - 1
            arrays = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(number), pa.array(plan.capacity[pattern]), pa.array(plan.used[pattern])], names=[*names, "bin", "capacity", "used"])

    placed = ranked.select(*names, "_b", "_r").mapInArrow(place, f"_id {id_type}, piece long, start long, size long, bin long, capacity long, used long")
    rest = pieces.where("size <= 0").select(*names, *(F.lit(None).cast("long").alias(c) for c in ("bin", "capacity", "used")))
    return placed.unionByName(rest).withColumnRenamed("_id", id_col)


def packing_summary(placed: DataFrame) -> DataFrame:
    """Per capacity: bins, tokens held, space and the share of space left over."""
    bins = placed.where("bin IS NOT NULL").groupBy("bin", "capacity").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("pieces"))
    total = bins.groupBy("capacity").agg(F.count(F.lit(1)).alias("bins"), F.sum("pieces").alias("pieces"), F.sum("held").alias("held"), F.sum("capacity").alias("space"), F.max(F.col("held") > F.col("capacity")).alias("overfull"))
    return total.withColumn("unused_share", F.round(1 - F.col("held") / F.col("space"), 6))


def compare_plans(items: DataFrame, size_col: str, capacities: list[int]) -> dict[str, tuple[int, int]]:
    """(bins, unused space) of the plan that `pack` makes, and of best-fit with each single capacity, of the items' sizes.

    With a single capacity items above it are cut at it, and nothing is downsized.
    """
    capacities = sorted(set(int(c) for c in capacities))
    out = {}
    for name, kinds in [("joint", capacities), *((str(c), [c]) for c in capacities)]:
        pieces = pieces_of(items.withColumn("_n", F.lit(0)), "_n", size_col, kinds[-1]).where("size > 0")
        counts = {int(r["size"]): int(r["n"]) for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per size up to the capacity
        plan = plan_histogram(counts, kinds)
        out[name] = (int(plan.bins.sum()), unused(plan))
    return out
