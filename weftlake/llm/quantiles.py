"""Percentiles of very large numeric columns with bounded rank error (problem 7): mergeable rank-interval summaries.

A summary is a sorted list of (value, lowest rank, highest rank) tuples with the number of values and the accumulated
rank error. It is deterministic. Partitions build their summaries alone; summaries merge by adding rank intervals, which
adds up their errors and loses nothing else. Then they are compressed by the permitted uncertainty: a tuple goes if the
rank interval between the tuples left on either side of it stays within twice the permitted error, which grows by a small
share of epsilon n with every level of merging and never beyond epsilon n. So summaries of partitions, days or groups can
be put together later, and each carries its true bound: half the widest gap that a rank query can fall into.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Permitted rank error as a share of the number of values.
EPSILON = 0.005
#: Levels of merging that the permitted error is spread over; a summary keeps about LEVELS / (2 epsilon) tuples at most.
LEVELS = 16
#: Parts that the partial summaries of a group are merged in first, and tuples that a task holds before it hands them on.
LEVEL_ONE = 32
HELD_TUPLES = 2_000_000
#: Rows that a task collects before it sorts them by group.
CHUNK_ROWS = 400_000
SUMMARY = "n long, v array<double>, lo array<long>, hi array<long>, err long"

Summary = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def build(values: np.ndarray) -> Summary:
    """The exact summary of some values: a repeated value has a tuple for its first and one for its last rank."""
    v, counts = np.unique(values, return_counts=True)
    last = np.cumsum(counts)
    ranks = np.stack([last - counts + 1, last], axis=1)
    keep = np.stack([np.ones(len(v), bool), counts > 1], axis=1)
    ranks, v = ranks[keep], np.repeat(v, 2).reshape(-1, 2)[keep]
    return int(len(values)), v, ranks, ranks.copy()


def merge(a: Summary, b: Summary) -> Summary:
    """The summary of both: a tuple's ranks are raised by what the other summary knows to lie before it.

    Equal values of a come before those of b.
    """
    if not a[0] or not b[0]:
        return b if not a[0] else a
    parts = []
    for (_, v, lo, hi), (m, w, wlo, whi), side in ((a, b, "left"), (b, a, "right")):
        k = np.searchsorted(w, v, side=side)
        below = np.where(k > 0, wlo[np.maximum(k - 1, 0)], 0)
        above = np.where(k < len(w), whi[np.minimum(k, len(w) - 1)] - 1, m)
        parts.append((v, lo + below, hi + above))
    v, lo, hi = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((np.repeat([0, 1], [len(a[1]), len(b[1])]), v))
    return a[0] + b[0], v[order], lo[order], hi[order]


def _spans(s: Summary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each different value: it, the highest rank its first tuple can have and the lowest its last can have."""
    _, v, lo, hi = s
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    last = np.concatenate([first[1:], [len(v)]]) - 1
    return v[first], hi[first], lo[last]


def error(s: Summary) -> int:
    """The rank error bound of a summary: half of the widest gap between two values that it keeps."""
    if not s[0]:
        return 0
    _, first, last = _spans(s)
    return int(max(np.max((np.maximum(first[1:] - last[:-1], 0)) // 2, initial=0), 0))


def compress(s: Summary, epsilon: float, level: int | None = None) -> Summary:
    """s without the tuples that the permitted error makes needless.

    Permitted is, in ranks, the error s has already plus one level's share of epsilon n, but never more than epsilon n. A
    tuple is passed over while the gap from the highest rank of the next kept tuple down to the lowest of the last stays
    within twice that; first and last tuple stay, so minimum and maximum are exact.
    """
    n, v, lo, hi = s
    permitted = min(error(s) + epsilon * n / LEVELS, epsilon * n)
    if len(v) < 3 or permitted < 1:
        return s
    gap = 2 * permitted
    # From a kept tuple, the farthest tuple whose highest rank is within the gap; jumps are found for all tuples at once.
    reach = np.maximum(np.searchsorted(np.maximum.accumulate(hi), lo + gap, side="right") - 1, np.arange(len(v)) + 1)
    keep, at, last = [0], 0, len(v) - 1
    steps = reach.tolist()
    while at < last:
        at = min(steps[at], last)
        keep.append(at)
    keep = np.array(keep)
    return n, v[keep], lo[keep], hi[keep]


def query(s: Summary, q: float) -> tuple[float | None, int]:
    """The value at nearest rank ceil(q n) (at least 1), and the bound of its rank error; (None, 0) if empty."""
    if not s[0]:
        return None, 0
    r = max(1, int(np.ceil(q * s[0] - 1e-9)))
    v, first, last = _spans(s)
    off = np.maximum(np.maximum(first - r, r - last), 0)
    i = int(np.argmin(off))
    return float(v[i]), int(off[i])


class Collector:
    """The summary of a stream of values: full buffers become summaries, which merge only with others of their size."""

    def __init__(self, epsilon: float, buffer: int = 8192) -> None:
        self.epsilon, self.buffer, self.waiting, self.size, self.levels = epsilon, buffer, [], 0, {}

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.size += len(values)
        if self.size >= self.buffer:
            self._settle()

    def _settle(self) -> None:
        if not self.size:
            return
        s, level = compress(build(np.concatenate(self.waiting)), self.epsilon), 0
        self.waiting, self.size = [], 0
        while level in self.levels:
            s, level = compress(merge(self.levels.pop(level), s), self.epsilon), level + 1
        self.levels[level] = s

    def held(self) -> int:
        return self.size + sum(len(s[1]) for s in self.levels.values())

    def summary(self) -> Summary:
        self._settle()
        out = None
        for level in sorted(self.levels):
            out = self.levels[level] if out is None else compress(merge(self.levels[level], out), self.epsilon)
        return out


def together(parts: list[Summary], epsilon: float) -> Summary:
    """One summary of several, in pairs of about equal size, whatever their order: the error grows with the tree's depth."""
    parts = sorted(parts, key=lambda s: (s[0], s[1].tolist(), s[2].tolist()))
    while len(parts) > 1:
        parts = [compress(merge(*parts[i : i + 2]), epsilon) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


_PACKED = [("n", pa.int64()), ("v", pa.list_(pa.float64())), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64())), ("err", pa.int64())]


_NO_KEYS = pa.RecordBatch.from_arrays([], names=[])


def _batch(keys: pa.RecordBatch, found: list[Summary]) -> pa.RecordBatch:
    """Summaries as rows, with the key columns of as many rows."""
    ends = np.concatenate([[0], np.cumsum([len(s[1]) for s in found])]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([s[i] for s in found]).astype(kind))) for i, kind in ((1, np.float64), (2, np.int64), (3, np.int64))]
    columns = [pa.array([s[0] for s in found], pa.int64()), *lists, pa.array([error(s) for s in found], pa.int64())]
    return pa.RecordBatch.from_arrays([*keys.columns, *columns], names=[*keys.schema.names, *(n for n, _ in _PACKED)])


def _unpacked(batch: pa.RecordBatch) -> list[Summary]:
    n = batch.column("n").to_numpy()
    v, lo, hi = (batch.column(c) for c in ("v", "lo", "hi"))
    ends = v.offsets.to_numpy()
    flat = [x.values.to_numpy(zero_copy_only=False) for x in (v, lo, hi)]
    at = [x.offsets.to_numpy() for x in (v, lo, hi)]
    return [(int(n[i]), *(f[o[i] : o[i + 1]] for f, o in zip(flat, at, strict=True))) for i in range(len(ends) - 1)]


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), SUMMARY])


def summarise(df: DataFrame, keys: list[str], value: str | Column, epsilon: float = EPSILON) -> DataFrame:
    """One summary per group: (keys..., n, v, lo, hi, err), of the values that are not null and not NaN.

    A null in a key column is a group of its own. Groups without a value have no row; an empty table gives none. Every
    task keeps bounded summaries of the groups it meets, so a group that holds most of the rows costs no more than others,
    and hands all of them on when they hold too many tuples, so any number of groups fits; the partial summaries are merged
    in two levels.
    """
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*keys, number.alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x)")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Collector] = {}
        first: dict[tuple, pa.RecordBatch] = {}

        def take(chunk: pa.Table) -> None:
            x = chunk.column("_x").to_numpy()
            code = np.zeros(len(x), np.int64)
            for k in keys:
                part = chunk.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
                part = part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part
                code = code * max(len(part.dictionary), 1) + part.indices.to_numpy()
                code = np.unique(code, return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            begins = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) > 0])) if len(x) else np.zeros(0, np.int64)
            heads = chunk.select(keys).take(pa.array(order[begins])).combine_chunks()
            names = list(zip(*(heads.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * len(begins)
            for i, (name, values) in enumerate(zip(names, np.split(x[order], begins[1:]), strict=True)):
                if name not in held:
                    held[name] = Collector(epsilon)
                    first[name] = heads.slice(i, 1)
                held[name].add(values)

        def handed() -> Iterator[pa.RecordBatch]:
            names = list(held)
            for i in range(0, len(names), 256):
                part = names[i : i + 256]
                heads = pa.concat_tables([first[n] for n in part]).combine_chunks() if keys else None
                yield _batch(heads.to_batches()[0] if keys else _NO_KEYS, [held[n].summary() for n in part])
            held.clear()
            first.clear()

        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= CHUNK_ROWS:
                take(pa.Table.from_batches(waiting))
                waiting, size = [], 0
                if sum(c.held() for c in held.values()) > HELD_TUPLES:
                    yield from handed()
        if size:
            take(pa.Table.from_batches(waiting))
        if held:
            yield from handed()

    return merge_summaries(rows.mapInArrow(partial, _schema(rows, keys)), keys, epsilon)


def _combined(names: list[str], epsilon: float):
    """Merges consecutive summaries with equal key columns, many groups to a batch, a bounded number of parts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, parts = None, None, []
        heads: list[pa.RecordBatch] = []
        done: list[Summary] = []

        def out() -> pa.RecordBatch:
            batch = _batch(pa.Table.from_batches(heads).combine_chunks().to_batches()[0] if names else _NO_KEYS, done)
            heads.clear()
            done.clear()
            return batch

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in names), strict=True)) if names else [()] * batch.num_rows
            for i, s in enumerate(_unpacked(batch)):
                if parts and keys[i] != key:
                    heads.append(head)
                    done.append(together(parts, epsilon))
                    parts = []
                    if len(done) == 256:
                        yield out()
                if not parts:
                    key, head = keys[i], batch.select(names).slice(i, 1)
                parts.append(s)
                if len(parts) == 64:
                    parts = [together(parts, epsilon)]
        if parts:
            heads.append(head)
            done.append(together(parts, epsilon))
        if done:
            yield out()

    return run


def merge_summaries(summaries: DataFrame, keys: list[str], epsilon: float = EPSILON) -> DataFrame:
    """Summaries of the groups of keys, put together from summaries of finer groups or of parts of the data.

    Two levels: a group's summaries are first merged in `LEVEL_ONE` parts, told by their content, then these. Groups are
    read one after another from sorted partitions.
    """
    rows = summaries.select(*keys, "n", "v", "lo", "hi", "err").withColumn("_s", F.pmod(F.xxhash64("n", "v", "lo"), F.lit(LEVEL_ONE)).cast("int"))
    order = [F.col("n"), F.hash("v", "lo")]
    names = [*keys, "_s"]
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in names), SUMMARY])
    first = rows.repartition(*names).sortWithinPartitions(*names, *order).mapInArrow(_combined(names, epsilon), schema).drop("_s")
    second = (first.repartition(*keys) if keys else first.coalesce(1)).sortWithinPartitions(*keys, *order)
    return second.mapInArrow(_combined(keys, epsilon), _schema(rows, keys))


def percentiles(summaries: DataFrame, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """(keys..., n, one column per named quantile, rank_error, error_bound).

    rank_error is the largest bound among the quantiles, error_bound that of any quantile, as the summary carries it.
    """
    types = dict(summaries.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n long", *(f"`{name}` double" for name in qs), "rank_error long, error_bound long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[query(s, q) for q in qs.values()] for s in _unpacked(batch)]
            columns = [pa.array([f[i][0] for f in found], pa.float64()) for i in range(len(qs))]
            worst = pa.array([max((x[1] for x in f), default=0) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("n"), *columns, worst, batch.column("err")], names=[*keys, "n", *qs, "rank_error", "error_bound"])

    return summaries.select(*keys, "n", "v", "lo", "hi", "err").mapInArrow(run, schema)
