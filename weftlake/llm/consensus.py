"""Consensus from several annotators' labels (problem 3): feature-assisted expectation-maximisation.

A regularised multinomial classifier on item features and a confusion matrix per rater are fitted together. The E-step
weighs the classifier's output, as prior of the label, with what the votes say under the raters' matrices; the M-step
counts the matrices anew and moves the classifier against a fixed bound of its curvature, so the fit never gets worse.

Every kind of rater (a rater with a stated certainty) has a matrix of its own, however many there are. Up to `BOUND`
kinds, their matrices go to the tasks as arrays: an iteration is one pass over the items, whose tasks send the sums they
contribute (raters x labels x labels and features x labels). Beyond it the matrices stay a table: votes are joined with it
by rater, summed per item, and the posteriors joined back to the votes and summed per rater. Both give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlake.session import WHITE, broadcast_if_small, durable, stripped

LABELS = ["co_can_cu", "bia", "tu_choi_dung", "tu_choi_thua"]
#: Kinds of raters whose matrices are held as arrays.
BOUND = 5_000
ROUNDS, STOP = 25, 1e-4
#: Votes that every matrix begins with: for the right label and for each wrong one.
PRIOR_RIGHT, PRIOR_WRONG = 4.0, 1.0
L2 = 1.0


def plain_label(label: Column, labels: list[str] = LABELS) -> Column:
    """The label in its plain spelling, or null: case, white space around it and - or blanks for _ make no difference."""
    text = F.regexp_replace(stripped(F.lower(label)), rf"[-{WHITE}]+", "_")
    return F.when(label.isin(labels), label).when(text.isin(labels), text)


def latest_votes(votes: DataFrame) -> DataFrame:
    """(id, rater, certainty, label): each rater's last valid label of each item, of (id, rater, certainty, label, at, row).

    A later time wins, then a higher row; a missing time is earliest. Copies and labels that are none do not count.
    """
    valid = votes.where("id IS NOT NULL AND rater IS NOT NULL AND label IS NOT NULL")
    last = F.max(F.struct(F.coalesce(F.col("at"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), F.coalesce("row", F.lit(-1)).alias("row"), "label", "certainty"))
    return valid.groupBy("id", "rater").agg(last.alias("v")).select("id", "rater", "v.certainty", "v.label")


def _zeros(width: int):
    return F.array(*[F.lit(0.0)] * width) if width else F.array().cast("array<double>")


def _label_no(labels: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")).cast("int") - 1


def _pack_items(votes: DataFrame, features: DataFrame, kinds: list, labels: list[str], width: int) -> DataFrame:
    """Items with features and votes as codes: number of the kind of rater x labels + label."""
    table = votes.sparkSession.createDataFrame([(r.rater, r.certainty, i) for i, r in enumerate(kinds)], "rater string, certainty string, code int")
    coded = votes.join(broadcast_if_small(table), (votes.rater == table.rater) & votes.certainty.eqNullSafe(table.certainty)).select("id", (F.col("code") * len(labels) + _label_no(labels)).alias("vote"))
    grouped = coded.groupBy("id").agg(F.collect_list("vote").alias("votes"))  # a rater has one vote per item, so BOUND at most
    return durable(grouped.join(features, "id", "left").withColumn("features", F.coalesce("features", _zeros(width))))


def _posterior(x: np.ndarray, vote_item: np.ndarray, votes: np.ndarray, n: int, w: np.ndarray, log_conf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior, classifier's output) of n items; log_conf is (codes * labels) x labels, log P(vote | true label)."""
    k = w.shape[1]
    z = x @ w
    z -= z.max(axis=1, keepdims=True)
    prior = np.exp(z)
    prior /= prior.sum(axis=1, keepdims=True)
    s = np.log(prior)
    for j in range(k):
        s[:, j] += np.bincount(vote_item, weights=log_conf[votes, j], minlength=n)
    s -= s.max(axis=1, keepdims=True)
    q = np.exp(s)
    return q / q.sum(axis=1, keepdims=True), prior


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    votes = batch.column("votes")
    lengths = np.diff(votes.offsets.to_numpy())
    flat = votes.flatten().to_numpy(zero_copy_only=False)
    x = np.ones((n, width))
    x[:, 1:] = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(n, width - 1)
    return x, np.repeat(np.arange(n), lengths), flat.astype(np.int64)


def consensus(votes: DataFrame, features: DataFrame, width: int, labels: list[str] = LABELS, rounds: int = ROUNDS, bound: int = BOUND) -> tuple[DataFrame, DataFrame]:
    """(items, raters) from (id, rater, certainty, label), one row per rater and item, and (id, features array<double>).

    items: (id, label, confidence, raters, agreement): the most probable label, its probability, the number of raters and
    the share of pairs of them that agree (null for one rater). raters: (rater, votes, reliability): the estimated
    probability of a right label. A rater's votes are modelled apart by certainty (null is a kind of its own). Items
    without features have the intercept only; items without votes have no row; empty tables give empty results.
    """
    votes = durable(votes)
    kinds = durable(votes.groupBy("rater", "certainty").agg(F.count(F.lit(1)).alias("n")))
    found = kinds.orderBy(F.desc("n"), "rater", "certainty").limit(bound + 1).collect()
    if len(found) > bound:
        return _joined(votes, features, kinds, width, labels, rounds)
    k, codes = len(labels), max(len(found), 1)
    items = _pack_items(votes, features, found, labels, width)
    width = width + 1
    id_type = items.schema["id"].dataType.simpleString()
    w = np.zeros((width, k))
    prior_counts = np.full((codes, k, k), PRIOR_WRONG)
    prior_counts[:, range(k), range(k)] = PRIOR_RIGHT
    conf = prior_counts / prior_counts.sum(axis=1, keepdims=True)  # code, vote, true label
    curvature = None

    def sums(w: np.ndarray, log_conf: np.ndarray, with_products: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((codes * k, k))
            gradient = np.zeros((width, k))
            products = np.zeros((width, width))
            for batch in batches:
                x, item, vote = _arrays(batch, width)
                q, p = _posterior(x, item, vote, batch.num_rows, w, log_conf)
                for j in range(k):
                    counts[:, j] += np.bincount(vote, weights=q[item, j], minlength=codes * k)
                gradient += x.T @ (q - p)
                if with_products:
                    products += x.T @ x
            flat = np.concatenate([counts.ravel(), gradient.ravel(), products.ravel() if with_products else []])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.float64())], names=["at", "value"])

        return run

    for step in range(rounds):
        log_conf = np.log(conf).reshape(codes * k, k)
        partial = items.select("votes", "features").mapInArrow(sums(w, log_conf, curvature is None), "at long, value double")
        total = partial.groupBy("at").agg(F.sum("value").alias("value")).toPandas()
        flat = np.zeros(codes * k * k + width * k + width * width)
        flat[total["at"].to_numpy(np.int64)] = total["value"].to_numpy()
        counts = flat[: codes * k * k].reshape(codes, k, k)
        gradient = flat[codes * k * k : codes * k * k + width * k].reshape(width, k)
        if curvature is None:
            curvature = np.linalg.inv(0.5 * flat[codes * k * k + width * k :].reshape(width, width) + L2 * np.eye(width))
        before = conf
        conf = counts + prior_counts
        conf = conf / conf.sum(axis=1, keepdims=True)
        w = w + curvature @ (gradient - L2 * w)
        w -= w.mean(axis=1, keepdims=True)
        if step > 4 and np.abs(conf - before).max() < STOP:
            break

    log_conf = np.log(conf).reshape(codes * k, k)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, item, vote = _arrays(batch, width)
            q, _ = _posterior(x, item, vote, batch.num_rows, w, log_conf)
            each = np.stack([np.bincount(item, weights=vote % k == j, minlength=batch.num_rows) for j in range(k)], axis=1)
            n = each.sum(axis=1)
            pairs = n * (n - 1)
            agree = np.where(pairs > 0, (each * (each - 1)).sum(axis=1) / np.maximum(pairs, 1), np.nan)
            best = q.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([labels[b] for b in best], pa.string()), pa.array(q.max(axis=1)), pa.array(n.astype(np.int32)), pa.array(agree, from_pandas=True)],
                names=["id", "label", "confidence", "raters", "agreement"],
            )

    decided = items.select("id", "votes", "features").mapInArrow(decide, f"id {id_type}, label string, confidence double, raters int, agreement double")
    right = counts_right(conf, counts)
    rows = [(r.rater, int(r.n), float(p)) for r, (p, _) in zip(found, right, strict=False)]
    table = votes.sparkSession.createDataFrame(rows, "rater string, n long, right double")
    return decided, _per_rater(table)


def _per_rater(table: DataFrame) -> DataFrame:
    return table.groupBy("rater").agg(F.sum("n").alias("votes"), (F.sum(F.col("right") * F.col("n")) / F.sum("n")).alias("reliability"))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _joined(votes: DataFrame, features: DataFrame, kinds: DataFrame, width: int, labels: list[str], rounds: int) -> tuple[DataFrame, DataFrame]:
    """`consensus` with the matrices as a table, for any number of raters."""
    k, wide = len(labels), width + 1
    id_type = votes.schema["id"].dataType.simpleString()
    numbered = durable(votes.select("id", F.struct("rater", F.coalesce("certainty", F.lit("\0")).alias("certainty")).alias("kind"), _label_no(labels).alias("v")))
    items = durable(numbered.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"), *[F.count_if(F.col("v") == j).alias(f"c{j}") for j in range(k)]).join(features, "id", "left").withColumn("features", F.coalesce("features", _zeros(width))))
    cells = numbered.select("kind").distinct().withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    prior = lambda j: F.when(F.col("v") == j, F.lit(PRIOR_RIGHT)).otherwise(F.lit(PRIOR_WRONG))
    start = PRIOR_RIGHT + (k - 1) * PRIOR_WRONG
    conf = durable(cells.select("kind", "v", *[(prior(j) / start).alias(f"p{j}") for j in range(k)], *[F.lit(0.0).alias(f"m{j}") for j in range(k)]))
    w, curvature = np.zeros((wide, k)), None

    def posterior(conf: DataFrame, w: np.ndarray) -> DataFrame:
        """(id, q array, x array of features, p array) of every item."""
        said = numbered.join(conf.select("kind", "v", *[F.log(f"p{j}").alias(f"l{j}") for j in range(k)]), ["kind", "v"]).groupBy("id").agg(*[F.sum(f"l{j}").alias(f"l{j}") for j in range(k)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                x = np.ones((n, wide))
                x[:, 1:] = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(n, width)
                z = x @ w
                logs = np.stack([batch.column(f"l{j}").to_numpy(zero_copy_only=False) for j in range(k)], axis=1)
                p = _softmax(z)
                q = _softmax(np.log(np.maximum(p, 1e-300)) + logs)
                pack = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pack(q), pack(p), pack(x)], names=["id", "q", "p", "x"])

        return items.join(said, "id").select("id", "features", *[f"l{j}" for j in range(k)]).mapInArrow(run, f"id {id_type}, q array<double>, p array<double>, x array<double>")

    def sums(with_products: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gradient, products = np.zeros((wide, k)), np.zeros((wide, wide))
            for batch in batches:
                n = batch.num_rows
                q, p, x = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("q", "p", "x"))
                gradient += x.T @ (q - p)
                if with_products:
                    products += x.T @ x
            flat = np.concatenate([gradient.ravel(), products.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "value"])

        return run

    for step in range(rounds):
        post = durable(posterior(conf, w))
        total = post.select("q", "p", "x").mapInArrow(sums(curvature is None), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
        flat = np.zeros(wide * k + wide * wide)
        flat[total["at"].to_numpy(np.int64)] = total["value"].to_numpy()
        if curvature is None:
            curvature = np.linalg.inv(0.5 * flat[wide * k :].reshape(wide, wide) + L2 * np.eye(wide))
        mass = numbered.join(post.select("id", "q"), "id").groupBy("kind", "v").agg(*[F.sum(F.col("q")[j]).alias(f"m{j}") for j in range(k)])
        all_ = conf.select("kind", "v", *[F.col(f"p{j}").alias(f"b{j}") for j in range(k)]).join(mass, ["kind", "v"], "left").fillna(0.0)
        column = Window.partitionBy("kind")  # a row per label
        raised = all_.withColumns({f"p{j}": (F.col(f"m{j}") + prior(j)) / F.sum(F.col(f"m{j}") + prior(j)).over(column) for j in range(k)})
        conf = durable(raised)
        moved = conf.agg(F.max(F.greatest(*[F.abs(F.col(f"p{j}") - F.col(f"b{j}")) for j in range(k)]))).first()[0] or 0.0
        w = w + curvature @ (flat[: wide * k].reshape(wide, k) - L2 * w)
        w -= w.mean(axis=1, keepdims=True)
        if step > 4 and moved < STOP:
            break

    best = F.array_position("q", F.array_max("q")).cast("int")
    counts = [F.col(f"c{j}") for j in range(k)]
    agree = sum((c * (c - 1) for c in counts), F.lit(0)) / (F.col("n") * (F.col("n") - 1))
    decided = posterior(conf, w).join(items.select("id", "n", *[f"c{j}" for j in range(k)]), "id").select("id", F.element_at(F.array(*[F.lit(x) for x in labels]), best).alias("label"), F.array_max("q").alias("confidence"), F.col("n").alias("raters"), F.when(F.col("n") > 1, agree).alias("agreement"))
    # Of each kind of rater: the probability of a right label over the true labels it met.
    per = conf.groupBy("kind").agg(*[F.sum(f"m{j}").alias(f"m{j}") for j in range(k)], *[F.max(F.when(F.col("v") == j, F.col(f"p{j}"))).alias(f"r{j}") for j in range(k)])
    met = sum((F.col(f"m{j}") for j in range(k)), F.lit(0.0))
    right = F.when(met > 0, sum((F.col(f"m{j}") * F.col(f"r{j}") for j in range(k)), F.lit(0.0)) / met).otherwise(sum((F.col(f"r{j}") for j in range(k)), F.lit(0.0)) / k)
    votes_of = kinds.select(F.struct("rater", F.coalesce("certainty", F.lit("\0")).alias("certainty")).alias("kind"), "n")
    return decided, _per_rater(per.select("kind", right.alias("right")).join(votes_of, "kind").select(F.col("kind.rater").alias("rater"), "n", "right"))


def counts_right(conf: np.ndarray, counts: np.ndarray) -> list[tuple[float, float]]:
    """Of each rater code: the probability of a right label over the true labels it met, and the votes it rests on."""
    out = []
    for c, n in zip(conf, counts, strict=True):
        mass = n.sum(axis=0)
        total = mass.sum()
        share = mass / total if total > 0 else np.full(len(mass), 1 / len(mass))
        out.append((float((np.diag(c) * share).sum()), float(total)))
    return out


def krippendorff(votes: DataFrame) -> DataFrame:
    """(items, votes, alpha): nominal agreement over all items with at least two raters, 1 for perfect, 0 for chance."""
    per = votes.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
    sized = per.withColumn("m", F.sum("n").over(Window.partitionBy("id"))).where("m >= 2")
    by_item = sized.groupBy("id").agg(F.first("m").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    observed = by_item.agg(F.count(F.lit(1)).alias("items"), F.sum("m").alias("votes"), F.sum(F.col("m") - F.col("same") / (F.col("m") - 1)).alias("differ"), F.lit(1).alias("one"))
    expected = sized.groupBy("label").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("total"), F.sum(F.col("n") * (F.col("n") - 1)).alias("alike"), F.lit(1).alias("one"))
    by_chance = F.col("total") - F.col("alike") / (F.col("total") - 1)
    return observed.join(expected, "one").select("items", "votes", F.round(1 - F.try_divide(F.col("differ"), by_chance), 6).alias("alpha"))
