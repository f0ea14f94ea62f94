"""Analytics of judgements: agreement of two raters, confusion, percentiles, samples, and merging of label sheets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlake.session import WHITE, broadcast_if_small, durable, stripped

#: The labels, grounded, fabricated, rightly and needlessly refused.
LABELS = ["co_can_cu", "bia", "tu_choi_dung", "tu_choi_thua"]
FAKE = "bia"
#: Ranges of values that a group is cut into before the ranges with wanted ranks are ranked.
SPLITS = 64


def plain_label(label: Column) -> Column:
    """A label in its plain spelling; null if it is none."""
    text = F.regexp_replace(stripped(F.lower(label)), rf"[-{WHITE}]+", "_")
    return F.when(label.isin(LABELS), label).when(text.isin(LABELS), text)


def agreement(pairs: DataFrame, human: str = "human", judge: str = "judge", keys: list[str] | None = None) -> DataFrame:
    """(keys..., n, exact, bia_match, bia_human, bia_caught, bia_false) of rows with both labels, in one pass."""
    h, j = F.col(human), F.col(judge)
    return pairs.where(h.isNotNull() & j.isNotNull()).groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(h == j).alias("exact"), F.count_if((h == FAKE) == (j == FAKE)).alias("bia_match"), F.count_if(h == FAKE).alias("bia_human"),
        F.count_if((h == FAKE) & (j == FAKE)).alias("bia_caught"), F.count_if((h != FAKE) & (j == FAKE)).alias("bia_false"),
    )


def judge_gate(agreed: DataFrame) -> DataFrame:
    """The agreement with whether it passes: at most one missed, at most one false, at least 80 % exact."""
    ok = (F.col("bia_human") - F.col("bia_caught") <= 1) & (F.col("bia_false") <= 1) & (F.col("exact") >= 0.8 * F.col("n"))
    return agreed.withColumn("passes", ok)


def confusion(pairs: DataFrame, human: str = "human", judge: str = "judge") -> DataFrame:
    """(human, one count per judge label): all labels have a row, also those that never occur."""
    spark = pairs.sparkSession
    rows = pairs.where(F.col(human).isNotNull() & F.col(judge).isNotNull()).groupBy(F.col(human).alias("human")).pivot(judge, LABELS).count()
    return spark.createDataFrame([(x,) for x in LABELS], "human string").join(rows, "human", "left").fillna(0)


def nearest_rank(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(keys..., n, one column per quantile): the value at rank round-half-even(q n), from 1 to n.

    Nulls and NaN do not count; groups without a value have no row; a null key is a group of its own.
    """
    return at_ranks(df, keys, value, {name: lambda n, q=q: F.bround(F.lit(q) * n) for name, q in qs.items()})


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], splits: int = SPLITS) -> DataFrame:
    """(keys..., n, one column per rank): the exact value at each rank, a function of the group's size n.

    No group is sorted in one task. A mergeable sketch cuts each group into `splits` ranges of values; the rows in each
    range are counted, and only the range that holds a wanted rank is looked at: there, equal values are merged first and
    then ranked. The sketch only says where to cut, so its error changes nothing in the result.
    """
    kind = df.schema[value].dataType.simpleString()
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(value) if kind in ("double", "float") else F.col(value).isNotNull())
    # Keys are numbered as text, so that a null key joins with itself.
    name = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])) if keys else F.lit("")
    rows = kept.select(name.alias("_g"), *keys, F.col(value).alias("_v"))
    points = [i / splits for i in range(1, splits)]
    groups = durable(rows.groupBy("_g", *keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", points, 8 * splits).alias("_cuts")))
    wanted = F.array(*[F.struct(F.lit(q).alias("q"), F.greatest(F.lit(1), F.least(F.col("n"), rank(F.col("n")).cast("long"))).cast("long").alias("r")) for q, rank in ranks.items()])
    asked = groups.select("_g", F.explode(wanted).alias("w")).select("_g", "w.q", "w.r")
    ranged = rows.select("_g", "_v").join(broadcast_if_small(groups.select("_g", F.array_distinct("_cuts").alias("_cuts"))), "_g").select("_g", "_v", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_range"))
    counts = ranged.groupBy("_g", "_range").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))  # `splits` rows a group
    held = asked.join(counts.withColumn("upto", upto), "_g").where((F.col("r") <= F.col("upto")) & (F.col("r") > F.col("upto") - F.col("c")))
    held = durable(held.select("_g", "_range", "q", (F.col("r") - F.col("upto") + F.col("c")).alias("r")))
    inside = ranged.join(broadcast_if_small(held.select("_g", "_range").distinct()), ["_g", "_range"], "left_semi").groupBy("_g", "_range", "_v").agg(F.count(F.lit(1)).alias("c"))
    ranked = inside.withColumn("upto", F.sum("c").over(Window.partitionBy("_g", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    found = ranked.join(broadcast_if_small(held), ["_g", "_range"]).where(F.col("upto") >= F.col("r")).groupBy("_g").agg(*[F.min(F.when(F.col("q") == q, F.col("_v"))).alias(q) for q in ranks])
    return groups.select("_g", *keys, "n").join(found, "_g").select(*keys, "n", *ranks)


def stratified_sample(df: DataFrame, stratum: str, key: str, quota: dict[str, int], seed: int) -> DataFrame:
    """At most the quota of each stratum, the same rows for the same seed: the lowest hashes of seed and key.

    A sampling operator: strata without a quota are left out. The limit by the largest quota lets every task cut a large
    stratum down before it is shuffled.
    """
    if not quota:
        return df.where("false")
    limit = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    wanted = df.where(F.col(stratum).isin(list(quota))).withColumn("_h", F.xxhash64(F.lit(seed), key))
    order = Window.partitionBy(stratum).orderBy("_h", key)
    return wanted.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(quota.values())).where(F.col("_r") <= limit[F.col(stratum)]).drop("_h", "_r")


def shuffled(df: DataFrame, key: str, seed: int, prefix: str, width: int = 2) -> DataFrame:
    """Rows numbered from 1 in a seeded order, with a padded name such as c01.

    The order comes from one range-partitioned sort, which is kept before it is used: offsets and places must be those of
    the same partitions. A number is the partition's offset plus the place in it. Equal rows get numbers of their own; an
    empty table gives none.
    """
    placed = df.withColumn("_h", F.xxhash64(F.lit(seed), key)).orderBy("_h", key).withColumn("_m", F.monotonically_increasing_id())
    kept = durable(placed.drop("_h")).withColumn("_p", F.shiftright("_m", 33))
    counts = kept.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_o"))  # a row per partition
    number = F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    numbered = kept.join(broadcast_if_small(before), "_p").withColumn("number", number)
    return numbered.withColumn("name", F.concat(F.lit(prefix), F.when(F.length(F.col("number").cast("string")) < width, F.lpad(F.col("number").cast("string"), width, "0")).otherwise(F.col("number").cast("string")))).drop("_m", "_p", "_o")


def merge_sheets(new: DataFrame, old: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """A regenerated sheet with the labels entered before: new rows win except for the label columns of labelled rows."""
    entered = old.where(" OR ".join(f"trim(coalesce({c}, '')) <> ''" for c in labels)).select(key, F.struct(*labels).alias("_old"))
    merged = new.join(entered, key, "left")
    return merged.withColumns({c: F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(c)) for c in labels}).drop("_old")


def copy_if_verbatim(run: DataFrame, earlier: DataFrame, key: str, text: str, labels: list[str]) -> DataFrame:
    """The run with the earlier run's labels if every answer is the same after trimming, else as it is."""
    paired = run.join(earlier.select(key, F.col(text).alias("_text"), F.struct(*labels).alias("_old")), key, "left")
    if not paired.agg(F.bool_and(F.coalesce(F.trim(text) == F.trim("_text"), F.lit(False)))).first()[0]:
        return run
    return paired.withColumns({c: F.col(f"_old.{c}") for c in labels}).drop("_text", "_old")


def drifted(rebuilt: DataFrame, recorded: DataFrame, key: str, text: str) -> DataFrame:
    """(key) of the items whose text is no longer that recorded."""
    return rebuilt.join(recorded.select(key, F.col(text).alias("_text")), key).where(~F.col(text).eqNullSafe(F.col("_text"))).select(key)


def override(human: Column, judge: Column) -> Column:
    """The label to confirm: the judge's unless it says fabricated, which needs a human's own label."""
    return F.when(judge != FAKE, judge).when(plain_label(human).isNotNull(), human).otherwise(F.lit(""))


def throughput(tokens: Column, latency_ms: Column) -> Column:
    """Tokens a second, where both are known and positive."""
    return F.when((tokens > 0) & (latency_ms > 0), tokens / (latency_ms / 1000.0))


def require_labelled(items: DataFrame, key: str, human: str) -> DataFrame:
    """items, or an error that names one whose human label is none of the four: a judge may not see them before."""
    open_ = items.where(plain_label(F.col(human)).isNull())
    found = open_.orderBy(key).select(key).first()
    if found is not None:
        raise ValueError(f"{open_.count()} items lack a human label, such as {found[0]!r}")
    return items


def unlabelled(items: DataFrame, key: str, human: str) -> DataFrame:
    """(key) of the items that `require_labelled` refuses."""
    return items.where(plain_label(F.col(human)).isNull()).select(key)


def caught_by_key(items: DataFrame, answer_key: DataFrame, key: str, planted: str, judge: str) -> DataFrame:
    """(planted, total, caught): of the items that the answer key says are fabricated, how many the judge calls so.

    The key is an inner join: items it lacks, or that it gives no kind, are no planted errors.
    """
    kinds = answer_key.where(F.col(planted).isNotNull()).select(key, planted).distinct()
    return items.join(kinds, key).groupBy(planted).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(judge) == FAKE).alias("caught"))


def compare_runs(answers: DataFrame, run: str, human: str, judge: str) -> DataFrame:
    """One row per run: answers judged, fabricated by judge and by human, still to be labelled, and the other labels.

    A run without any judged answer is said to be `not judged`, and its counts by the judge are null.
    """
    h, j = plain_label(F.col(human)), plain_label(F.col(judge))
    rows = answers.select(F.col(run).alias("run"), h.alias("h"), j.alias("j"))
    found = rows.groupBy("run").agg(
        F.count(F.lit(1)).alias("answers"), F.count("j").alias("judged"), F.count_if(F.col("j") == FAKE).alias("fake_judge"), F.count_if(F.col("h").isNull()).alias("pending"), F.count_if(F.col("h") == FAKE).alias("fake_human"),
        *[F.count_if(F.col("j") == x).alias(x) for x in LABELS if x != FAKE],
    )
    by_judge = ["fake_judge", *(x for x in LABELS if x != FAKE)]
    some = F.col("judged") > 0
    return found.withColumns({c: F.when(some, F.col(c)) for c in by_judge}).withColumn("state", F.when(some, "judged").otherwise("not judged"))


def parse_label(text: Column) -> Column:
    """(label, reason, error) from a judge's reply: the JSON object in it, fenced or not."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(F.nullif(found, F.lit("")), "nhan string, ly_do string")
    label = F.lower(F.trim(parsed["nhan"]))
    error = F.when(found == "", "no JSON").when(label.isNull() | ~label.isin(LABELS), "unknown label")
    return F.struct(F.when(label.isin(LABELS), label).alias("label"), F.when(label.isin(LABELS), parsed["ly_do"]).alias("reason"), error.alias("error"))
