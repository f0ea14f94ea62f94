"""Differences between two copies of one dataset, field by field.

Both sides are tagged, united and grouped once by key: one shuffle, with a partial aggregate before it, so that a key
with very many superseded rows sends one row per input partition. The comparison of the two remaining structs is
generated as a higher-order expression and stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlake.session import stripped

LEFT_ONLY, RIGHT_ONLY = "left_only", "right_only"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Strings longer than this go through the shuffle as their length and hash where their values are not asked for.
LONG = 80


def _short(value: Column) -> Column:
    """A string as it is, or if it is long, its length and SHA-256; no short string looks like that, as it is longer."""
    return F.when(F.length(value) > LONG, F.concat(F.lit("#"), F.lpad(F.length(value).cast("string"), 20, "0"), F.lit(":"), F.sha2(value, 256))).otherwise(value)


def latest_pair(left: DataFrame, right: DataFrame, key: Column, key_name: str, fields: list[str], latest: str | None, hashed: bool = False) -> DataFrame:
    """One row per key with the struct of either side's current row (null: the side lacks the key).

    With `hashed`, long strings are replaced by their length and hash, alike on both sides.

    The current row has the greatest `latest`; rows that tie there (copies, or conflicting rows) are ordered by their
    values, so the result is always the same. A null `latest` counts as lowest.
    """

    def side(df: DataFrame, tag: int) -> DataFrame:
        order = [F.col(_quoted(latest)).alias("o")] if latest else []
        kinds = dict(df.dtypes)
        values = [(_short(F.col(_quoted(f))) if hashed and kinds[f] == "string" else F.col(_quoted(f))).alias(f"v{i}") for i, f in enumerate(fields)]
        return df.select(key.alias("k"), F.lit(tag).alias("side"), F.struct(*order, *values).alias("row"))

    both = side(left, 0).unionByName(side(right, 1)).where(F.col("k").isNotNull())
    current = [F.max(F.when(F.col("side") == tag, F.col("row"))).alias(name) for tag, name in ((0, "l"), (1, "r"))]
    return both.groupBy("k").agg(*current).withColumnRenamed("k", key_name)


def diff_by_key(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: list[str],
    latest: str | None = None,
    normalise_key: bool = True,
    values: bool = False,
) -> DataFrame:
    """The differences of two copies: (key, diff), and with `values` also left_value and right_value as text.

    diff is `left_only`, `right_only` or the name of a field whose values differ. Fields are compared exactly; null
    equals null and nothing else. With `normalise_key`, white space around a string key is ignored. Rows without a key
    are left out: nothing on the other side could stand for them. Further columns of either side play no part, whatever
    their names. Empty sides are fine: every key is then `left_only` or `right_only`.
    """
    column = F.col(_quoted(key))
    if normalise_key and dict(left.dtypes)[key] == "string":
        column = stripped(column)
    pairs = latest_pair(left, right, column, "k", fields, latest, hashed=not values)
    checks = ", ".join(
        f"named_struct('f', {_literal(f)}, 'same', l.v{i} <=> r.v{i}, 'lv', CAST(l.v{i} AS STRING), 'rv', CAST(r.v{i} AS STRING))"
        for i, f in enumerate(fields)
    )
    one_side = "named_struct('f', '{}', 'same', false, 'lv', CAST(NULL AS STRING), 'rv', CAST(NULL AS STRING))"
    found = F.expr(
        f"CASE WHEN r IS NULL THEN array({one_side.format(LEFT_ONLY)}) WHEN l IS NULL THEN array({one_side.format(RIGHT_ONLY)}) "
        f"ELSE filter(array({checks}), x -> NOT x.same) END"
    )
    rows = pairs.select("k", F.explode(found).alias("d"))
    out = [F.col("k").alias(key), F.col("d.f").alias("diff")]
    if values:
        out += [F.col("d.lv").alias("left_value"), F.col("d.rv").alias("right_value")]
    return rows.select(*out)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def diff_summary(differences: DataFrame) -> DataFrame:
    """Counts of differences by kind: (diff, n)."""
    return differences.groupBy("diff").agg(F.count(F.lit(1)).alias("n"))
