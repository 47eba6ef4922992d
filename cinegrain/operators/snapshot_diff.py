"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def cell_text(df: DataFrame, field: str) -> Column:
    """A field as text for comparison: null is the empty text, arrays are compared without order.

    Every item of an array is prefixed by its length, so no two different arrays give one text.
    """
    kind = df.schema[field].dataType.typeName()
    value = F.col(f"`{field}`")
    if kind == "array":
        items = F.transform(F.array_sort(value), lambda x: F.concat(F.coalesce(F.length(x.cast("string")), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(x.cast("string"), F.lit(""))))
        return F.coalesce(F.array_join(items, SEPARATOR), F.lit(""))
    if kind in ("double", "float"):
        value = value + F.lit(0.0)
    return F.coalesce(value.cast("string"), F.lit(""))


def latest_deliveries(df: DataFrame, day: str, loaded: str) -> DataFrame:
    """The rows of each day's last delivery. A day that was never delivered has no rows."""
    last = df.groupBy(day).agg(F.max(loaded).alias("_last"))
    return df.join(last, (df[day] == last[day]) & df[loaded].eqNullSafe(last["_last"]), "left_semi")


def signed_rows(df: DataFrame, day: str) -> DataFrame:
    """Each row twice: with sign +1 in the comparison of its own day, with -1 in that of the next delivered day.

    The first day has no comparison, the last day no follower. There is one row of days per delivered day,
    so ordering them in one task is bounded by the number of days.
    """
    days = df.select(day).distinct()
    order = Window.orderBy(day)
    steps = days.select(F.col(day).alias("_day"), F.lag(day).over(order).alias("_before"), F.lead(day).over(order).alias("_after"))
    sides = F.filter(
        F.array(
            F.struct(F.when(F.col("_before").isNotNull(), F.col("_day")).alias("pair"), F.lit(1).alias("sign")),
            F.struct(F.col("_after").alias("pair"), F.lit(-1).alias("sign")),
        ),
        lambda s: s["pair"].isNotNull(),
    )
    role = steps.select("_day", F.explode(sides).alias("_role"))
    return df.join(role, df[day] == role["_day"]).select(df["*"], F.col("_role.pair").alias("_pair"), F.col("_role.sign").alias("_sign"))


def diff_snapshots(
    df: DataFrame,
    key: str,
    fields: Sequence[str],
    day: str = "snapshot_day",
    loaded: str = "loaded_at",
    second_key: str | None = None,
) -> DataFrame:
    """Changes of each snapshot against the one delivered before it: (day, key, change, fields).

    ``change`` is ``added``, ``removed``, ``changed`` or, with a ``second_key``, ``renamed`` (keys left over that
    meet in the second key; the key is the new one). ``fields`` names the fields whose values differ.

    Rows become signed cells: +1 for the new snapshot, -1 for the old. Whole rows are summed first, so that
    unchanged rows cancel before anything is unpivoted; what is left is unpivoted into (key, field, value) cells
    with a presence marker for each key, and the non-zero sums give the verdict.

    Defined cases: repeated rows count once; null and empty are one value; the order of an array doesn't count;
    rows with a null key are no records and are left out; null second keys never match; several keys left over
    with one second key are paired in key order; an empty table gives no rows.
    """
    last = latest_deliveries(df, day, loaded)
    texts = [cell_text(last, f).alias(f"c{i}") for i, f in enumerate(fields)]
    second = F.col(f"`{second_key}`") if second_key else F.lit(None)
    base = last.filter(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{day}`").alias("_day0"), F.col(f"`{key}`").alias("_key"), second.cast("string").alias("_second"), *texts
    )
    content = [f"c{i}" for i in range(len(fields))]
    # One shuffle by (pair, key) serves all three sums below.
    signed = signed_rows(base, "_day0").select("_pair", "_key", "_second", *content, "_sign").repartition("_pair", "_key")
    # Repeated rows count once: the sign of their group, not its sum.
    rows = signed.groupBy("_pair", "_key", "_second", *content).agg(F.max("_sign").alias("hi"), F.min("_sign").alias("lo"))
    rows = rows.withColumn("_sign", F.col("hi") + F.col("lo")).withColumn("_sign", F.signum("_sign").cast("int"))
    # hi = lo = 1: only new, hi = lo = -1: only old, else the row stands in both and cancels.
    left = rows.filter("_sign <> 0")
    cells = F.array(
        F.struct(F.lit("").alias("field"), F.lit("").alias("value"), F.col("_second").alias("second")),
        *[F.struct(F.lit(f).alias("field"), F.col(c).alias("value"), F.lit(None).cast("string").alias("second")) for f, c in zip(fields, content)],
    )
    unpivoted = left.select("_pair", "_key", "_sign", F.explode(cells).alias("cell"))
    sums = unpivoted.groupBy("_pair", "_key", F.col("cell.field").alias("field"), F.col("cell.value").alias("value")).agg(
        F.sum("_sign").alias("total"), F.max("_sign").alias("hi"), F.min("_sign").alias("lo"), F.max("cell.second").alias("second")
    )
    verdict = sums.groupBy("_pair", "_key").agg(
        F.max(F.when(F.col("field") == "", F.col("hi"))).alias("hi"),
        F.min(F.when(F.col("field") == "", F.col("lo"))).alias("lo"),
        F.max(F.when(F.col("field") == "", F.col("second"))).alias("second"),
        F.array_sort(F.collect_set(F.when((F.col("field") != "") & (F.col("total") != 0), F.col("field")))).alias("fields"),
    )
    change = F.when((F.col("hi") == 1) & (F.col("lo") == 1), "added").when((F.col("hi") == -1) & (F.col("lo") == -1), "removed").when(F.size("fields") > 0, "changed")
    found = verdict.select(F.col("_pair").alias(day), F.col("_key").alias(key), change.alias("change"), "fields", "second").filter("change is not null")
    if not second_key:
        return found.drop("second")
    # Keys left over meet by their second key. Only added and removed keys with one come here.
    one_sided = (F.col("change") != "changed") & F.col("second").isNotNull()
    place = F.row_number().over(Window.partitionBy(day, "second", "change").orderBy(key))
    ranked = found.withColumn("place", F.when(one_sided, place))
    both = Window.partitionBy(day, "second", "place")
    sides = ranked.withColumn("sides", F.when(one_sided, F.count("*").over(both)).otherwise(1))
    result = F.when((F.col("sides") == 2) & (F.col("change") == "added"), "renamed").when((F.col("sides") == 2) & (F.col("change") == "removed"), None).otherwise(F.col("change"))
    none = F.array().cast("array<string>")
    return sides.select(day, key, result.alias("change"), F.when(F.col("change") == "changed", F.col("fields")).otherwise(none).alias("fields")).filter("change is not null")
