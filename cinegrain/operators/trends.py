"""Trend scores and live views from daily page views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinegrain.functions.scalars import half_up


def recent_days(views: DataFrame, days: int = 7, day: str = "day") -> DataFrame:
    """The rows of the most recent days that have any; the list of days is small and is broadcast as the join decides."""
    last = views.select(day).distinct().orderBy(F.desc(day)).limit(days)
    return views.join(last, day, "left_semi")


def trend_scores(views: DataFrame, key: str = "title", full_days: int = 2) -> DataFrame:
    """(key, score, views): the last two present days of a key count in full, earlier ones by half, rounded half up.

    Null views count as 0; repeated days of a key are summed first.
    """
    daily = views.groupBy(key, "day").agg(F.sum(F.coalesce("views", F.lit(0))).alias("views"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("day")))
    weighted = daily.withColumn("w", F.when(rank <= full_days, F.col("views") * 1.0).otherwise(F.col("views") * 0.5))
    return weighted.groupBy(key).agg(half_up(F.sum("w")).cast("bigint").alias("score"), F.sum("views").cast("bigint").alias("views"))


def top_ranked(scores: DataFrame, most: int, key: str = "title") -> DataFrame:
    """The keys with a positive score, highest first; ties by key."""
    return scores.filter("score > 0").orderBy(F.desc("score"), key).limit(most)


def live_views(views: DataFrame, key: str = "title", days: int = 3, back: int = 5) -> DataFrame:
    """(key, views): the sum over the first ``days`` available of the last ``back`` days of the calendar."""
    end = views.agg(F.max("day").alias("end"))
    recent = views.join(end, F.col("day") > F.date_add("end", -back)).drop("end")
    return recent_days(recent, days).groupBy(key).agg(F.sum("views").cast("bigint").alias("views"))


def trends_payload(titles: DataFrame, views: DataFrame, most: int) -> DataFrame:
    """(kind, slug, score, views, place): every title scored, 0 without views; place is set for the top ones of a kind.

    Scores are kept by (kind, slug), as slugs are unique only within a kind.
    """
    scored = titles.join(trend_scores(views), "title", "left").select("kind", "slug", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("views", F.lit(0)).alias("views"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "slug"))
    top = scored.filter("score > 0").withColumn("place", place).filter(F.col("place") <= most).select("kind", "slug", "place")
    return scored.join(top, ["kind", "slug"], "left")


def live_top(viewed: DataFrame, key: str, most: int, least: int) -> DataFrame:
    """(key, place) of the rows with the most ``views``; none at all where fewer than ``least`` have any."""
    top = viewed.filter("views > 0").orderBy(F.desc("views"), key).limit(most)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("views"), key)).cast("bigint")).withColumn("n", F.count("*").over(Window.partitionBy()))
    return placed.filter(F.col("n") >= least).select(key, "place")
