"""Snapshot comparison and refresh planning: what to fetch again, what was renamed, lost or gone stale."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegrain.session import cut


def plan_refresh(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(pageid, action): changed where the revid differs, added where there was none; vanished pages are ignored."""
    before = previous.select("pageid", F.col("revid").alias("old"), F.lit(1).alias("there"))
    action = F.when(F.col("there").isNull(), "added").when(~F.col("old").eqNullSafe(F.col("revid")), "changed")
    return current.join(before, "pageid", "left").select("pageid", action.alias("action")).filter("action is not null")


def refresh_list(planned: DataFrame, forced: DataFrame) -> DataFrame:
    """(pageid, action): the planned pages, and those forced (pageid) besides, each once; null pages don't count."""
    more = forced.filter("pageid is not null").select("pageid").distinct().join(planned.select("pageid"), "pageid", "left_anti")
    return planned.select("pageid", "action").unionByName(more.select("pageid", F.lit("forced").alias("action")))


def plan_renames(cached: DataFrame, live: DataFrame) -> DataFrame:
    """(pageid, old_title, new_title) of pages whose live title is another."""
    return cached.select("pageid", F.col("title").alias("old_title")).join(live.select("pageid", F.col("title").alias("new_title")), "pageid").filter("old_title <> new_title")


def plan_validation(cached: DataFrame, live: DataFrame) -> DataFrame:
    """(pageid, verdict) of cached pages that live: legacy without revid, stale if it differs, else fresh."""
    now = live.select("pageid", F.col("revid").alias("live_revid"))
    verdict = F.when(F.col("revid").isNull(), "legacy").when(F.col("revid") != F.col("live_revid"), "stale").otherwise("fresh")
    return cached.join(now, "pageid").select("pageid", verdict.alias("verdict"))


def legacy_by_time(cached: DataFrame, top: DataFrame) -> DataFrame:
    """(pageid, verdict): fresh if the top revision isn't after the fetch, in whole seconds; stale otherwise or without one."""
    joined = cached.select("pageid", F.date_trunc("second", F.expr("try_cast(fetchedat as timestamp)")).alias("at")).join(top.select("pageid", F.col("ts").alias("top_ts")), "pageid", "left")
    return joined.select("pageid", F.when(F.col("top_ts") <= F.col("at"), "fresh").otherwise("stale").alias("verdict"))


def top_revisions(pages: DataFrame, at: Column) -> DataFrame:
    """(pageid, revid, ts) of each page's latest revision by time."""
    return pages.groupBy("pageid").agg(F.max_by(F.struct("revid", at.alias("ts")), F.struct(at, F.col("revid"))).alias("r")).select("pageid", "r.revid", "r.ts")


def slug_redirects(records: DataFrame, previous: DataFrame) -> DataFrame:
    """(from_path, to_path) of records whose slug or kind changed; the old path has the old kind."""
    path = lambda kind, slug: F.concat(F.when(kind == "series", "/series/").otherwise("/movies/"), slug, F.lit("/"))
    old = previous.select("pageid", F.col("slug").alias("old_slug"), F.col("kind").alias("old_kind"))
    both = records.join(old, "pageid").filter("slug <> old_slug or kind <> old_kind")
    return both.select(path(F.col("old_kind"), F.col("old_slug")).alias("from_path"), path(F.col("kind"), F.col("slug")).alias("to_path"))


def diff_documents(live: DataFrame, build: DataFrame, removals: DataFrame) -> DataFrame:
    """(id, status): live documents gone from the build are intentional, renamed (pid lives on) or unexpected, in this
    order; build documents that are new are added."""
    gone = live.join(build.select("id"), "id", "left_anti")
    listed = removals.select("id", F.lit(True).alias("listed")).distinct()
    alive = build.filter("pid is not null").select("pid", F.lit(True).alias("alive")).distinct()
    status = F.when(F.col("listed"), "intentional").when(F.col("alive"), "renamed").otherwise("unexpected")
    lost = gone.join(listed, "id", "left").join(alive, "pid", "left").select("id", status.alias("status"))
    added = build.join(live.select("id"), "id", "left_anti").select("id", F.lit("added").alias("status"))
    return lost.unionByName(added)


def page_loss(diff: DataFrame, tolerance: int = 25) -> DataFrame:
    """(unexpected, failed): whether more documents were lost than tolerated."""
    return diff.agg(F.count_if(F.col("status") == "unexpected").alias("unexpected")).withColumn("failed", F.col("unexpected") > tolerance)


def canary_sample(docs: DataFrame, n: int, key: str = "id") -> DataFrame:
    """Every len/n-th key in sorted order; all if there are at most n.

    The global rank comes from range partitions: counts per partition are summed on the driver, one number each.
    """
    ranked = global_rank(docs.select(key).distinct(), [key])
    size = ranked.count()
    if size <= n:
        return ranked.select(key)
    # Rank r is taken if it is floor(i * size / n) for some i.
    i = F.ceil(F.col("rank") * n / F.lit(float(size)))
    return ranked.filter(F.floor(i * size / n) == F.col("rank")).filter(i < n).select(key)


def global_rank(df: DataFrame, order: list) -> DataFrame:
    """``rank`` from 0 in the total order, without bringing all rows to one task."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ordered = ordered.withColumn("_in", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("bigint"), 33))
    ordered = cut(ordered)  # the places are fixed once
    counts = sorted((r["_part"], r["n"]) for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for part, n in counts:
        starts.append((part, before))
        before += n
    table = df.sparkSession.createDataFrame(starts, "_part int, _before long")
    return ordered.join(F.broadcast(table), "_part").withColumn("rank", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def group_rank(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """``rank`` from 0 within each group and the group's ``count``; a group of any size is spread over tasks.

    All rows are ranked by group and order at once; a group's ranks follow each other, so its least is taken off.
    """
    ranked = global_rank(df, [*by, *order])
    first = ranked.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("rank").alias("_first"), F.count("*").alias("count"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return ranked.join(first, same).withColumn("rank", F.col("rank") - F.col("_first")).drop("_first", *[f"_{c}" for c in by])


def season_urls(changed: DataFrame, tracked: DataFrame, most: int = 50) -> DataFrame:
    """(kind, id, url): every cached address of tracked titles that changed, seasons included."""
    hit = tracked.filter("id is not null").join(changed.select("kind", "id").distinct(), ["kind", "id"], "left_semi")
    return hit.select("kind", "id", F.explode(refresh_urls(F.col("kind"), F.col("id"), F.col("seasons"), most)).alias("url"))


def refresh_urls(kind: Column, key: Column, seasons: Column | None = None, most: int = 50) -> Column:
    """The addresses under which a title may be cached."""
    base = F.concat(F.lit("/"), kind, F.lit("/"), key.cast("string"))
    urls = F.array(F.concat(base, F.lit("?append_to_response=credits,videos")), F.concat(base, F.lit("?append_to_response=videos")))
    if seasons is None:
        return urls
    n = F.least(F.greatest(F.coalesce(F.expr("try_cast(seasons as int)") if isinstance(seasons, str) else seasons.try_cast("int"), F.lit(0)), F.lit(0)), F.lit(most))
    numbers = F.when((kind == "tv") & (n > 0), F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.concat(urls, F.transform(numbers, lambda s: F.concat(base, F.lit("/season/"), s.cast("string"))))


def freshness_band(tracked: DataFrame, today: Column, back: int = 45, ahead: int = 548) -> DataFrame:
    """Tracked titles released within the band of days around today; dates are compared as text, whatever their precision."""
    day = lambda n: F.date_format(F.date_add(today, n), "yyyy-MM-dd")
    return tracked.filter(F.col("id").isNotNull() & (F.col("releasedate") != "") & (F.col("releasedate") >= day(-back)) & (F.col("releasedate") <= day(ahead)))


def orphan_sweep(changed: DataFrame, planned: DataFrame) -> DataFrame:
    """Changed ids that no plan holds yet; ids are compared without their kind."""
    return changed.join(planned.select("id").distinct(), "id", "left_anti")


def upsert_redirects(old: DataFrame, new: DataFrame, live: DataFrame) -> DataFrame:
    """(from_path, to_path): the new target wins, and paths that are live again are dropped."""
    both = old.select("from_path", "to_path", F.lit(0).alias("newer")).unionByName(new.select("from_path", "to_path", F.lit(1).alias("newer")))
    kept = both.groupBy("from_path").agg(F.max_by("to_path", F.struct("newer", "to_path")).alias("to_path"))
    return kept.join(live.select(F.col("path").alias("from_path")).distinct(), "from_path", "left_anti")


def first_seen(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order; all columns are kept."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")
