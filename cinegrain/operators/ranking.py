"""Ordered views: index order, pages, known-for, picks, carried values and running caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegrain.functions.scalars import half_up
from cinegrain.operators.delta import group_rank


def index_order(date: str = "releasedate", year: str = "year", title: str = "title", key: str = "pageid") -> list[Column]:
    """Dated titles first, latest first; then by year, title and key."""
    return [F.desc_nulls_last(F.nullif(F.col(date), F.lit(""))), F.desc_nulls_last(year), F.asc(title), F.asc(key)]


def index_pages(titles: DataFrame, size: int = 200, by: list[str] = ("kind",), order: list[Column] | None = None) -> DataFrame:
    """Rows with ``place``, ``page`` and ``pages`` within their group, by ranges: no task orders a whole group."""
    ranked = group_rank(titles, list(by), order or index_order())
    place, pages = F.col("rank") + 1, F.greatest(F.lit(1), F.ceil(F.col("count") / size)).cast("int")
    return ranked.withColumn("place", place).withColumn("page", F.ceil(F.col("place") / size).cast("int")).withColumn("pages", pages).drop("rank", "count")


def overflow(df: DataFrame, by: list[str], order: list[Column], most: int, key: str) -> DataFrame:
    """(key, overflow): whether a row comes after the first ``most`` of its group.

    The first rows of a group are found by limits in each task before the shuffle, so a group of any size is no task's
    own; the rows are then told by ``key``, which must be unique.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = df.withColumn("_place", place).filter(F.col("_place") <= most).select(key, F.lit(False).alias("_over"))
    return df.select(key).join(first, key, "left").select(key, F.coalesce("_over", F.lit(True)).alias("overflow"))


def page_links(page: Column, pages: Column) -> Column:
    """Page numbers to offer: the first, the last and two around the page."""
    near = F.filter(F.sequence(page - 2, page + 2), lambda p: (p >= 1) & (p <= pages))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1)), near, F.array(pages))))


def known_for(works: DataFrame, titles: DataFrame, year_now: int, most: int = 6) -> DataFrame:
    """(person, title, year, score, place): a person's works by the published formula, the best ``most``.

    ``works`` is (person, wikititle, won); ``titles`` has votes, rating, year, archive and poster. The score is rounded
    to two digits, half up, before works are ordered by score, year and title.
    """
    once = works.filter("wikititle is not null").groupBy("person", "wikititle").agg(F.max("won").alias("won"))
    r = once.join(titles, "wikititle")
    zero = F.lit(0.0)
    votes, year = F.coalesce("votes", F.lit(0)), F.coalesce("year", F.lit(0))
    score = (
        F.when(votes > 0, 2 * F.log10(F.greatest(votes, F.lit(10)))).otherwise(zero)
        + F.when((votes >= 10) & F.col("rating").isNotNull(), 1.5 * (F.col("rating") - 5)).otherwise(zero)
        + F.when(year > 0, F.greatest(zero, 3 - 0.05 * (year_now - year))).otherwise(zero)
        + F.when(F.col("won"), 2.0).otherwise(zero)
        + F.when(F.coalesce("archive", F.lit(False)), 0.25).otherwise(1.0)
        + F.when(F.col("poster").isNotNull(), 0.5).otherwise(zero)
    )
    r = r.withColumn("score", half_up(score, 2))
    place = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("score"), F.desc(year), "title"))
    return r.withColumn("place", place).filter(F.col("place") <= most).select("person", "title", "year", "score", "place")


def pick_match(results: DataFrame, by: list[str], wanted: Column, title: Column, year: Column, result_year: Column, ordinal: str) -> DataFrame:
    """The first result in the best tier: title and year, title, year, any."""
    exact, same = F.lower(F.trim(title)) == F.lower(F.trim(wanted)), result_year == year
    tier = F.when(exact & same, 0).when(exact, 1).when(same, 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("tier", ordinal))
    return results.withColumn("tier", tier).withColumn("_p", place).filter("_p = 1").drop("_p")


def best_matches(records: DataFrame, results: DataFrame) -> DataFrame:
    """(key, id, tier) of every record with a result of its kind: title and year, title, year, any; the first id.

    ``records`` is (key, kind, title, year), ``results`` (id, kind, title, year). Titles meet whole, trimmed and without
    case. Each tier is a join with the least id of its key, one row per key, so frequent titles and years make no
    pairs. Nulls meet nothing; a kind without results has no rows.
    """
    low = lambda df: df.withColumn("title", F.lower(F.trim("title")))
    found, out = low(results), low(records)
    for tier, by in enumerate((["kind", "title", "year"], ["kind", "title"], ["kind", "year"], ["kind"])):
        out = out.join(found.groupBy(*by).agg(F.min("id").alias(f"_{tier}")), by, "left")
    tier = F.coalesce(*[F.when(F.col(f"_{i}").isNotNull(), i) for i in range(4)])
    return out.select("key", F.coalesce(*[f"_{i}" for i in range(4)]).alias("id"), tier.alias("tier")).filter("id is not null")


def best_candidate(scored: DataFrame, by: list[str], ordinal: str = "ord", enough: int = 3, most: int = 4) -> DataFrame:
    """Of the first ``most`` candidates the first with a score that is enough, else the first with the highest.

    Candidates after the first that is enough are not looked at; a best score of 0 or less picks none.
    """
    early = F.when(F.col("score") >= enough, 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(early, F.when(early == 1, -F.col("score")), ordinal))
    return scored.filter(F.col(ordinal) < most).withColumn("_p", place).filter("_p = 1 and score > 0").drop("_p")


def pick_trailer(videos: DataFrame, by: list[str]) -> DataFrame:
    """The first video of the best tier: official trailer, trailer, official teaser, teaser, any; one site only."""
    official, kind = F.coalesce("official", F.lit(False)), F.col("type")
    tier = F.when((kind == "Trailer") & official, 0).when(kind == "Trailer", 1).when((kind == "Teaser") & official, 2).when(kind == "Teaser", 3).otherwise(4)
    return videos.filter("site = 'YouTube'").groupBy(*by).agg(F.min_by("key", F.struct(tier, F.col("pool"), F.col("ord"))).alias("key"))


def name_overlap(people: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """(by..., score): 3 for each director and 1 for each listed member whose plain name is wanted, however often."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    names = wanted.select(*by, plain("name").alias("n")).filter("n <> ''").distinct()
    marked = people.select(*by, plain("name").alias("n"), F.when(F.lower("job").contains("director"), 3).otherwise(1).alias("w"))
    return marked.join(names, [*by, "n"]).groupBy(*by).agg(F.sum("w").cast("bigint").alias("score"))


def carried(df: DataFrame, by: list[str], order: list, column: str, only: Column | None = None) -> DataFrame:
    """Missing values filled from the last one before, in order; ``only`` limits which rows are filled."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(column, ignorenulls=True).over(window)
    return df.withColumn(column, F.when(only, last).otherwise(F.col(column)) if only is not None else last)


def running_cap(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group over all its sections, in order (a report's limit)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def until_gap(df: DataFrame, by: list[str], order: list, has_rows: str) -> DataFrame:
    """The rows before the first without content, in order."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_ok", F.min(F.col(has_rows).cast("int")).over(window)).filter("_ok = 1").drop("_ok")


def related(df: DataFrame, by: str, key: str, order: list[Column], most: int) -> DataFrame:
    """(key, related): for each row the first ``most`` others of its group.

    They are among the group's first ``most`` + 1, found by limits before the shuffle; every row meets only these.
    """
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    first = df.withColumn("_place", place).filter(F.col("_place") <= most + 1).select(by, F.col(key).alias("related"), "_place")
    own = first.filter(F.col("_place") <= most).select(F.col("related").alias(key), F.lit(1).alias("_among"))
    met = df.select(key, by).join(own, key, "left").join(first, by)
    return met.filter((F.col(key) != F.col("related")) & (F.col("_place") <= most + F.coalesce("_among", F.lit(0)))).select(key, "related")
