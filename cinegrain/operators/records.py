"""Record-level merging and shaping: summaries, payloads, unions of lists, page kinds and link targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegrain.functions.scalars import image_filename, or_else, wiki_url
from cinegrain.markup.udfs import exploded, family_fields, subpage_of

# Columns of full records that a summary leaves out, and the infoboxes and categories of each kind of page.
HEAVY = ["plot", "summary", "plothtml", "nativename", "tagline", "articlesections", "references", "reception", "sections", "episodeslist", "soundtrack", "awards", "facts", "cast", "crew", "external", "trailer"]
FILM_BOX = r"(?i)^infobox (film|television film|movie)$"
SERIES_BOX = r"(?i)^infobox (television|tv series|television series|miniseries|television programme|television program|television show)$"
PERSON_BOX = (
    r"(?i)^infobox (person|actor|actress|biography|musical artist|singer|director|producer|writer|screenwriter|playwright|composer|lyricist|model|television presenter|presenter|cricketer|politician|footballer|sports personality|athlete)$"
)
OFFICE_BOX = r"(?i)^infobox officeholder$"
PERSON_CATEGORY = r"(?i)\[\[Category:[^\]]*(actor|actress|film director|film producer|screenwriter|lyricist|playback singer|film score composer|cinematographer|film editor|choreographer|television presenter)[^\]]*\]\]"
SUMMARY_SCHEMA = "oneLiner string, moods array<string>"
SEASON_SCHEMA = "episodes array<struct<episode_number:int,name:string,overview:string,air_date:string,runtime:int>>"


def title_summary(records: DataFrame, episodes: str | None = None) -> DataFrame:
    """Records without their heavy columns, with the number of episodes (null where there is no list)."""
    counted = records.withColumn("episodecount", F.when(F.col(episodes).isNotNull(), F.size(episodes))) if episodes else records
    return counted.drop(*[c for c in counted.columns if c.lower() in HEAVY])


def page_kind(wikitext: Column) -> Column:
    """movie, series, person, or why it is none: empty, disambiguation, no infobox, another type.

    A page without infobox, or of an officeholder, is a person's if a category of film occupations says so.
    """
    name = F.trim(F.regexp_replace(F.regexp_extract(wikitext, r"(?is)\{\{\s*(infobox[^|}\n]*)", 1), r"[\s_]+", " "))
    kind = F.when(name.rlike(FILM_BOX), "movie").when(name.rlike(SERIES_BOX), "series").when(name.rlike(PERSON_BOX) | (((name == "") | name.rlike(OFFICE_BOX)) & wikitext.rlike(PERSON_CATEGORY)), "person")
    return (
        F.when(F.coalesce(F.trim(wikitext), F.lit("")) == "", "empty").when(wikitext.rlike(r"(?i)\{\{[^{}|]*disambiguation"), "disambiguation").when((name == "") & kind.isNull(), "no-infobox").otherwise(F.coalesce(kind, F.concat(F.lit("wrong-type:"), name)))
    )


def ai_summary(raw: Column) -> Column:
    """(oneLiner, moods) of a model's answer: the first object in it; at most 200 characters and four moods; null otherwise."""
    found = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), SUMMARY_SCHEMA, {"mode": "PERMISSIVE"})
    moods = F.slice(F.filter(F.coalesce(found["moods"], F.array().cast("array<string>")), lambda m: F.trim(m) != ""), 1, 4)
    return F.when(F.trim(found["oneLiner"]) != "", F.struct(F.substring(F.trim(found["oneLiner"]), 1, 200).alias("oneLiner"), moods.alias("moods")))


def season_episodes(payload: Column, season: Column) -> Column:
    """(number, title, summary, airdate, runtime, season) of a season's payload; numbers above 0 only."""
    rows = F.coalesce(F.from_json(payload, SEASON_SCHEMA)["episodes"], F.array().cast("array<struct<episode_number:int,name:string,overview:string,air_date:string,runtime:int>>"))
    good = F.filter(rows, lambda e: e["episode_number"] > 0)
    return F.transform(good, lambda e: F.struct(e["episode_number"].cast("string").alias("number"), or_else(e["name"], F.concat(F.lit("Episode "), e["episode_number"].cast("string"))).alias("title"), e["overview"].alias("summary"), e["air_date"].alias("airdate"), e["runtime"].alias("runtime"), season.alias("season")))


def fill_episodes(own: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """Empty summaries and runtimes filled from another source by season (1 where missing) and number; of several
    rows of one number there the least counts."""
    left = own.withColumn("season_key", F.coalesce("season", F.lit(1)))
    right = other.select(*by, F.coalesce("season", F.lit(1)).alias("season_key"), "number", "summary", "runtime")
    right = right.groupBy(*by, "season_key", "number").agg(F.min(F.struct("summary", "runtime")).alias("r")).select(*by, "season_key", "number", F.col("r.summary").alias("s2"), F.col("r.runtime").alias("r2"))
    joined = left.join(right, [*by, "season_key", "number"], "left")
    return joined.withColumn("summary", or_else(F.col("summary"), F.col("s2"))).withColumn("runtime", F.coalesce(F.nullif("runtime", F.lit("")), F.col("r2").cast("string"))).drop("s2", "r2", "season_key")


def union_lists(*lists: Column) -> Column:
    """The distinct items of several lists in order; nulls and empty items are left out."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(x, none) for x in lists]), lambda x: x != ""))


def first_filled(*lists: Column) -> Column:
    """The first list that has items."""
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<string>"))


def fill_images(records: DataFrame, images: DataFrame, value: str, target: str) -> DataFrame:
    """Missing pictures filled by the address of the file that a parameter names (one file may serve many records)."""
    named = records.withColumn("_file", image_filename(F.col(value)))
    urls = images.select(F.col("file").alias("_file"), F.split("url", r"\?")[0].alias("_url")).dropDuplicates(["_file"])
    return named.join(urls, "_file", "left").withColumn(target, F.coalesce(target, "_url")).drop("_file", "_url")


def work_links(rows: DataFrame, titles: DataFrame, wikititle: str) -> DataFrame:
    """``url``: the catalogue's page of a linked work, else its article's address, else null."""
    own = titles.select(F.col("wikititle").alias(wikititle), F.concat(F.when(F.col("kind") == "series", "/series/").otherwise("/movies/"), "slug", F.lit("/")).alias("_own"))
    return rows.join(own, wikititle, "left").withColumn("url", F.coalesce("_own", F.when(F.col(wikititle).isNotNull(), wiki_url(F.col(wikititle))))).drop("_own")


def enrich_gaps(records: DataFrame, details: DataFrame, key: str, dirty: DataFrame, native: list[str], gaps: list[str]) -> DataFrame:
    """Gaps filled from details; for dirty keys the details' native fields win. Fields in neither list stay."""
    d = details.select(key, *[F.col(c).alias(f"_{c}") for c in {*native, *gaps}])
    joined = records.join(d, key, "left").join(dirty.select(key, F.lit(True).alias("_dirty")).distinct(), key, "left")
    for c in {*native, *gaps}:
        filled = F.coalesce(F.col(c), F.col(f"_{c}"))
        joined = joined.withColumn(c, F.when(F.col("_dirty") & F.col(f"_{c}").isNotNull(), F.col(f"_{c}")).otherwise(filled) if c in native else filled)
    return joined.drop("_dirty", *[f"_{c}" for c in {*native, *gaps}])


def merge_subpages(pages: DataFrame, subpages: DataFrame, key: str, family: str, group: list[str], name: Column) -> DataFrame:
    """Records of a family of each page (key, text) merged with those of the page that its {{Main}} pointer names.

    The subpage's records come first, then the page's own; the first of a page, ``group`` and ``name`` counts. Groups
    come in order of their first record, ``place`` counts from 1 over a page's records. ``subpages`` is (title, text);
    a pointer to a page that isn't there counts for nothing. Pages without records have no rows.
    """
    pointed = pages.select(key, F.col("text").alias("own"), subpage_of(F.col("text"), family).alias("title"))
    others = subpages.groupBy("title").agg(F.min("text").alias("other"))
    both = pointed.join(others, "title", "left").select(key, F.posexplode(F.array("other", "own")).alias("source", "text")).filter("text is not null")
    numbered = both.select(F.struct(key, "source").alias("at"), "text")
    rows = exploded(numbered, "at", "text", family).select("at.*", "pos", *family_fields(family))
    first = rows.withColumn("_name", name).groupBy(key, *group, "_name").agg(F.min_by(F.struct("source", "pos", *[c for c in family_fields(family) if c not in group]), F.struct("source", "pos")).alias("r"))
    first = first.select(key, *group, "r.*")
    opened = Window.partitionBy(key, *group)
    placed = first.withColumn("_open", F.min(F.struct("source", "pos")).over(opened))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_open", "source", "pos"))
    return placed.withColumn("place", place).drop("_open", "source", "pos")
