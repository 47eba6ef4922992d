"""Orders of the dataset and its pages, counts of people's works, expansion waves, and written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrain.functions import scalars as S
from cinegrain.operators import delta, ranking, trends
from cinegrain.operators.frontier import expand, rejudge
from cinegrain.operators.incremental import StateStore, baseline_or_changes
from cinegrain.plans.catalogue import PEOPLE, SCORES, TITLES, page_views, people, titles
from cinegrain.plans.registry import Registry
from cinegrain.session import scratch_path, table
from cinegrain.sources.landing import append_watchlist, read_bucket, write_buckets

REGISTRY = Registry()


@REGISTRY.query(f"select pageid, row_number() over (order by nullif(releasedate, '') desc nulls last, pageid) place from {TITLES}")
def dataset_order(spark: SparkSession, d: str) -> DataFrame:
    """All titles, the latest first, those without date last."""
    ranked = delta.global_rank(titles(spark, d).select("pageid", "releasedate"), [F.desc_nulls_last(F.nullif("releasedate", F.lit(""))), F.col("pageid")])
    return ranked.select("pageid", (F.col("rank") + 1).alias("place"))


@REGISTRY.query(f"select wikititle, row_number() over (order by wikititle) place from (select distinct wikititle from {PEOPLE} where wikititle is not null)")
def people_order(spark: SparkSession, d: str) -> DataFrame:
    named = people(spark, d).filter("wikititle is not null").select("wikititle").distinct()
    return delta.global_rank(named, ["wikititle"]).select("wikititle", (F.col("rank") + 1).alias("place"))


WORKS = f"(select distinct p.wikititle person, t.title, t.year from {PEOPLE} p join {TITLES} t using (pageid) where p.wikititle is not null)"


def works(spark: SparkSession, d: str) -> DataFrame:
    """(person, title, year): the works of each linked person."""
    p = people(spark, d).filter("wikititle is not null").select("pageid", F.col("wikititle").alias("person")).distinct()
    return p.join(titles(spark, d).select("pageid", "title", "year"), "pageid").select("person", "title", "year").distinct()


@REGISTRY.query(f"select person, title, coalesce(year, -1) as year, row_number() over (partition by person order by coalesce(year, -1) desc, title) place from {WORKS}")
def filmography_order(spark: SparkSession, d: str) -> DataFrame:
    """A person's works, the latest first, those without year last; the order is by ranges, however many works one has."""
    ranked = delta.group_rank(works(spark, d), ["person"], [F.desc(F.coalesce("year", F.lit(-1))), F.col("title")])
    return ranked.select("person", "title", F.coalesce("year", F.lit(-1)).alias("year"), (F.col("rank") + 1).alias("place"))


@REGISTRY.query(f"select person, count(*) as works, count(distinct year) as n_years, cast(coalesce(min(year), -1) as int) as first_year from {WORKS} group by 1")
def filmography_totals(spark: SparkSession, d: str) -> DataFrame:
    return works(spark, d).groupBy("person").agg(F.count("*").alias("works"), F.count_distinct("year").alias("n_years"), F.coalesce(F.min("year"), F.lit(-1)).alias("first_year"))


@REGISTRY.query(
    """with s as (select distinct song_id, pageid, coalesce(film, '') film from song_rows where listing = 'discography'),
b as (select pageid, film, count(*) songs from s group by 1, 2)
select pageid, film, songs, sum(songs) over (partition by pageid)::bigint total, row_number() over (partition by pageid order by songs desc, film) place from b"""
)
def discography_totals(spark: SparkSession, d: str) -> DataFrame:
    """Songs by film, and all of a page; a page's films, the largest first."""
    songs = table(spark, d, "song_rows").filter("listing = 'discography'").select("song_id", "pageid", F.coalesce("film", F.lit("")).alias("film")).distinct()
    films = songs.groupBy("pageid", "film").agg(F.count("*").alias("songs"))
    ranked = delta.group_rank(films, ["pageid"], [F.desc("songs"), F.col("film")])
    total = films.groupBy("pageid").agg(F.sum("songs").alias("total"))
    return ranked.join(total, "pageid").select("pageid", "film", "songs", "total", (F.col("rank") + 1).alias("place"))


@REGISTRY.query(
    """select pageid, fetched from (select pageid, arg_max(fetchedat, (landed_at, fetch_id)) fetched from (select distinct fetch_id, pageid, fetchedat, landed_at from raw_pages) group by 1)
order by fetched::timestamptz, pageid limit 3000"""
)
def legacy_queue(spark: SparkSession, d: str) -> DataFrame:
    """The pages that were fetched longest ago."""
    last = table(spark, d, "raw_pages").groupBy("pageid").agg(F.max_by("fetchedat", F.struct("landed_at", "fetch_id")).alias("fetched"))
    return last.orderBy(F.expr("cast(fetched as timestamp)"), "pageid").limit(3000)


@REGISTRY.query(
    f"""select pageid, score from (select t.pageid, coalesce(x.score, 0) score from {TITLES} t left join {SCORES} x on x.title = cast(t.pageid % 1000 as varchar)) order by score desc, pageid limit 350"""
)
def live_candidates(spark: SparkSession, d: str) -> DataFrame:
    scored = titles(spark, d).select("pageid", (F.col("pageid") % 1000).cast("string").alias("title")).join(trends.trend_scores(page_views(spark, d)), "title", "left")
    return scored.select("pageid", F.coalesce("score", F.lit(0)).alias("score")).orderBy(F.desc("score"), "pageid").limit(350)


LIVE = f"(select t.pageid, v.views from {TITLES} t join (select cast(user_id as varchar) title, count(*) as views from events group by 1) v on v.title = cast(t.pageid % 1000 as varchar) where t.releasedate <> '' and t.releasedate <= '2026-03-01')"


@REGISTRY.query(f"select pageid, place from (select pageid, row_number() over (order by views desc, pageid) place from {LIVE}) where place <= 12 and (select count(*) from {LIVE}) >= 4")
def live_top(spark: SparkSession, d: str) -> DataFrame:
    """The twelve released titles with the most views; none where fewer than four have any."""
    released = titles(spark, d).filter("releasedate <> '' and releasedate <= '2026-03-01'").select("pageid", (F.col("pageid") % 1000).cast("string").alias("title"))
    views = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("title")).agg(F.count("*").alias("views"))
    return trends.live_top(released.join(views, "title").select("pageid", "views"), "pageid", 12, 4)


@REGISTRY.query(
    f"""with c as (select pageid, entry_id, slug, row_number() over (partition by pageid order by ord nulls last, entry_id) r from {PEOPLE}),
p as (select slug, min(wikititle) page from {PEOPLE} where slug is not null and wikititle is not null group by 1)
select c.pageid, c.entry_id, p.page from c left join p using (slug) where r <= 24"""
)
def cast_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first 24 of each cast with the person's page where one is known."""
    all_ = people(spark, d)
    first = ranking.running_cap(all_.select("pageid", "entry_id", "slug", "ord"), ["pageid"], [F.asc_nulls_last("ord"), F.col("entry_id")], 24)
    pages = all_.filter("slug is not null and wikititle is not null").groupBy("slug").agg(F.min("wikititle").alias("page"))
    return first.join(pages, "slug", "left").select("pageid", "entry_id", "page")


@REGISTRY.query(f"select pageid, coalesce(year, 0) >= 2026 and pageid % 2 = 0 fresh, not regexp_matches(title, '(articles|templates|stub|navigation|tracking|maintenance|pages needing|cleanup|categories|disambiguation)', 'i') wanted from {TITLES}")
def lookup_rules(spark: SparkSession, d: str) -> DataFrame:
    """Whether a title is searched anew whatever the cache holds, and whether a category of its name would be followed."""
    found = F.when(F.col("pageid") % 2 == 1, F.col("pageid"))
    return titles(spark, d).select("pageid", S.needs_fresh_search(found, F.col("year"), 2026).alias("fresh"), S.is_wanted_category(F.col("title")).alias("wanted"))


@REGISTRY.query(f"select pageid, array_to_string(list_filter([language, kind, 'Warm', 'warm'], lambda x : lower(x) <> lower(kind)), '|') moods from {TITLES}")
def mood_chips(spark: SparkSession, d: str) -> DataFrame:
    """Moods that aren't genres, whatever their case."""
    moods = F.array("language", "kind", F.lit("Warm"), F.lit("warm"))
    return titles(spark, d).select("pageid", F.array_join(S.without(moods, F.array(F.initcap("kind"))), "|").alias("moods"))


LINKS = f"(select distinct t.wikititle a, p.wikititle b from {PEOPLE} p join {TITLES} t using (pageid) where p.wikititle is not null)"
VERDICTS = f"(select node, min(status) status from (select wikititle node, case when coalesce(archive, false) then 'rejected' else 'accepted' end status from {TITLES} union all select wikititle, 'accepted' from {PEOPLE} where origin = 'record' and wikititle is not null) group by 1)"


def _frontier(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t, p = titles(spark, d), people(spark, d).filter("wikititle is not null")
    pairs = p.select("pageid", F.col("wikititle").alias("b")).join(t.select("pageid", F.col("wikititle").alias("a")), "pageid")
    links = pairs.select(F.col("a").alias("source"), F.col("b").alias("target")).unionByName(pairs.select(F.col("b").alias("source"), F.col("a").alias("target")))
    status = F.when(F.coalesce("archive", F.lit(False)), "rejected").otherwise("accepted")
    verdicts = t.select(F.col("wikititle").alias("node"), status.alias("status")).unionByName(p.filter("origin = 'record'").select(F.col("wikititle").alias("node"), F.lit("accepted").alias("status")))
    return t.filter("year = 2025").select(F.col("wikititle").alias("node")), links, verdicts


@REGISTRY.query(
    f"""with recursive l as (select a source, b target from {LINKS} union select b, a from {LINKS}), v as {VERDICTS},
r as (select distinct wikititle node, 0 w from titles where year = 2025 union select l.target, r.w + 1 from r join l on l.source = r.node left join v on v.node = r.node where r.w < 3 and (r.w = 0 or v.status = 'accepted' or r.node in (select wikititle from titles where year = 2025))),
s as (select node, min(w) wave from r group by 1), j as (select s.node, case when wave = 0 then 'accepted' else coalesce(v.status, 'missing') end status, wave from s left join v on v.node = s.node)
select j.node, j.status, cast(j.wave as int) wave, (select count(*) from l join j x on x.node = l.source where l.target = j.node and x.status = 'accepted' and x.wave < 3) refs from j"""
)
def expand_waves(spark: SparkSession, d: str) -> DataFrame:
    """Three waves from the titles of a year to people and on to their other titles."""
    return expand(*_frontier(spark, d), 3)


@REGISTRY.query(f"select wikititle node, 'rejected' status, 'accepted' was from {TITLES} where coalesce(archive, false)")
def rejudged(spark: SparkSession, d: str) -> DataFrame:
    """Titles once accepted whose verdict is another now."""
    state = titles(spark, d).select(F.col("wikititle").alias("node"), F.lit("accepted").alias("status"))
    status = F.when(F.coalesce("archive", F.lit(False)), "rejected").otherwise("accepted")
    return rejudge(state, titles(spark, d).select(F.col("wikititle").alias("node"), status.alias("status")))


# --- written tables -----------------------------------------------------------------------------------------------------
@REGISTRY.query(f"select wikititle, count(*) entries from {PEOPLE} where wikititle ilike 'b%' group by 1")
def people_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Persons written by their first letter, the folder replaced whole, and one letter read back."""
    rows = people(spark, d).filter("wikititle is not null").groupBy("wikititle").agg(F.count("*").alias("entries"))
    path = scratch_path(spark, "people")
    for _ in range(2):  # written twice: the second replaces the first
        write_buckets(rows, path, "wikititle")
    return read_bucket(spark, path, "wikititle", "B")


@REGISTRY.query("select distinct id, title is not null as film from search_results where id is not null")
def tracked_ids(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "tracked")
    table(spark, d, "search_results").filter("id is not null").select("id", F.col("title").isNotNull().alias("film")).distinct().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@REGISTRY.query(f"select wikititle title, pageid, kind from {TITLES} where coalesce(year, 0) >= 2025 or kind = 'series'")
def watchlist_append(spark: SparkSession, d: str) -> DataFrame:
    """Two appends to the watchlist, of series and of late titles; an entry that is there already isn't added again."""
    path = scratch_path(spark, "watchlist")
    rows = titles(spark, d).select(F.col("wikititle").alias("title"), "pageid", "kind", "year")
    append_watchlist(rows.filter("kind = 'series'").drop("year"), path)
    return append_watchlist(rows.filter("coalesce(year, 0) >= 2025").drop("year"), path)


@REGISTRY.query(
    """with cut as (select median(epoch_us(landed_at)) mid from raw_pages), a as (select pageid, max(revid) revid from raw_pages, cut where epoch_us(landed_at) <= cut.mid group by 1), b as (select pageid, max(revid) revid from raw_pages group by 1)
select b.pageid, coalesce(b.revid, -1) as revid, case when a.pageid is null then 'added' else 'changed' end change from b left join a using (pageid) where a.pageid is null or a.revid is distinct from b.revid"""
)
def revid_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Two polls of the latest revisions: the first only sets the baseline, the second gives what changed since."""
    rows = table(spark, d, "raw_pages").select("pageid", "revid", F.unix_micros(F.col("landed_at").cast("timestamp")).alias("at"))
    middle = rows.agg((F.median("at")).alias("middle"))
    latest = lambda df: df.groupBy("pageid").agg(F.max("revid").alias("revid"))
    store = StateStore(spark, scratch_path(spark, "revids"))
    baseline_or_changes(store, latest(rows.join(F.broadcast(middle), rows["at"] <= middle["middle"])), "pageid", "revid")
    return baseline_or_changes(store, latest(rows), "pageid", "revid").withColumn("revid", F.coalesce("revid", F.lit(-1)))
