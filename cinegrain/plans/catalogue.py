"""Queries of the catalogue's own operators: trends, refresh plans, facets, ranking, scalars, merging and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinegrain.functions import scalars as S
from cinegrain.operators import delta, ranking, resolve, search, trends
from cinegrain.plans.registry import Registry
from cinegrain.session import scratch_path, table

REGISTRY = Registry()
YEAR_NOW = 2026

TITLES = "(select distinct pageid, kind, slug, title, wikititle, releasedate, year, language, archive from titles)"
PEOPLE = "(select distinct entry_id, pageid, ord, origin, name, wikititle, slug, role from cast_entries)"
LAST_DAY = "(select distinct id, pid, s, k, t, y, l, p, r, rd, q from search_docs where snapshot_day = (select max(snapshot_day) from search_docs))"


def titles(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "titles").select("pageid", "kind", "slug", "title", "wikititle", "releasedate", "year", "language", "archive", *more).dropDuplicates(["pageid"])


def people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cast_entries").dropDuplicates(["entry_id"])


def day_docs(spark: SparkSession, d: str, first: bool = False) -> DataFrame:
    """The search documents of the last (or first) day."""
    docs = table(spark, d, "search_docs")
    day = docs.agg((F.min if first else F.max)("snapshot_day").alias("snapshot_day"))
    return docs.join(day, "snapshot_day", "left_semi").dropDuplicates(["id"])


def page_views(spark: SparkSession, d: str) -> DataFrame:
    """(title, day, views) from the event stream: a user's events of a day."""
    return table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("title"), F.to_date("ts").alias("day")).agg(F.count("*").alias("views"))


VIEWS = "(select cast(user_id as varchar) title, cast(ts as date) as day, count(*) as views from events group by 1, 2)"
SCORES = f"""(select title, cast(floor(sum(case when rn <= 2 then views else views * 0.5 end) + 0.5) as bigint) score, cast(sum(views) as bigint) as views
 from (select *, row_number() over (partition by title order by day desc) rn from {VIEWS}) group by title)"""


# --- trends -----------------------------------------------------------------------------------------------------------
@REGISTRY.query(f"select * from {SCORES}")
def trend_scores(spark: SparkSession, d: str) -> DataFrame:
    return trends.trend_scores(page_views(spark, d))


@REGISTRY.query(f"select * from {SCORES} where score > 0 order by score desc, title limit 50")
def trend_top(spark: SparkSession, d: str) -> DataFrame:
    return trends.top_ranked(trends.trend_scores(page_views(spark, d)), 50)


@REGISTRY.query(f"select title, cast(sum(views) as bigint) as views from {VIEWS} where day in (select distinct day from {VIEWS} order by day desc limit 7) group by title")
def recent_window_views(spark: SparkSession, d: str) -> DataFrame:
    return trends.recent_days(page_views(spark, d)).groupBy("title").agg(F.sum("views").alias("views"))


@REGISTRY.query(
    f"""with v as {VIEWS}, r as (select * from v where day > (select max(day) from v) - interval 5 day)
select title, cast(sum(views) as bigint) as views from r where day in (select distinct day from r order by day desc limit 3) group by title"""
)
def live_trending(spark: SparkSession, d: str) -> DataFrame:
    return trends.live_views(page_views(spark, d))


@REGISTRY.query(
    f"""with t as (select kind, slug, cast(pageid % 1000 as varchar) title from {TITLES}),
s as (select kind, slug, coalesce(score, 0) score, coalesce(views, 0) as views from t left join {SCORES} x using (title))
select kind, slug, score, views, case when score > 0 and rn <= 100 then rn else 0 end place
from (select *, row_number() over (partition by kind order by score desc, slug) rn from s)"""
)
def trends_payload(spark: SparkSession, d: str) -> DataFrame:
    keyed = titles(spark, d).select("kind", "slug", (F.col("pageid") % 1000).cast("string").alias("title"))
    return trends.trends_payload(keyed, page_views(spark, d), 100).withColumn("place", F.coalesce("place", F.lit(0)).cast("bigint"))


# --- refresh plans ----------------------------------------------------------------------------------------------------
def _revids(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(before, now): each page's highest revid before a day and over all fetches."""
    pages = table(spark, d, "raw_pages").filter("not coalesce(missing, false)")
    newest = lambda df: df.groupBy("pageid").agg(F.max("revid").alias("revid"), F.max("title").alias("title"))
    return newest(pages.filter("landed_at < timestamp'2026-01-15'")), newest(pages)


REVIDS = """(select pageid, max(revid) revid, max(title) title from raw_pages where not coalesce(missing, false) {} group by 1)"""
BEFORE, NOW = REVIDS.format("and landed_at < timestamp '2026-01-15'"), REVIDS.format("")


@REGISTRY.query(
    f"""select n.pageid, case when b.pageid is null then 'added' else 'changed' end as action from {NOW} n left join {BEFORE} b on b.pageid = n.pageid
where b.pageid is null or b.revid is distinct from n.revid"""
)
def plan_refresh(spark: SparkSession, d: str) -> DataFrame:
    before, now = _revids(spark, d)
    return delta.plan_refresh(before, now.select("pageid", "revid"))


@REGISTRY.query(
    f"""with planned as (select n.pageid, case when b.pageid is null then 'added' else 'changed' end as action from {NOW} n left join {BEFORE} b on b.pageid = n.pageid where b.pageid is null or b.revid is distinct from n.revid)
select pageid, action from planned union all select distinct pageid, 'forced' from cache_entries join refresh_runs using (run_id) where status = 'failed' and pageid not in (select pageid from planned)"""
)
def refresh_list(spark: SparkSession, d: str) -> DataFrame:
    """What is fetched again: what the poll shows, and what runs that failed had begun."""
    before, now = _revids(spark, d)
    failed = table(spark, d, "cache_entries").join(table(spark, d, "refresh_runs").filter("status = 'failed'").select("run_id"), "run_id", "left_semi")
    return delta.refresh_list(delta.plan_refresh(before, now.select("pageid", "revid")), failed)


@REGISTRY.query(f"select b.pageid, b.title old_title, t.wikititle new_title from {NOW} b join {TITLES} t on t.pageid = b.pageid where b.title <> t.wikititle")
def plan_renames(spark: SparkSession, d: str) -> DataFrame:
    return delta.plan_renames(_revids(spark, d)[1], titles(spark, d).select("pageid", F.col("wikititle").alias("title")))


CACHED = "(select pageid, arg_max(revid, (run_id, fetchedat)) revid from (select pageid, run_id, fetchedat, coalesce(revid, -1) revid from cache_entries) group by 1)"


@REGISTRY.query(
    f"""select c.pageid, case when c.revid = -1 then 'legacy' when c.revid <> n.revid then 'stale' else 'fresh' end verdict
from {CACHED} c join (select * from {NOW} where revid is not null) n on n.pageid = c.pageid"""
)
def plan_validation(spark: SparkSession, d: str) -> DataFrame:
    cached = table(spark, d, "cache_entries").groupBy("pageid").agg(F.max_by(F.coalesce("revid", F.lit(-1)), F.struct("run_id", "fetchedat")).alias("revid"))
    live = _revids(spark, d)[1].filter("revid is not null")
    return delta.plan_validation(cached.withColumn("revid", F.nullif("revid", F.lit(-1))), live)


@REGISTRY.query(
    """with e as (select pageid, max(fetchedat::timestamptz) seen from cache_entries group by 1),
t as (select pageid, max(fetchedat::timestamptz) ts from raw_pages where revid is not null group by 1)
select e.pageid, case when t.ts <= date_trunc('second', e.seen) then 'fresh' else 'stale' end verdict from e left join t using (pageid)"""
)
def legacy_fresh(spark: SparkSession, d: str) -> DataFrame:
    at = F.expr("try_cast(fetchedat as timestamp)")
    cached = table(spark, d, "cache_entries").groupBy("pageid").agg(F.max_by("fetchedat", at).alias("fetchedat"))
    return delta.legacy_by_time(cached, delta.top_revisions(table(spark, d, "raw_pages").filter("revid is not null"), at))


@REGISTRY.query(
    f"""with o as (select pageid, slug, kind from {TITLES}), n as (select pageid, case when pageid % 7 = 0 then slug || '-x' else slug end slug, case when pageid % 11 = 0 then 'series' else kind end kind from o)
select case when o.kind = 'series' then '/series/' else '/movies/' end || o.slug || '/' from_path, case when n.kind = 'series' then '/series/' else '/movies/' end || n.slug || '/' to_path
from n join o using (pageid) where n.slug <> o.slug or n.kind <> o.kind"""
)
def slug_redirects(spark: SparkSession, d: str) -> DataFrame:
    old = titles(spark, d).select("pageid", "slug", "kind")
    new = old.select("pageid", F.when(F.col("pageid") % 7 == 0, F.concat("slug", F.lit("-x"))).otherwise(F.col("slug")).alias("slug"), F.when(F.col("pageid") % 11 == 0, "series").otherwise(F.col("kind")).alias("kind"))
    return delta.slug_redirects(new, old)


DIFF = """with a as (select distinct id, pid from search_docs where snapshot_day = (select min(snapshot_day) from search_docs)),
b as (select distinct id, pid from search_docs where snapshot_day = (select max(snapshot_day) from search_docs))
select a.id, case when a.id like 'person:b%' then 'intentional' when a.pid in (select pid from b where pid is not null) then 'renamed' else 'unexpected' end status
from a where a.id not in (select id from b)
union all select id, 'added' from b where id not in (select id from a)"""


@REGISTRY.query(DIFF)
def doc_diff(spark: SparkSession, d: str) -> DataFrame:
    live, build = day_docs(spark, d, first=True).select("id", "pid"), day_docs(spark, d).select("id", "pid")
    return delta.diff_documents(live, build, live.filter("id like 'person:b%'").select("id"))


@REGISTRY.query(f"select count(*) filter (where status = 'unexpected') unexpected, count(*) filter (where status = 'unexpected') > 25 as failed from ({DIFF})")
def page_loss_gate(spark: SparkSession, d: str) -> DataFrame:
    return delta.page_loss(doc_diff(spark, d))


@REGISTRY.query(
    f"""with x as (select id, row_number() over (order by id) - 1 r, count(*) over () n from (select distinct id from {LAST_DAY}))
select id from x where r in (select cast(floor(i * n / 40.0) as bigint) from (select n from x limit 1), range(0, 40) t(i))"""
)
def canary_sample(spark: SparkSession, d: str) -> DataFrame:
    return delta.canary_sample(day_docs(spark, d).select("id"), 40)


@REGISTRY.query(
    f"""select pageid, releasedate from {TITLES} where releasedate <> '' and releasedate >= strftime(date '2026-03-01' - interval 45 day, '%Y-%m-%d')
and releasedate <= strftime(date '2026-03-01' + interval 548 day, '%Y-%m-%d')"""
)
def freshness_band(spark: SparkSession, d: str) -> DataFrame:
    tracked = titles(spark, d).select(F.col("pageid").alias("id"), "releasedate")
    return delta.freshness_band(tracked, F.lit("2026-03-01").cast("date")).select(F.col("id").alias("pageid"), "releasedate")


@REGISTRY.query("select distinct id from search_results where original_language = 'ta' and id not in (select id from search_results where name is not null)")
def orphan_sweep(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "search_results")
    return delta.orphan_sweep(results.filter("original_language = 'ta'").select("id").distinct(), results.filter("name is not null").select("id"))


@REGISTRY.query(
    """with c as (select distinct id from search_results where original_language = 'hi'), t as (select distinct id, case when title is not null then 'movie' else 'tv' end kind, id % 5 seasons from search_results)
select kind, id, '/' || kind || '/' || id || '?append_to_response=credits,videos' url from t where id in (select id from c)
union all select kind, id, '/' || kind || '/' || id || '?append_to_response=videos' from t where id in (select id from c)
union all select kind, id, '/' || kind || '/' || id || '/season/' || s from t, range(1, 51) r(s) where id in (select id from c) and kind = 'tv' and s <= seasons"""
)
def season_urls(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "search_results").dropDuplicates(["id"])
    kinds = results.select(F.when(F.col("title").isNotNull(), "movie").otherwise("tv").alias("kind"), "id", (F.col("id") % 5).cast("string").alias("seasons"), "original_language")
    return delta.season_urls(kinds.filter("original_language = 'hi'"), kinds.drop("original_language"))


@REGISTRY.query(
    f"""with o as (select '/movies/' || slug || '/' f, '/old/' || pageid t from {TITLES} where pageid % 3 = 0), n as (select '/movies/' || slug || '/' f, '/new/' || pageid t from {TITLES} where pageid % 2 = 0 and kind = 'movie'),
u as (select f, t from n union all select f, t from o where f not in (select f from n)), m as (select f from_path, max(t) to_path from u group by f)
select * from m where from_path not in (select '/movies/' || slug || '/' from {TITLES} where pageid % 5 = 0)"""
)
def redirect_upsert(spark: SparkSession, d: str) -> DataFrame:
    path, t = F.concat(F.lit("/movies/"), F.col("slug"), F.lit("/")), titles(spark, d)
    to = lambda df, p: df.select(path.alias("from_path"), F.concat(F.lit(p), F.col("pageid").cast("string")).alias("to_path"))
    return delta.upsert_redirects(to(t.filter("pageid % 3 = 0"), "/old/"), to(t.filter("pageid % 2 = 0 and kind = 'movie'"), "/new/"), t.filter("pageid % 5 = 0").select(path.alias("path")))


# --- facets and aggregates --------------------------------------------------------------------------------------------
@REGISTRY.query(f"""select coalesce(nullif(language, ''), 'Other') as language, count(*) filter (where kind = 'movie') movies, count(*) filter (where kind = 'series') series from {TITLES} group by 1""")
def language_stats(spark: SparkSession, d: str) -> DataFrame:
    pivot = titles(spark, d).groupBy(S.or_else(F.col("language"), "Other").alias("language")).pivot("kind", ["movie", "series"]).count()
    return pivot.select("language", F.coalesce("movie", F.lit(0)).alias("movies"), F.coalesce("series", F.lit(0)).alias("series"))


@REGISTRY.query(f"""select kind, language, n from (select kind, language, count(*) n, row_number() over (partition by kind order by count(*) desc, language) r from {TITLES} group by 1, 2 having count(*) >= 12) where r <= 12""")
def language_facets(spark: SparkSession, d: str) -> DataFrame:
    counts = titles(spark, d).groupBy("kind", "language").agg(F.count("*").alias("n")).filter("n >= 12")
    return ranking.running_cap(counts, ["kind"], [F.desc("n"), "language"], 12)


@REGISTRY.query(f"""select case when upper(substr(slug, 1, 1)) between 'A' and 'Z' then upper(substr(slug, 1, 1)) else '#' end bucket, kind, count(*) n from {TITLES} group by 1, 2""")
def letter_buckets(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).groupBy(S.bucket_key(F.col("slug")).alias("bucket"), "kind").agg(F.count("*").alias("n"))


@REGISTRY.query(f"select distinct year from {TITLES} where year is not null")
def distinct_years(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select("year").filter("year is not null").distinct()


@REGISTRY.query(f"select wikititle, count(distinct pageid) works, count(*) entries from {PEOPLE} where wikititle is not null group by 1")
def person_work_count(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).filter("wikititle is not null").groupBy("wikititle").agg(F.count_distinct("pageid").alias("works"), F.count("*").alias("entries"))


@REGISTRY.query("select pageid, count(*) n, count(*) filter (where missing) missing, count(revid) with_revid from (select distinct * from raw_pages) group by 1")
def frontier_status(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "raw_pages").dropDuplicates(["fetch_id"])
    return pages.groupBy("pageid").agg(F.count("*").alias("n"), F.count_if("missing").alias("missing"), F.count("revid").alias("with_revid"))


@REGISTRY.query(
    f"""select wikititle, count(*) refs, bool_or(origin = 'record') any_record, arg_min(role, ord) filter (where ord is not null and role <> '') first_role
from (select wikititle, origin, role, entry_id ord from {PEOPLE}) where wikititle is not null group by 1"""
)
def frontier_refs(spark: SparkSession, d: str) -> DataFrame:
    named = people(spark, d).filter("wikititle is not null")
    return named.groupBy("wikititle").agg(F.count("*").alias("refs"), F.bool_or(F.col("origin") == "record").alias("any_record"), F.min_by(F.nullif("role", F.lit("")), F.when(F.coalesce("role", F.lit("")) != "", F.col("entry_id"))).alias("first_role"))


@REGISTRY.query(
    f"""select wikititle, refs from (select wikititle, count(*) refs from {PEOPLE} where wikititle is not null and wikititle not in (select wikititle from titles) group by 1) order by refs desc, wikititle limit 500"""
)
def wave_order(spark: SparkSession, d: str) -> DataFrame:
    open_ = people(spark, d).filter("wikititle is not null").join(titles(spark, d).select("wikititle"), "wikititle", "left_anti")
    return open_.groupBy("wikititle").agg(F.count("*").alias("refs")).orderBy(F.desc("refs"), "wikititle").limit(500)


# --- ordering and pages -----------------------------------------------------------------------------------------------
ORDER = "case when coalesce(releasedate, '') = '' then 1 else 0 end, nullif(releasedate, '') desc, year desc nulls last, title, pageid"


@REGISTRY.query(
    f"""select kind, pageid, r place, cast(ceil(r / 200.0) as int) page, cast(greatest(1, ceil(n / 200.0)) as int) pages
from (select kind, pageid, row_number() over (partition by kind order by {ORDER}) r, count(*) over (partition by kind) n from {TITLES})"""
)
def index_pages(spark: SparkSession, d: str) -> DataFrame:
    return ranking.index_pages(titles(spark, d)).select("kind", "pageid", F.col("place").cast("bigint").alias("place"), "page", "pages")


@REGISTRY.query(f"select pageid, releasedate from {TITLES} where not coalesce(archive, false) and releasedate <> '' and releasedate <= '2026-03-01' order by releasedate desc, pageid limit 100")
def recent_titles(spark: SparkSession, d: str) -> DataFrame:
    out = titles(spark, d).filter("not coalesce(archive, false) and releasedate <> '' and releasedate <= '2026-03-01'")
    return out.orderBy(F.desc("releasedate"), "pageid").select("pageid", "releasedate").limit(100)


@REGISTRY.query(f"select pageid, releasedate from {TITLES} where not coalesce(archive, false) and releasedate > '2026-03-01' order by releasedate, pageid limit 100")
def coming_soon(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).filter("not coalesce(archive, false) and releasedate > '2026-03-01'").orderBy("releasedate", "pageid").select("pageid", "releasedate").limit(100)


@REGISTRY.query(f"select pageid, title from {TITLES} where not coalesce(archive, false) and coalesce(releasedate, '') = ''")
def undated_titles(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).filter("not coalesce(archive, false) and coalesce(releasedate, '') = ''").select("pageid", "title")


@REGISTRY.query(f"select wikititle, count(distinct pageid) credits from {PEOPLE} where wikititle is not null group by 1 order by credits desc, wikititle limit 60")
def spotlight_people(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).filter("wikititle is not null").groupBy("wikititle").agg(F.count_distinct("pageid").alias("credits")).orderBy(F.desc("credits"), "wikititle").limit(60)


KNOWN_SQL = f"""
with w as (select wikititle person, pageid, bool_or(ord = 1) won from {PEOPLE} where wikititle is not null group by 1, 2),
t as (select pageid, title, year, archive, cast(pageid % 5000 as bigint) votes, (pageid % 97) / 10.0 rating, case when pageid % 3 = 0 then slug end poster from {TITLES}),
s as (select person, title, year, pageid, floor((
 case when votes > 0 then 2 * log10(greatest(votes, 10)) else 0 end + case when votes >= 10 then 1.5 * (rating - 5) else 0 end
 + case when coalesce(year, 0) > 0 then greatest(0, 3 - 0.05 * (2026 - year)) else 0 end + case when won then 2 else 0 end
 + case when coalesce(archive, false) then 0.25 else 1 end + case when poster is not null then 0.5 else 0 end) * 100 + 0.5) / 100 score from w join t using (pageid))
select person, title, coalesce(year, 0) as year, score, place from (select *, row_number() over (partition by person order by score desc, coalesce(year, 0) desc, title) place from s) where place <= 6
"""


@REGISTRY.query(KNOWN_SQL)
def known_for(spark: SparkSession, d: str) -> DataFrame:
    works = people(spark, d).filter("wikititle is not null").groupBy(F.col("wikititle").alias("person"), F.col("pageid").cast("string").alias("wikititle")).agg(F.bool_or(F.col("ord") == 1).alias("won"))
    records = titles(spark, d).select(F.col("pageid").cast("string").alias("wikititle"), "title", "year", "archive", (F.col("pageid") % 5000).alias("votes"), ((F.col("pageid") % 97) / 10.0).alias("rating"), F.when(F.col("pageid") % 3 == 0, F.col("slug")).alias("poster"))
    return ranking.known_for(works, records, YEAR_NOW).withColumn("year", F.coalesce("year", F.lit(0))).withColumn("place", F.col("place").cast("bigint"))


@REGISTRY.query(
    f"""select pageid, id, cast(tier as int) tier from (select t.pageid, s.id, case when s.low = lower(trim(t.title)) and s.y = t.year then 0 when s.low = lower(trim(t.title)) then 1 when s.y = t.year then 2 else 3 end tier,
row_number() over (partition by t.pageid order by tier, s.id) r from {TITLES} t join (select distinct id, case when title is null then 'series' else 'movie' end kind, lower(trim(coalesce(title, name))) low, try_cast(left(coalesce(release_date, first_air_date), 4) as int) y from search_results) s using (kind)) where r = 1"""
)
def pick_match_all(spark: SparkSession, d: str) -> DataFrame:
    """The best result of each title among all results of its kind; series have their title in ``name``."""
    results = table(spark, d, "search_results").dropDuplicates(["id"])
    kind = F.when(F.col("title").isNull(), "series").otherwise("movie")
    results = results.select("id", kind.alias("kind"), F.coalesce("title", "name").alias("title"), F.left(F.coalesce("release_date", "first_air_date"), F.lit(4)).try_cast("int").alias("year"))
    return ranking.best_matches(titles(spark, d).select(F.col("pageid").alias("key"), "kind", "title", "year"), results).withColumnRenamed("key", "pageid")


@REGISTRY.query(
    """select pageid, entry_id, cast(score as int) score from (select *, row_number() over (partition by pageid order by case when score >= 3 then 0 else 1 end, case when score >= 3 then 0 else -score end, ord) r
from (select distinct pageid, entry_id, ord - 1 as ord, entry_id % 5 - 1 as score from cast_entries where ord <= 4)) where r = 1 and score > 0"""
)
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    scored = people(spark, d).filter("ord is not null").select("pageid", "entry_id", (F.col("ord") - 1).alias("ord"), (F.col("entry_id") % 5 - 1).cast("int").alias("score"))
    return ranking.best_candidate(scored, ["pageid"]).select("pageid", "entry_id", "score")


VIDEO_TYPES = ["Trailer", "Teaser", "Clip", "Featurette"]


@REGISTRY.query(
    f"""select pageid, arg_min(cast(entry_id as varchar), (tier, ord, entry_id)) as key from (select pageid, entry_id, entry_id as ord, case when ty = 0 and o then 0 when ty = 0 then 1 when ty = 1 and o then 2 when ty = 1 then 3 else 4 end tier
from (select pageid, entry_id, entry_id % 4 ty, entry_id % 3 = 0 o from {PEOPLE} where entry_id % 5 <> 0)) group by pageid"""
)
def pick_trailer(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("entry_id")
    videos = people(spark, d).select("pageid", F.lit(0).alias("pool"), e.alias("ord"), e.cast("string").alias("key"), F.when(e % 5 == 0, "Vimeo").otherwise("YouTube").alias("site"), F.get(F.array(*map(F.lit, VIDEO_TYPES)), (e % 4).cast("int")).alias("type"), (e % 3 == 0).alias("official"))
    return ranking.pick_trailer(videos, ["pageid"])


@REGISTRY.query(
    f"""with n as (select distinct pageid, regexp_replace(lower(name), '[^a-z]', '', 'g') n from {PEOPLE} where origin = 'record'),
c as (select pageid, regexp_replace(lower(name), '[^a-z]', '', 'g') n, case when lower(role) like '%director%' or role = 'inspector' then 3 else 1 end w from {PEOPLE} where origin = 'wiki')
select pageid, cast(sum(w) as bigint) score from c join n using (pageid, n) where n <> '' group by pageid"""
)
def name_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = people(spark, d)
    job = F.when(F.col("role") == "inspector", "Director").otherwise(F.coalesce("role", F.lit("")))
    return ranking.name_overlap(p.filter("origin = 'wiki'").select("pageid", "name", job.alias("job")), p.filter("origin = 'record'").select("pageid", "name"), ["pageid"])


@REGISTRY.query(
    """select l_orderkey, l_linenumber, coalesce(last_value(q ignore nulls) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and current row), 0) quantity
from (select *, case when l_linenumber % 3 = 1 then l_quantity end q from lineitem)"""
)
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("quantity", F.when(F.col("l_linenumber") % 3 == 1, F.col("l_quantity")))
    return ranking.carried(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "quantity").select("l_orderkey", "l_linenumber", F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


@REGISTRY.query(
    """select l_orderkey, l_linenumber from (select *, sum(case when l_returnflag = 'R' then 1 else 0 end) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding) bad from lineitem) where bad = 0"""
)
def season_gap(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("has", F.col("l_returnflag") != "R")
    return ranking.until_gap(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "has").select("l_orderkey", "l_linenumber")


@REGISTRY.query(f"select entry_id from (select entry_id, row_number() over (partition by wikititle order by pageid, ord nulls first, entry_id) r from {PEOPLE} where wikititle is not null) where r <= 240")
def running_cap(spark: SparkSession, d: str) -> DataFrame:
    return ranking.running_cap(people(spark, d).filter("wikititle is not null"), ["wikititle"], ["pageid", F.asc_nulls_first("ord"), "entry_id"], 240).select("entry_id")


# --- resolution -------------------------------------------------------------------------------------------------------
CHAIN_SQL = """
with recursive e as (select from_title f, arg_min(to_title, (ord, to_title)) t from redirects where from_title <> '' and to_title <> '' group by 1),
w as (select f, t as cur, [f, t] seen, 0 n from e
 union all select w.f, e.t, list_append(w.seen, e.t), n + 1 from w join e on e.f = w.cur where not list_contains(w.seen, e.t))
select f from_title, arg_max(cur, n) final_title from w group by f
"""


@REGISTRY.query(CHAIN_SQL)
def redirect_chain(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_titles(table(spark, d, "redirects"))


@REGISTRY.query("""with t as (select r_name parent, n_name child from region join nation on r_regionkey = n_regionkey), c as (select n_name parent, 'segment ' || c_mktsegment child from customer join nation on n_nationkey = c_nationkey),
l1 as (select distinct child node from t where parent = 'ASIA'), l2 as (select distinct child node from c where parent in (select node from l1))
select 'ASIA' node, 0 as level union all select node, 1 from l1 union all select node, 2 from l2""")
def category_bfs(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    first = table(spark, d, "region").join(nation, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    second = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("parent"), F.concat(F.lit("segment "), "c_mktsegment").alias("child")).distinct()
    return resolve.category_walk(first.unionByName(second), spark.createDataFrame([("ASIA",)], "node string"))


@REGISTRY.query(f"with u as (select name, min(wikititle) w from {PEOPLE} where wikititle is not null and name is not null group by 1 having min(wikititle) = max(wikititle)) select p.entry_id, u.w wikititle from {PEOPLE} p join u using (name) where p.wikititle is null")
def unique_name_links(spark: SparkSession, d: str) -> DataFrame:
    p = people(spark, d)
    names = resolve.unique_names(p.filter("wikititle is not null"), "name", "wikititle")
    return p.filter("wikititle is null").select("entry_id", "name").join(names, "name").select("entry_id", "wikititle")


@REGISTRY.query(
    f"""with p as {PEOPLE}, c as (select wikititle person, pageid, role, 0 tier, coalesce(ord, 0) as ord from p where origin = 'wiki' union all select wikititle, pageid, role, 1, coalesce(ord, 0) from p where origin = 'record' or ord > 5)
select person, pageid, arg_min(coalesce(role, ''), (tier, ord, coalesce(role, ''))) as role from c where person is not null group by 1, 2"""
)
def first_credits(spark: SparkSession, d: str) -> DataFrame:
    p = people(spark, d).select(F.col("wikititle").alias("person"), "pageid", F.coalesce("role", F.lit("")).alias("role"), "origin", F.coalesce("ord", F.lit(0)).alias("ord"))
    return resolve.first_credits(p.filter("origin = 'wiki'"), p.filter("origin = 'record' or ord > 5"))


@REGISTRY.query(f"select p.entry_id, coalesce(c.final_title, p.wikititle) canonical, t.slug from {PEOPLE} p left join ({CHAIN_SQL}) c on c.from_title = p.wikititle left join {TITLES} t on t.wikititle = coalesce(c.final_title, p.wikititle) where p.wikititle is not null")
def canonical_cast(spark: SparkSession, d: str) -> DataFrame:
    linked = resolve.canonical(people(spark, d).filter("wikititle is not null").select("entry_id", "wikititle"), resolve.resolve_titles(table(spark, d, "redirects")), "wikititle")
    return linked.join(titles(spark, d).select(F.col("wikititle").alias("canonical"), "slug"), "canonical", "left").select("entry_id", "canonical", "slug")


@REGISTRY.query(f"select w.wikititle, coalesce(c.final_title, w.wikititle) canonical, coalesce(t.pageid, -1) pageid from (select distinct wikititle from {PEOPLE} where wikititle is not null union select from_title from redirects where from_title <> '') w left join ({CHAIN_SQL}) c on c.from_title = w.wikititle left join {TITLES} t on t.wikititle = coalesce(c.final_title, w.wikititle)")
def page_ids(spark: SparkSession, d: str) -> DataFrame:
    """The page of every title that is linked or redirects, -1 where there is none."""
    linked = people(spark, d).select("wikititle").unionByName(table(spark, d, "redirects").filter("from_title <> ''").select(F.col("from_title").alias("wikititle")))
    return resolve.page_ids(linked, resolve.resolve_titles(table(spark, d, "redirects")), titles(spark, d).select(F.col("wikititle").alias("title"), "pageid"), "wikititle")


@REGISTRY.query()
def slug_registry(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of all titles of a kind, issued in page id order."""
    based = titles(spark, d).select("pageid", "kind", S.slugify(F.col("title"), F.col("pageid")).alias("base"))
    return resolve.issue_slugs(based.withColumn("base", F.col("base")), "base", ["pageid"]).select("pageid", "kind", "slug")


@REGISTRY.query("select name, min(rank) source_rank from (select n_name as name, 0 rank from nation where n_regionkey < 2 union all select n_name, 1 from nation union all select r_name, 2 from region) group by 1")
def merge_roots(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    own = [n.filter("n_regionkey < 2").select(F.col("n_name").alias("name")), n.select(F.col("n_name").alias("name")), r.select(F.col("r_name").alias("name"))]
    return resolve.merge_ranked(own, ["name"], ["name"]).select("name", "source_rank")


@REGISTRY.query(
    f"""with walk as (select wikititle title from {TITLES} where pageid % 2 = 0), list as (select title, pageid, fetch_id as ord from (select distinct fetch_id, title, pageid from raw_pages) where pageid > 0 and title <> ''),
a as (select *, row_number() over (partition by title order by ord) r from list where title not in (select title from walk)),
b as (select *, row_number() over (partition by pageid order by ord) r2 from a where r = 1) select title, pageid from b where r2 = 1"""
)
def merge_admitted(spark: SparkSession, d: str) -> DataFrame:
    walk = titles(spark, d).filter("pageid % 2 = 0").select(F.col("wikititle").alias("title"))
    listed = table(spark, d, "raw_pages").select("title", "pageid", F.col("fetch_id").alias("ord")).distinct()
    return resolve.admitted(walk, listed).select("title", "pageid")


# --- search -----------------------------------------------------------------------------------------------------------
@REGISTRY.query(
    f"""with c as (select distinct on (pageid, name) pageid, name, ord, entry_id from {PEOPLE} where slug is not null or wikititle is not null order by pageid, name, ord nulls last, entry_id),
d as (select pageid, n as name, i as ord from (select pageid, unnest(directedby) n, generate_subscripts(directedby, 1) i from (select distinct pageid, directedby from titles))),
u as (select pageid, name, min((tier, o, e)) k from (select pageid, name, 0 tier, ord o, 0 e from d union all select pageid, name, 1, coalesce(ord, 1000000), entry_id from c) where name is not null group by 1, 2),
r as (select pageid, name, row_number() over (partition by pageid order by k) n from u)
select t.kind || ':' || t.slug id, t.title t, coalesce(string_agg(r.name, '|' order by r.n), '') q from {TITLES} t left join (select * from r where n <= 8) r using (pageid) group by 1, 2"""
)
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    """As its SQL, of titles only; ``search_documents_all`` has the persons too."""
    docs = search.build_documents(titles(spark, d, "directedby"), people(spark, d).filter("slug is not null or wikititle is not null"))
    return docs.select("id", "t", F.array_join("q", "|").alias("q"))


@REGISTRY.query()
def search_documents_all(spark: SparkSession, d: str) -> DataFrame:
    """Documents of titles and of linked persons; slugs of persons without one are issued from their article's title."""
    t, p = titles(spark, d, "directedby"), people(spark, d).filter("slug is not null or wikititle is not null")
    named = p.filter("wikititle is not null").select("wikititle").distinct().withColumn("base", S.slugify(F.col("wikititle")))
    issued = resolve.issue_slugs(named, "base", ["wikititle"]).select("wikititle", F.col("slug").alias("issued"))
    credits = p.join(issued, "wikititle", "left").join(t.select("pageid", "title"), "pageid", "left")
    own = F.col("wikititle").isNotNull()
    credits = credits.select(F.coalesce("slug", "issued").alias("slug"), F.when(own, 0).otherwise(1).alias("rank"), F.when(own, S.display_title(F.col("wikititle"))).otherwise(F.col("name")).alias("name"), "title", F.struct("pageid", "entry_id").alias("ord"))
    docs = search.build_documents(t, p).unionByName(search.person_documents(credits))
    return docs.select("id", "t", F.array_join("q", "|").alias("q"))


@REGISTRY.query(f"select distinct id from {LAST_DAY}, unnest(regexp_split_to_array(lower(t), '[^a-z0-9]+')) x(w) where w like 'lan%'")
def search_prefix(spark: SparkSession, d: str) -> DataFrame:
    return search.find(search.postings(day_docs(spark, d)), "lan", fuzzy=0.0, fields=["t"]).select("id")


@REGISTRY.query(f"select distinct id from {LAST_DAY}, unnest(regexp_split_to_array(lower(t), '[^a-z0-9]+')) x(w) where w like 'latern%' or levenshtein(w, 'latern') <= 1")
def search_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return search.find(search.postings(day_docs(spark, d)), "latern", fuzzy=0.2, fields=["t"]).select("id")


@REGISTRY.query(f"select distinct id from {LAST_DAY}, unnest(regexp_split_to_array(lower(t), '[^a-z0-9]+')) x(w) where w like 'latern%' or levenshtein(w, 'latern') <= 1")
def search_written(spark: SparkSession, d: str) -> DataFrame:
    """The same words by an index that is kept."""
    path = scratch_path(spark, "search-index")
    search.write_index(search.postings(day_docs(spark, d)), path)
    return search.find_written(spark, path, "latern", fuzzy=0.2, fields=["t"])


@REGISTRY.query()
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The best 60 documents of a query over titles and names, grouped by kind."""
    docs = day_docs(spark, d)
    return search.ranked(docs, search.postings(docs), "paper lantern", 60)


# --- merging of records -----------------------------------------------------------------------------------------------
@REGISTRY.query("""select l_orderkey, l_linenumber, coalesce(nullif(case when l_linenumber % 2 = 0 then l_linestatus else '' end, ''), o_orderpriority) summary from lineitem left join orders on o_orderkey = l_orderkey""")
def episode_fill(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).otherwise("").alias("own"))
    other = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return lines.join(other, "l_orderkey", "left").select("l_orderkey", "l_linenumber", S.or_else(F.col("own"), F.col("o_orderpriority")).alias("summary"))


@REGISTRY.query(
    f"""select t.pageid, coalesce(nullif(t.releasedate, ''), s.rd) releasedate, case when t.pageid % 4 = 0 then s.p else coalesce(case when t.pageid % 3 = 0 then t.slug end, s.p) end poster
from {TITLES} t left join (select pid, arg_max(rd, loaded_at) rd, arg_max(p, loaded_at) p from (select pid, loaded_at, coalesce(rd, '') rd, coalesce(p, '') p from search_docs where pid is not null and k <> 'person') group by 1) s on s.pid = t.pageid"""
)
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "search_docs").filter("pid is not null and k <> 'person'").groupBy(F.col("pid").alias("pageid")).agg(F.max_by(F.coalesce("rd", F.lit("")), "loaded_at").alias("rd"), F.max_by(F.coalesce("p", F.lit("")), "loaded_at").alias("p"))
    own = F.when(F.col("pageid") % 3 == 0, F.col("slug"))
    poster = F.when(F.col("pageid") % 4 == 0, F.col("p")).otherwise(F.coalesce(own, F.col("p")))
    return titles(spark, d).join(docs, "pageid", "left").select("pageid", S.or_else(F.col("releasedate"), F.col("rd")).alias("releasedate"), poster.alias("poster"))


# --- scalars ----------------------------------------------------------------------------------------------------------
def _disambiguated(c: str) -> str:
    return f"regexp_replace({c}, '\\s*\\([^()]*(film|series|movie|web series|TV series|talk show|game show|reality show|season|franchise|soundtrack)[^()]*\\)\\s*$', '', 'i')"


@REGISTRY.query(
    f"""select pageid, coalesce(nullif(lower(regexp_replace(regexp_replace(replace(replace(replace(strip_accents({_disambiguated("wikititle")}), '''', ''), '’', ''), '&', ' and '), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'p' || pageid) slug from {TITLES}"""
)
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select("pageid", S.slugify(F.col("wikititle"), F.col("pageid")).alias("slug"))


@REGISTRY.query(f"select pageid, coalesce(nullif(trim({_disambiguated('wikititle')}), ''), wikititle) shown from {TITLES}")
def display_title(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select("pageid", S.display_title(F.col("wikititle")).alias("shown"))


@REGISTRY.query(f"select pageid, 'https://en.wikipedia.org/wiki/' || replace(replace(replace(replace(replace(url_encode(replace(wikititle, ' ', '_')), '%28', '('), '%29', ')'), '%21', '!'), '%27', ''''), '%2A', '*') url from {TITLES}")
def wiki_url(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select("pageid", S.wiki_url(F.col("wikititle")).alias("url"))


@REGISTRY.query(
    f"""select pageid, upper(substr(split_part(title, ' ', 1), 1, 1) || substr(split_part(title, ' ', 2), 1, 1)) initials, lower(regexp_replace(language, '[^A-Za-z0-9]+', '-', 'g')) lang_slug, regexp_replace(lower(title), '[^a-z]', '', 'g') plain,
substr(sha1(title), 1, 20) as key, replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') html, year is distinct from 2026 as archive_tier from {TITLES}"""
)
def scalar_mix(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return titles(spark, d).select("pageid", S.initials(t).alias("initials"), S.language_slug(F.col("language")).alias("lang_slug"), S.plain_name(t).alias("plain"), S.cache_key(t, 20).alias("key"), S.escaped_html(t).alias("html"), S.archive_tier(F.col("year"), YEAR_NOW).alias("archive_tier"))


@REGISTRY.query(
    f"""select pageid, start_date, case when m is null then null when m < 60 then m || ' min' when m % 60 = 0 then m // 60 || 'h' else m // 60 || 'h ' || m % 60 || 'm' end runtime
from (select pageid, case when y is null then null else y || '-' || lpad(mo, 2, '0') || '-' || lpad(dd, 2, '0') end start_date, m from (select pageid, nullif(regexp_extract(params['released'], '\\|(\\d{{4}})\\|(\\d+)\\|(\\d+)', 1), '') y, regexp_extract(params['released'], '\\|(\\d{{4}})\\|(\\d+)\\|(\\d+)', 2) mo,
regexp_extract(params['released'], '\\|(\\d{{4}})\\|(\\d+)\\|(\\d+)', 3) dd, try_cast(regexp_extract(params['runtime'], '(\\d{{1,3}})', 1) as int) m from (select distinct pageid, params from titles where params is not null)))"""
)
def page_parameters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "titles").filter("params is not null").dropDuplicates(["pageid"])
    p = lambda k: F.try_element_at("params", F.lit(k))
    return rows.select("pageid", S.start_date(p("released")).alias("start_date"), S.runtime_text(p("runtime")).alias("runtime"))


@REGISTRY.query()
def taglines_all(spark: SparkSession, d: str) -> DataFrame:
    """Every document, whatever its label and first sentence; a null text has a null tagline."""
    return table(spark, d, "documents").select("doc_id", S.tagline_of(F.col("text")).alias("tagline"))


@REGISTRY.query(f"select id, case k when 'movie' then '/movies/' || s || '/' when 'series' then '/series/' || s || '/' when 'person' then '/people/' || s || '/' else '/' end url from {LAST_DAY}")
def doc_urls(spark: SparkSession, d: str) -> DataFrame:
    return day_docs(spark, d).select("id", S.doc_url(F.col("id")).alias("url"))


@REGISTRY.query(f"select pageid, cast(case when iso is null then 0 when left(title, 1) < 'M' then case when iso = 'hi' then 3 else -3 end else case when iso = 'ta' then 3 else -3 end end as int) bonus from (select pageid, title, case split_part(lower(language), ',', 1) when 'hindi' then 'hi' when 'tamil' then 'ta' when 'bengali' then 'bn' when 'marathi' then 'mr' end iso from {TITLES})")
def language_bonus(spark: SparkSession, d: str) -> DataFrame:
    guess = F.when(F.left("title", F.lit(1)) < "M", "hi").otherwise("ta")
    return titles(spark, d).select("pageid", S.language_bonus(guess, F.col("language")).alias("bonus"))


@REGISTRY.query("""select fetch_id, not regexp_matches(title, '^(draft|user|file|category|template|talk|help|portal)( talk)?\\s*:', 'i') mainspace, length(trim(title)) < 4 or regexp_matches(trim(title), '\\bawards?( ceremony| function)?$', 'i') or regexp_matches(trim(title), '\\s\\(season \\d+\\)$', 'i') or regexp_matches(trim(title), '^(list of )?\\d{4} in\\b', 'i') non_title from (select distinct fetch_id, title from raw_pages)""")
def title_filters(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return table(spark, d, "raw_pages").select("fetch_id", "title").distinct().select("fetch_id", S.is_mainspace(t).alias("mainspace"), S.is_non_title_name(t).alias("non_title"))


@REGISTRY.query()
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of long documents cut into chunks of three sentences, with the leads and dates they name."""
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.size(S.sentence_chunks(F.col("text"))).alias("n_chunks"), S.lead_sentence(F.col("text"))["lead"].alias("lead"), F.array_join(S.timeline_dates(F.col("text")), "|").alias("dates"), S.truncated(F.col("text"), 900).alias("short"))


@REGISTRY.query(f"select pageid, '{{\"@type\":\"' || case kind when 'series' then 'TVSeries' else 'Movie' end || '\",\"name\":' || to_json(title) || '}}' json from {TITLES}")
def json_ld(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == "series", "TVSeries").otherwise("Movie")
    return titles(spark, d).select("pageid", F.to_json(F.struct(kind.alias("@type"), F.col("title").alias("name"))).alias("json"))


@REGISTRY.query(
    f"""with t as (select pageid, lower(title) low, year from {TITLES})
select pageid, related from (select a.pageid, b.pageid related, row_number() over (partition by a.pageid order by b.year desc nulls last, b.pageid) r from t a join t b on a.low = b.low and a.pageid <> b.pageid) where r <= 6"""
)
def related_titles(spark: SparkSession, d: str) -> DataFrame:
    return ranking.related(titles(spark, d).select("pageid", F.lower("title").alias("low"), "year"), "low", "pageid", [F.desc_nulls_last("year"), F.col("pageid")], 6)
