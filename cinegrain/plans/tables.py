"""Queries over sources, sinks, the refresh stream, and further grouped views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinegrain.functions import scalars as S
from cinegrain.operators import delta, ranking
from cinegrain.plans.catalogue import PEOPLE, TITLES, people, titles
from cinegrain.plans.registry import Registry
from cinegrain.session import scratch_path, table
from cinegrain.sources.landing import read_pages, read_title, write_titles
from cinegrain.streaming.refresh import changes_since, run_refresh

REGISTRY = Registry()

NEWEST = """select pageid, coalesce(revid, -1) revid, fetchedat, title from (select *, row_number() over (partition by pageid order by coalesce(revid, -1) desc, fetchedat::timestamptz desc, title desc) r
from raw_pages where not coalesce(missing, false)) where r = 1"""


@REGISTRY.query(NEWEST)
def refresh_stream(spark: SparkSession, d: str) -> DataFrame:
    landed = scratch_path(spark, "landed")
    table(spark, d, "raw_pages").select("pageid", "title", "missing", "fetchedat", "revid").repartition(4, "pageid").write.parquet(landed)
    return run_refresh(spark, landed).withColumn("revid", F.coalesce("revid", F.lit(-1)))


@REGISTRY.query(f"select pageid, kind, slug, title from {TITLES} where kind = 'movie' and slug = (select min(slug) from titles where kind = 'movie')")
def title_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A title from the table written by kind and bucket."""
    t, path = titles(spark, d), scratch_path(spark, "titles")
    write_titles(t, path)
    slug = t.filter("kind = 'movie'").agg(F.min("slug").alias("s")).first()["s"]
    return read_title(spark, path, "movie", slug).select("pageid", "kind", "slug", "title")


@REGISTRY.query("select pageid, title, fetchedat from (select distinct pageid, title, fetchedat from raw_pages) where pageid > 0 and title <> ''")
def json_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as JSON and read back with a fixed schema."""
    path = scratch_path(spark, "pages-json")
    table(spark, d, "raw_pages").select("pageid", "title", "wikitext", "fetchedat", "revid").write.json(path)
    return read_pages(spark, path).select("pageid", "title", "fetchedat").distinct()


@REGISTRY.query("select distinct event_type kind, user_id id from events where cast(ts as date) between (select max(cast(ts as date)) from events) - 14 and (select max(cast(ts as date)) from events)")
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    feed = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("id"), F.to_date("ts").alias("day"))
    today = feed.agg(F.max("day").cast("string").alias("t")).first()["t"]
    return changes_since(feed, None, today)


@REGISTRY.query("select l_suppkey, y, n, row_number() over (order by y desc, l_suppkey) place from (select l_suppkey, max(year(l_shipdate)) y, count(*) n from lineitem group by 1)")
def ceremony_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups ordered by their newest year."""
    groups = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max(F.year("l_shipdate")).cast("bigint").alias("y"), F.count("*").alias("n"))
    ranked = delta.global_rank(groups, [F.desc("y"), "l_suppkey"])
    return ranked.select("l_suppkey", "y", "n", (F.col("rank") + 1).cast("bigint").alias("place"))


@REGISTRY.query("select o_custkey, coalesce(season, 1) season, count(*) episodes from (select o_custkey, case when o_orderkey % 3 = 0 then null else year(o_orderdate) end season from orders) group by 1, 2")
def seasons(spark: SparkSession, d: str) -> DataFrame:
    season = F.when(F.col("o_orderkey") % 3 != 0, F.year("o_orderdate"))
    return table(spark, d, "orders").groupBy("o_custkey", F.coalesce(season, F.lit(1)).cast("bigint").alias("season")).agg(F.count("*").alias("episodes"))


@REGISTRY.query(f"select count(*) n, count(*) filter (where pageid % 3 = 0) with_poster, count(distinct language) as languages, count(distinct year) as years from {TITLES}")
def site_stats(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("pageid") % 3 == 0).alias("with_poster"), F.count_distinct("language").alias("languages"), F.count_distinct("year").alias("years"))


@REGISTRY.query(f"select entry_id, r > 8 overflow from (select entry_id, row_number() over (partition by pageid order by ord nulls last, entry_id) r from {PEOPLE})")
def overflow_flags(spark: SparkSession, d: str) -> DataFrame:
    return ranking.overflow(people(spark, d), ["pageid"], [F.asc_nulls_last("ord"), F.col("entry_id")], 8, "entry_id")


@REGISTRY.query(f"select entry_id from (select entry_id, row_number() over (partition by pageid, coalesce(wikititle, name, '') order by ord nulls last, entry_id) r from {PEOPLE}) where r = 1")
def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    keyed = people(spark, d).withColumn("who", F.coalesce("wikititle", "name", F.lit("")))
    return delta.first_seen(keyed, ["pageid", "who"], [F.asc_nulls_last("ord"), "entry_id"]).select("entry_id")


@REGISTRY.query("select page, pages, string_agg(cast(p as varchar), ',' order by p) links from (select distinct page, pages, p from range(1, 13) a(page), (values (1), (5), (12)) b(pages), range(1, 13) c(p) where page <= pages and p <= pages and (p = 1 or p = pages or abs(p - page) <= 2)) group by 1, 2")
def pagination(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(1, 13).select(F.col("id").alias("page"), F.explode(F.array(F.lit(1), F.lit(5), F.lit(12)).cast("array<bigint>")).alias("pages")).filter("page <= pages")
    return grid.select("page", F.col("pages").cast("int").alias("pages"), F.array_join(ranking.page_links(F.col("page"), F.col("pages")), ",").alias("links"))


@REGISTRY.query(
    f"""with t as {TITLES}, p as (select pageid, max(title) page_title, bool_or(coalesce(missing, false)) gone from raw_pages group by 1)
select t.pageid, case when p.pageid is null then 'not cached' when p.gone then 'missing' when p.page_title <> t.wikititle then 'drift' else 'ok' end verdict from t left join p using (pageid)"""
)
def identity_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the record and the cached page of a title agree."""
    cached = table(spark, d, "raw_pages").groupBy("pageid").agg(F.max("title").alias("page_title"), F.max(F.coalesce("missing", F.lit(False))).alias("gone"))
    verdict = F.when(F.col("page_title").isNull(), "not cached").when(F.col("gone"), "missing").when(F.col("page_title") != F.col("wikititle"), "drift").otherwise("ok")
    return titles(spark, d).join(cached, "pageid", "left").select("pageid", verdict.alias("verdict"))


@REGISTRY.query(
    f"""select distinct l.title, case when l.gone then 'missing' when regexp_matches(l.title, '^(draft|user|file|category|template|talk|help|portal)( talk)?\\s*:', 'i') then 'namespace' when t.pageid is not null then 'in corpus' else 'new' end gate
from (select title, bool_or(coalesce(missing, false)) gone from raw_pages group by 1) l left join {TITLES} t on t.wikititle = l.title"""
)
def admission_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gates a reported title passes, in order."""
    reported = table(spark, d, "raw_pages").groupBy("title").agg(F.max(F.coalesce("missing", F.lit(False))).alias("gone"))
    known = titles(spark, d).select(F.col("wikititle").alias("title"), F.lit(True).alias("known"))
    gate = F.when(F.col("gone"), "missing").when(~S.is_mainspace(F.col("title")), "namespace").when(F.col("known"), "in corpus").otherwise("new")
    return reported.join(known, "title", "left").select("title", gate.alias("gate"))


@REGISTRY.query("select p_partkey, year(d) - 1940 - case when month(d) < 3 or (month(d) = 3 and day(d) < 5) then 1 else 0 end age from (select p_partkey, date '2000-01-01' + cast(p_partkey as int) d from part)")
def ages(spark: SparkSession, d: str) -> DataFrame:
    """Ages on changing days from facts in words."""
    today = F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_partkey").cast("int"))
    return table(spark, d, "part").select("p_partkey", S.age_of(S.fact_date(F.lit("5 March 1940 (Kelabad)")), S.fact_date(F.lit("")), today).cast("bigint").alias("age"))


@REGISTRY.query("select p_partkey, least(500 * power(2, p_size), 30000) wait, 'https://' || lower(replace(p_brand, '#', '')) || '.example' url, lower(replace(p_brand, '#', '')) || '.example' chip from part")
def request_helpers(spark: SparkSession, d: str) -> DataFrame:
    host = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".example"))
    url = F.concat(F.lit("https://"), host)
    return table(spark, d, "part").select("p_partkey", S.backoff_ms(F.col("p_size")).cast("double").alias("wait"), url.alias("url"), S.publisher_chip(F.replace(url, F.lit("://"), F.lit("://www.")), F.lit("")).alias("chip"))
