"""Queries that shape and merge records."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrain.markup.core import linked_html
from cinegrain.markup.lists import title_page
from cinegrain.operators import records as R
from cinegrain.plans.catalogue import PEOPLE, TITLES, people, titles
from cinegrain.plans.extraction import pages
from cinegrain.plans.registry import Registry
from cinegrain.session import table

REGISTRY = Registry()


@REGISTRY.query("select distinct pageid, kind, slug, title, wikititle, releasedate, coalesce(year, 0) as year, language, coalesce(archive, false) archive, len(directedby) episodecount from titles")
def title_summary(spark: SparkSession, d: str) -> DataFrame:
    full = table(spark, d, "titles").dropDuplicates(["pageid"]).drop("params").withColumnRenamed("directedby", "episodesList")
    for heavy in ("plot", "plotHtml", "nativeName", "tagline", "articleSections", "reception", "facts", "cast", "crew", "external", "trailer"):
        full = full.withColumn(heavy, F.col("episodesList"))
    t = R.title_summary(full, "episodesList")
    return t.withColumn("year", F.coalesce("year", F.lit(0))).withColumn("archive", F.coalesce("archive", F.lit(False))).withColumn("episodecount", F.col("episodecount").cast("bigint"))


@REGISTRY.query(r"""select fetch_id, case when coalesce(trim(wikitext), '') = '' then 'empty' when wikitext ilike '%{{infobox film%' then 'movie' when wikitext ilike '%{{infobox television%' then 'series' else 'no-infobox' end kind from (select distinct fetch_id, wikitext from raw_pages)""")
def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_pages").dropDuplicates(["fetch_id"]).select("fetch_id", R.page_kind(F.col("wikitext")).alias("kind"))


@REGISTRY.query("select p_partkey, left(p_name, 200) one_liner, 'a|b|c|d' moods from part")
def model_summaries(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('Sure: {"oneLiner": " '), "p_name", F.lit('", "moods": ["a", "", "b", "c", "d", "e"]} done'))
    s = R.ai_summary(raw)
    return table(spark, d, "part").select("p_partkey", s["oneLiner"].alias("one_liner"), F.array_join(s["moods"], "|").alias("moods"))


@REGISTRY.query("select o_orderkey, cast(x.n as varchar) number, case when x.n = 1 then o_orderpriority else 'Episode 2' end title, year(o_orderdate) season from orders, (values (1), (2)) x(n)")
def season_payloads(spark: SparkSession, d: str) -> DataFrame:
    payload = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("episode_number"), F.lit("special").alias("name")), F.struct(F.lit(1).alias("episode_number"), F.col("o_orderpriority").alias("name")), F.struct(F.lit(2).alias("episode_number"), F.lit("").alias("name"))).alias("episodes")))
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(R.season_episodes(payload, F.year("o_orderdate"))).alias("e"))
    return rows.select("o_orderkey", "e.number", "e.title", F.col("e.season").cast("bigint").alias("season"))


@REGISTRY.query(
    """with e as (select distinct l_orderkey k, l_linenumber n, case when l_linenumber % 2 = 0 then 2 end s, o_orderpriority || l_linenumber s2, o_custkey r2 from lineitem join orders on o_orderkey = l_orderkey)
select l_orderkey, l_linenumber, case when l_linestatus = 'F' then 'own' else s2 end summary, case when l_linenumber % 3 = 2 then '7' else cast(r2 as varchar) end runtime
from lineitem left join e on k = l_orderkey and n = l_linenumber and coalesce(s, 1) = coalesce(case l_linenumber % 3 when 1 then 1 when 2 then 2 end, 1)"""
)
def fill_episodes_all(spark: SparkSession, d: str) -> DataFrame:
    """Every line as an episode: its number, seasons that are missing or differ on either side, own runtimes on some."""
    n, lines = F.col("l_linenumber"), table(spark, d, "lineitem")
    own = lines.select("l_orderkey", "l_linenumber", n.cast("string").alias("number"), F.when(n % 3 == 1, 1).when(n % 3 == 2, 2).alias("season"), F.when(F.col("l_linestatus") == "F", "own").otherwise("").alias("summary"), F.when(n % 3 == 2, "7").otherwise("").alias("runtime"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_custkey")
    other = lines.select("l_orderkey", "l_linenumber").distinct().join(orders, "l_orderkey")
    other = other.select("l_orderkey", n.cast("string").alias("number"), F.when(n % 2 == 0, 2).alias("season"), F.concat("o_orderpriority", n.cast("string")).alias("summary"), F.col("o_custkey").cast("int").alias("runtime"))
    return R.fill_episodes(own, other, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "summary", "runtime")


@REGISTRY.query(f"select pageid, title || case when language in (title, '') then '' else '|' || language end as items, case when len(directedby) > 0 then directedby[1] else title end as leading from (select distinct pageid, title, language, directedby from titles)")
def list_unions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "titles").dropDuplicates(["pageid"])
    both = R.union_lists(F.array("title", F.lit("")), F.array("language", "title"), F.lit(None).cast("array<string>"))
    return t.select("pageid", F.array_join(both, "|").alias("items"), R.first_filled(F.col("directedby"), F.array("title"))[0].alias("leading"))


@REGISTRY.query("""select distinct pageid, case when pageid % 3 = 0 then 'own' else 'https://img.example/' || params['image'] end poster from titles where params['image'] is not null""")
def image_fallback(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "titles").filter("params is not null").dropDuplicates(["pageid"]).select("pageid", F.try_element_at("params", F.lit("image")).alias("image"), F.when(F.col("pageid") % 3 == 0, "own").alias("poster")).filter("image is not null")
    images = t.select(F.col("image").alias("file"), F.concat(F.lit("https://img.example/"), "image", F.lit("?utm=1")).alias("url")).distinct()
    return R.fill_images(t, images, "image", "poster").select("pageid", "poster")


@REGISTRY.query(
    f"""select p.entry_id, case when t.slug is not null then case when t.kind = 'series' then '/series/' else '/movies/' end || t.slug || '/' else 'https://en.wikipedia.org/wiki/' || replace(replace(replace(replace(replace(url_encode(replace(w, ' ', '_')), '%28', '('), '%29', ')'), '%21', '!'), '%27', ''''), '%2A', '*') end url
from (select entry_id, case when p.entry_id % 2 = 0 then t.wikititle else p.wikititle end w from {PEOPLE} p join {TITLES} t using (pageid) where p.wikititle is not null) p left join {TITLES} t on t.wikititle = p.w"""
)
def work_links_all(spark: SparkSession, d: str) -> DataFrame:
    t = titles(spark, d)
    rows = people(spark, d).filter("wikititle is not null").select("entry_id", "pageid", F.col("wikititle").alias("person")).join(t.select("pageid", "wikititle"), "pageid")
    rows = rows.select("entry_id", F.when(F.col("entry_id") % 2 == 0, F.col("wikititle")).otherwise(F.col("person")).alias("work"))
    return R.work_links(rows, t, "work").select("entry_id", "url")


@REGISTRY.query(
    f"""select t.pageid, case when t.pageid % 5 = 0 then 'new' when t.pageid % 2 = 0 then 'old' else 'new' end tagline, case when t.pageid % 3 = 0 then 'g' else 'x' end genre from {TITLES} t"""
)
def enrichment(spark: SparkSession, d: str) -> DataFrame:
    t = titles(spark, d).select("pageid", F.when(F.col("pageid") % 2 == 0, "old").alias("tagline"), F.when(F.col("pageid") % 3 == 0, "g").alias("genre"))
    details = t.select("pageid", F.lit("new").alias("tagline"), F.lit("x").alias("genre"))
    return R.enrich_gaps(t, details, "pageid", t.filter("pageid % 5 = 0"), ["tagline"], ["genre"])


@REGISTRY.query()
def title_pages(spark: SparkSession, d: str) -> DataFrame:
    """The main fields of every fetched page of a work."""
    schema = "fetch_id long, directedby array<string>, producedby array<string>, writtenby array<string>, starring array<string>, musicby array<string>, studio array<string>, language string, runtime string, plot string, n_references int"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [{"fetch_id": k, **title_page("", "", t)} for k, t in zip(frame["fetch_id"], frame["wikitext"])]
            yield pd.DataFrame(rows, columns=names)

    return pages(spark, d).mapInPandas(run, schema)


@REGISTRY.query("""select p_partkey, '<a href="/p/' || p_partkey || '">' || p_name || '</a> &amp; ' || p_brand || ' &lt; 5' html from part""")
def linked_text(spark: SparkSession, d: str) -> DataFrame:
    """Text with anchors to known pages; the addresses come by a join on the linked targets."""

    def run(batches):
        for b in batches:
            html = [linked_html(t, {k: u} if k else {}) for t, k, u in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(html, pa.string())], names=["p_partkey", "html"])

    parts = table(spark, d, "part")
    text = parts.select("p_partkey", F.concat(F.lit("[[Part "), F.col("p_partkey").cast("string"), F.lit("|"), "p_name", F.lit("]] & [[B|"), "p_brand", F.lit("]] < 5[[File:x.jpg]]")).alias("text"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("target"))
    known = parts.select(F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("target"), F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("url"))
    return text.join(known, "target", "left").select("p_partkey", "text", "target", "url").mapInArrow(run, "p_partkey long, html string")
