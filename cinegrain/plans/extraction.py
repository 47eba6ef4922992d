"""Queries that read markup: pages as they are, and records written as markup and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrain.markup.udfs import exploded, extracted
from cinegrain.plans.catalogue import PEOPLE, TITLES, people, titles
from cinegrain.plans.registry import Registry
from cinegrain.session import table

REGISTRY = Registry()
NOISE = "<ref name=\"n\">{{cite web|title=Note|url=https://reel.example/1}}</ref><!-- check -->"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_pages").select("fetch_id", "wikitext").filter("wikitext is not null").dropDuplicates(["fetch_id"])


def written(df: DataFrame, key: str, line: Column, head: str, tail: str = "", order: list[str] = ("pos",), between: str = "\n") -> DataFrame:
    """(key, text): the lines of each key in order, as one page."""
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return df.groupBy(key).agg(F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["line"]), between), F.lit(tail)).alias("text"))


# --- pages as they are --------------------------------------------------------------------------------------------------
@REGISTRY.query()
def page_infobox(spark: SparkSession, d: str) -> DataFrame:
    return exploded(pages(spark, d), "fetch_id", "wikitext", "infobox")


@REGISTRY.query()
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return exploded(pages(spark, d), "fetch_id", "wikitext", "links")


@REGISTRY.query()
def page_plain_text(spark: SparkSession, d: str) -> DataFrame:
    return extracted(pages(spark, d), "fetch_id", "wikitext", "plain")


@REGISTRY.query()
def page_references(spark: SparkSession, d: str) -> DataFrame:
    return exploded(pages(spark, d), "fetch_id", "wikitext", "references")


@REGISTRY.query()
def page_tables(spark: SparkSession, d: str) -> DataFrame:
    return exploded(pages(spark, d), "fetch_id", "wikitext", "grid").drop("pos")


@REGISTRY.query(
    r"""select fetch_id, count(*) filter (where regexp_full_match(l, '={2,6}\s*.+?\s*=+\s*')) n_sections, cast(sum((length(l) - length(replace(l, '<ref', ''))) // 4) as bigint) n_refs
from (select fetch_id, unnest(string_split(wikitext, chr(10))) l from (select distinct fetch_id, wikitext from raw_pages where wikitext is not null)) group by 1"""
)
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    found = extracted(pages(spark, d), "fetch_id", "wikitext", "sections")
    refs = pages(spark, d).select("fetch_id", F.regexp_count("wikitext", F.lit("<ref")).cast("bigint").alias("n_refs"))
    return found.select("fetch_id", F.size("found").cast("bigint").alias("n_sections")).join(refs, "fetch_id")


# --- written and read back ----------------------------------------------------------------------------------------------
@REGISTRY.query(f"select pageid, title, cast(coalesce(year, 0) as varchar) as year, language from {TITLES}")
def infobox_round_trip(spark: SparkSession, d: str) -> DataFrame:
    t = titles(spark, d)
    text = F.concat(F.lit("{{Short description|x}}\n{{Infobox film\n| name = [[A|"), "title", F.lit("]]" + NOISE + "\n| year="), F.coalesce("year", F.lit(0)).cast("string"), F.lit("\n| language = {{nowrap|"), "language", F.lit("}}\n| year2 = {{film date|2020|1|2}}\n}}\nText"))
    rows = exploded(t.select("pageid", text.alias("text")), "pageid", "text", "infobox").select("pageid", "name", "value")
    clean = F.regexp_replace(F.regexp_replace("value", r"(?s)<ref.*?</ref>|<!--.*?-->", ""), r"\[\[A\||\]\]|\{\{nowrap\||\}\}$", "")
    wide = rows.groupBy("pageid").pivot("name", ["name", "year", "language"]).agg(F.first(clean))
    return wide.select("pageid", F.col("name").alias("title"), "year", "language")


def cast_read(p: DataFrame) -> DataFrame:
    """Cast entries written as a page's bullets, in order of entry_id, and read back; those without a name or link have none."""
    p = p.filter("coalesce(nullif(trim(name), ''), nullif(trim(wikititle), '')) is not null")
    role = F.when(F.coalesce("role", F.lit("")) != "", F.concat(F.lit(" as "), "role")).otherwise("")
    line = F.concat(F.lit("* "), F.when(F.col("wikititle").isNull(), F.col("name")).otherwise(F.concat(F.lit("[["), "wikititle", F.lit("|"), F.coalesce("name", F.lit("")), F.lit("]]"))), role, F.when(F.col("entry_id") % 3 == 0, NOISE).otherwise(""))
    text = written(p.withColumn("pos", F.col("entry_id")), "pageid", line, "== Plot ==\n* no cast\n== Cast ==\nIntro\n", "\n== Music ==\n* none")
    return exploded(text, "pageid", "text", "cast").select("pageid", "pos", "name", F.coalesce("wikititle", F.lit("")).alias("wikititle"), "role")


@REGISTRY.query()
def cast_round_trip_all(spark: SparkSession, d: str) -> DataFrame:
    return cast_read(people(spark, d).filter("origin = 'wiki'"))


LINES = "(select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) pos, count(*) over (partition by l_orderkey) n, year(o_orderdate) y, p_name, p_partkey, l_returnflag from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey)"


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders with position, number, year and part."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    placed = lines.withColumn("pos", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).withColumn("n", F.count("*").over(w))
    orders, parts = table(spark, d, "orders"), table(spark, d, "part")
    return placed.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("y")), "l_orderkey").join(parts.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")


def order_texts(spark: SparkSession, d: str, line: Callable[[Column, Column], Column], head: str, tail: str) -> DataFrame:
    """(l_orderkey, lines, text): the lines of each order that has its order and parts, sorted, and as one page.

    ``line`` writes a line of its fields and its start with the year cell. Lines move twice, to their parts and to their
    orders; they are placed, counted and written where they are collected.
    """
    orders, parts = table(spark, d, "orders"), table(spark, d, "part")
    fields = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "p_name", "l_returnflag", "y"]
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    lines = lines.join(parts.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("y")), "l_orderkey")
    pages = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("lines"))
    first = F.concat(F.lit('| rowspan="'), F.size("lines").cast("string"), F.lit('" | '), F.get("lines", F.lit(0))["y"].cast("string"), F.lit(" || "))
    own = F.transform("lines", lambda x, i: F.concat(F.lit("|-\n"), line(x, F.when(i == 0, first).otherwise("| "))))
    return pages.select("l_orderkey", "lines", F.concat(F.lit(head), F.array_join(own, "\n"), F.lit(tail)).alias("text"))


def _spanned(first: Column) -> Column:
    """The year cell of a row: on the first row, spanning all."""
    return F.when(F.col("pos") == 1, F.concat(F.lit('| rowspan="'), F.col("n").cast("string"), F.lit('" | '), first, F.lit(" || "))).otherwise("| ")


@REGISTRY.query(f"select l_orderkey, cast(pos - 1 as int) as row, cast(y as varchar) y, p_name, l_returnflag from {LINES}")
def table_grid_round_trip(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d)
    line = F.concat(F.lit("|-\n"), _spanned(F.col("y").cast("string")), F.lit("''[[Part "), F.col("l_partkey").cast("string"), F.lit("|"), "p_name", F.lit("]]''"), F.when(F.col("pos") % 3 == 0, NOISE).otherwise(""), F.lit(" || "), "l_returnflag")
    text = written(lines, "l_orderkey", line, '{| class="wikitable"\n|+ Caption\n! Year !! Title !! Role\n', "\n|}")
    cells = exploded(text, "l_orderkey", "text", "grid")
    wide = cells.groupBy("l_orderkey", "row").pivot("col", [0, 1, 2]).agg(F.first("value"))
    return wide.select("l_orderkey", "row", F.col("0").alias("y"), F.col("1").alias("p_name"), F.col("2").alias("l_returnflag"))


@REGISTRY.query(f"select l_orderkey, pos, cast(y as varchar) as year, p_name title, 'Part ' || p_partkey wikititle, l_returnflag as role from (select *, row_number() over (partition by l_orderkey, p_partkey order by pos) r from {LINES}) where r = 1")
def filmography_round_trip(spark: SparkSession, d: str) -> DataFrame:
    line = lambda x, start: F.concat(start, F.lit("''[[Part "), x["l_partkey"].cast("string"), F.lit("|"), x["p_name"], F.lit("]]'' || "), x["l_returnflag"])
    pages = order_texts(spark, d, line, '== Career ==\nprose\n== Filmography ==\n=== Film ===\n{|\n! Year !! Title !! Role\n', "\n|}\n== Legacy ==\n* [[Other]]")
    # A work stands where its part does first in the order, so the parts go with the page.
    pages = pages.select(F.struct("l_orderkey", F.transform("lines", lambda x: x["l_partkey"]).alias("parts")).alias("key"), "text")
    found = exploded(pages, "key", "text", "filmography")
    pos = F.array_position("key.parts", F.regexp_extract("wikititle", r"^Part (-?\d+)$", 1).try_cast("bigint"))
    return found.select("key.l_orderkey", pos.alias("pos"), "year", "title", "wikititle", "role").filter("pos > 0")


TRACKS = "(select distinct song_id, pageid, number, title, length from song_rows where listing = 'track')"


@REGISTRY.query(f"select pageid, row_number() over (partition by pageid order by song_id) pos, title, coalesce(length, '') as length from {TRACKS}")
def tracks_round_trip(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, d, "song_rows").filter("listing = 'track'").select("song_id", "pageid", "number", "title", "length").distinct()
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("pageid").orderBy("song_id")))
    n = F.col("pos").cast("string")
    line = F.concat(F.lit("| title"), n, F.lit(" = "), "title", F.lit(NOISE), F.lit("\n| length"), n, F.lit(" = "), F.coalesce("length", F.lit("")))
    text = written(rows, "pageid", line, "== Soundtrack ==\nComposed by X.\n{{Track listing\n| headline = Songs\n", "\n}}")
    return exploded(text, "pageid", "text", "tracks").select("pageid", "pos", "title", F.coalesce("length", F.lit("")).alias("length"))


@REGISTRY.query(f"select distinct on (l_orderkey, p_name, l_returnflag) l_orderkey, cast(y as varchar) as year, p_name category, case when l_returnflag = 'R' then 'nominated' else 'won' end as result from {LINES} order by l_orderkey, p_name, l_returnflag, pos")
def awards_round_trip(spark: SparkSession, d: str) -> DataFrame:
    mark = lambda x: F.when(x["l_returnflag"] == "R", "{{nom}}").otherwise("{{won}}")
    line = lambda x, start: F.concat(start, F.lit("[[Grand Prize]] || "), x["p_name"], F.lit(" || ''Work "), x["l_returnflag"], F.lit("'' || "), mark(x))
    pages = order_texts(spark, d, line, "== Awards and nominations ==\n{| class=\"wikitable\"\n! Year !! Award !! Category !! Film !! Result\n", "\n|}")
    return exploded(pages, "l_orderkey", "text", "awards").select("l_orderkey", "year", "category", "result")


def episodes_read(orders: DataFrame) -> DataFrame:
    """Orders written as a customer's episodes, by year, and read back."""
    from pyspark.sql import Window

    orders = orders.withColumn("pos", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    line = F.concat(F.lit("== Season "), F.year("o_orderdate").cast("string"), F.lit(" ==\n{{Episode list/sub\n| EpisodeNumber = "), F.col("pos").cast("string"), F.lit("\n| Title = "), "o_orderpriority", F.lit("\n| ShortSummary = key {{nowrap|"), F.col("o_orderkey").cast("string"), F.lit("}}\n}}"))
    text = written(orders, "o_custkey", line, "Lead\n")
    found = exploded(text, "o_custkey", "text", "episodes")
    return found.select(F.regexp_extract("summary", r"(\d+)", 1).cast("bigint").alias("o_orderkey"), F.col("number").cast("bigint").alias("number"), "season", "title")


@REGISTRY.query("select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) number, cast(year(o_orderdate) as int) season, o_orderpriority title from orders")
def episodes_round_trip_all(spark: SparkSession, d: str) -> DataFrame:
    return episodes_read(table(spark, d, "orders"))


@REGISTRY.query("select p_partkey, 'https://reel.example/' || p_partkey url, p_name label, p_brand source from part")
def references_round_trip(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit('A<ref name="x"/> b<ref name="X">{{cite web|title='), "p_name", F.lit("|url=https://reel.example/"), key, F.lit("|website="), "p_brand", F.lit('}}</ref> c<ref name=x />.'))
    return exploded(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text", "references").select("p_partkey", "url", "label", "source")


@REGISTRY.query("select n_nationkey, row_number() over (partition by n_nationkey order by x.pos) pos, value from nation, lateral (values (1, n_name), (2, 'b ' || n_name), (3, 'c, d')) x(pos, value)")
def list_field_round_trip(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("{{Plainlist|\n* [["), "n_name", F.lit("]]" + NOISE + "\n* ''b'' "), "n_name", F.lit("\n* c, d\n*\n}}"))
    return exploded(table(spark, d, "nation").select("n_nationkey", text.alias("text")), "n_nationkey", "text", "list_items")


@REGISTRY.query("select p_partkey, p_name || ' & ' || p_brand || ' < 5' as found from part")
def plain_round_trip(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("'''"), "p_name", F.lit("''' &amp; [[X#y|"), "p_brand", F.lit("]]" + NOISE + " < 5{{refn|a {{b|c}} d}}"))
    return extracted(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text", "plain")
