"""Extractors on written pages of hard shapes; the SQL is the table of the rows that must come out."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cinegrain.markup.udfs import exploded
from cinegrain.operators.delta import global_rank
from cinegrain.operators.records import merge_subpages
from cinegrain.plans.registry import Registry

REGISTRY = Registry()

AWARDS = """{{Infobox person}}
A lead with the [[Lead Film Award]].
== Career ==
=== Film awards ===
{| class="wikitable"
! Year !! Award !! Category !! Film !! Result !! Nominees
|-
| rowspan="3" | [[58th Reel State Film Awards|2001]] || rowspan="2" | [[Reel Prize]] || Best Actor || ''[[Alpha (film)|Alpha]]'' || {{won}} || Ana B
|-
| Best Song || || {{nom}} ||
|-
| Small Medal
* Best Voice
* Best Dance || || ''Beta'' || Nominated ||
|}
In prose the [[Reel Prize]] and the [[Kite Festival]] were named; he got a [[Lamp Award for Best Light]].
=== Lantern Film Awards ===
{| class="wikitable"
! Year !! Nominated work !! Category
|-
| 2005 || Gamma || Best Score
|-
| 2006 || || Best Edit (nominated)
|}
== Honours and recognition ==
* 2010 – Special Jury Award, [[Harbour Festival|Harbour Festival]] for ''[[Delta]]''
* [[Ferry Prize]]
** 2011: Best Story
** Best Frame (Nominated)
; ''[[Epsilon]]''
* Monsoon State Award for Best Film, 2012
'''[[Orchard Awards 1|Orchard Awards]]'''
* Best Costume (1996)
* she was given many things
1999 — Bridge Medal
== Reception ==
* 2020 – Not an Award
"""
AWARDS_ROWS = [
    ("2001", "Reel Prize", "Reel Prize", "Best Actor", "Alpha", "Alpha (film)", "Ana B", "won"),
    ("2001", "Reel Prize", "Reel Prize", "Best Song", "Alpha", "Alpha (film)", None, "nominated"),
    ("2001", "Small Medal", None, None, "Beta", None, None, "nominated"),
    ("2001", "Best Voice", None, None, "Beta", None, None, "nominated"),
    ("2001", "Best Dance", None, None, "Beta", None, None, "nominated"),
    (None, "Kite Festival", "Kite Festival", None, None, None, None, ""),
    ("2005", "Lantern Film Awards", None, "Best Score", "Gamma", None, None, "won"),
    ("2006", "Lantern Film Awards", None, "Best Edit (nominated)", "Gamma", None, None, "nominated"),
    ("2010", "Harbour Festival", "Harbour Festival", "Special Jury Award", "Delta", "Delta", None, "won"),
    ("2011", "Ferry Prize", "Ferry Prize", "Best Story", None, None, None, "won"),
    (None, "Ferry Prize", "Ferry Prize", "Best Frame", None, None, None, "nominated"),
    ("2012", "Monsoon State Award for Best Film", None, None, "Epsilon", "Epsilon", None, "won"),
    ("1996", "Orchard Awards", "Orchard Awards 1", "Best Costume", "Epsilon", "Epsilon", None, "won"),
    ("1999", "Bridge Medal", None, None, "Epsilon", "Epsilon", None, "won"),
]

FILMOGRAPHY = """== Filmography ==
=== Film ===
{| class="wikitable"
! Year !! Film !! Role !! Language !! Director
|-
| rowspan="2" | 2001 || [[Alpha (film)|Alpha]] || Ravi || Hindi || C D
|-
| Beta || TBA || Tamil || E F
|-
| 2003 || {{Pending film|Gamma}} || Filming
|-
| TBA || [[Netflix]] || x || y || z
|}
=== Television ===
{| class="wikitable"
! Year !! Show !! Played as !! Channel
|-
| 2005–06 || ''[[Delta]]'' || Self ( ) || Net One
|}
* [[Epsilon (series)|Epsilon]] on [[YouTube]] in [[Hindi cinema]]
=== Reception ===
[[Zeta]]
== As a producer ==
* [[Alpha (film)|Alpha]]
== Other ==
* [[Eta]]
"""
FILMOGRAPHY_ROWS = [
    ("Film", "film", "2001", "Alpha", "Alpha (film)", "Ravi", "Hindi; C D"),
    ("Film", "film", "2001", "Beta", None, None, "Tamil; E F"),
    ("Film", "film", "2003", "Gamma", None, "Filming", None),
    ("Television", "television", "2005–06", "Delta", "Delta", "Self", "Net One"),
    ("Television", "television", None, "Epsilon", "Epsilon (series)", None, None),
    ("As a producer", "film", None, "Alpha", "Alpha (film)", None, None),
]

EXTERNAL = """{{IMDb name|id=0001234}} {{Official website|https://own.example/}}
{{Twitter|@ana}} {{Instagram|user=ana}} {{Facebook|ana}} {{YouTube|https://tube.example/c}} {{Netflix title|81}} {{BH person|77}}
{{Rotten Tomatoes|m one}} {{Wikiquote|Ana B}} {{URL|https://www.site.example/x|[[Own|Label]]}} {{URL|https://www.plain.example/x}}
* [https://own.example/ own site] * [https://list.example/a A ''page''] at List
* https://bare.example
* [//short.example]
"""
EXTERNAL_ROWS = [
    ("Netflix", "https://www.netflix.com/title/81"), ("Instagram", "https://www.instagram.com/ana"), ("X (Twitter)", "https://twitter.com/ana"), ("Facebook", "https://www.facebook.com/ana"), ("YouTube", "https://tube.example/c"),
    ("Rotten Tomatoes", "https://www.rottentomatoes.com/m/m one"), ("Bollywood Hungama", "https://www.bollywoodhungama.com/person/77/"), ("Wikiquote", "https://en.wikiquote.org/wiki/Ana_B"), ("Label", "https://www.site.example/x"),
    ("plain.example", "https://www.plain.example/x"), ("//short.example", "//short.example"),
]

ARTICLE = """Lead.
== plot ==
A plot that is long enough to be told as a section of its own, surely.
== production ==
* It was '''made''' in the old [[river|river town]] over many months of rain.
:It ended late.
== Release ==
Short.
== Season 2 ==
A season that is long enough to be told as a section of its own, surely.
== External links ==
Links that are long enough to be told as a section of their own, surely.
"""
ARTICLE_ROWS = [("Production", "It was made in the old river town over many months of rain. :It ended late.")]

FACTS = """{{Infobox person
| height = 1.7 m
| birth_date = {{Birth date and age|1984|5|31|df=y}}
| spouses = {{ubl|[[C D]]|E F}}
| image = x.jpg
| known_for =
}}"""
FACTS_ROWS = [("Born", "31 May 1984"), ("Spouse(s)", "C D, E F"), ("Height", "1.7 m")]

PEOPLE = """{{Infobox film
| director = [[Ana B]]
| music = [[Cy D]], [[T-Series]]
| screenplay = [[Ana B]]
| sound_mix = [[Eve F]]
| starring = [[2026 in film]]
}}
== Cast ==
* [[Gil H]] as Ravi
** the elder
* [[Ana B]]
"""
PEOPLE_ROWS = [("Ana B", "Ana B", "Director"), ("Cy D", "Cy D", "Music"), ("Gil H", "Gil H", "Cast")]

CASES = {
    "case_awards": (AWARDS, "awards", ["year", "award", "awardwikititle", "category", "work", "workwikititle", "recipients", "result"], AWARDS_ROWS),
    "case_filmography": (FILMOGRAPHY, "filmography", ["heading", "medium", "year", "title", "wikititle", "role", "notes"], FILMOGRAPHY_ROWS),
    "case_external_links": (EXTERNAL, "external", ["label", "url"], EXTERNAL_ROWS),
    "case_article_sections": (ARTICLE, "article", ["title", "text"], ARTICLE_ROWS),
    "case_person_facts": (FACTS, "facts", ["label", "value"], FACTS_ROWS),
    "case_person_links": (PEOPLE, "people", ["target", "label", "role"], PEOPLE_ROWS),
}


def literal(value) -> str:
    return "null" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def expected(columns: list[str], rows: list[tuple]) -> str:
    """The rows as SQL, with their position."""
    values = ", ".join("(" + ", ".join(map(literal, (i, *r))) + ")" for i, r in enumerate(rows, 1))
    return f"select * from (values {values}) v(pos, {', '.join(columns)})"


def _case(text: str, family: str, columns: list[str]):
    def run(spark: SparkSession, _: str):
        page = spark.createDataFrame([(1, text)], "page int, text string")
        return exploded(page, "page", "text", family).select(F.col("pos").cast("int").alias("pos"), *columns)

    return run


for _name, (_text, _family, _columns, _rows) in CASES.items():
    REGISTRY.add(_name, _case(_text, _family, _columns), expected(_columns, _rows))


def _awards(spark: SparkSession):
    return exploded(spark.createDataFrame([(1, AWARDS)], "page int, text string"), "page", "text", "awards")


AWARDS_SQL = expected(CASES["case_awards"][2], AWARDS_ROWS)


@REGISTRY.query(f"select count(*) filter (result = 'won') wins, count(*) filter (result = 'nominated') nominations, count(*) n_rows from ({AWARDS_SQL})")
def case_award_totals(spark: SparkSession, _: str):
    """Wins and nominations; a row without result is neither."""
    return _awards(spark).agg(F.count_if(F.col("result") == "won").alias("wins"), F.count_if(F.col("result") == "nominated").alias("nominations"), F.count("*").alias("n_rows"))


@REGISTRY.query(f"select row_number() over (order by coalesce(try_cast(left(year, 4) as int), -1) desc, award, pos) place, award, coalesce(category, '') category from ({AWARDS_SQL})")
def case_award_order(spark: SparkSession, _: str):
    """Awards as a page lists them: the latest year first, those without year last, then by name."""
    year = F.coalesce(F.left("year", F.lit(4)).try_cast("int"), F.lit(-1))
    ranked = global_rank(_awards(spark), [F.desc(year), F.col("award"), F.col("pos")])
    return ranked.select((F.col("rank") + 1).alias("place"), "award", F.coalesce("category", F.lit("")).alias("category"))


SUBPAGE = """== Film ==
* [[Alpha (film)|Alpha]]
* [[Theta]]
== Web series ==
* [[Iota]]
"""
MERGED_ROWS = [(1, "Film", "Alpha"), (1, "Film", "Theta"), (1, "Film", "Beta"), (1, "Film", "Gamma"), (1, "Web series", "Iota"), (1, "Television", "Delta"), (1, "Television", "Epsilon"), (1, "As a producer", "Alpha"), (2, "Film", "Theta")]
MERGED_SQL = "select * from (values " + ", ".join(f"({p}, {i}, {literal(h)}, {literal(t)})" for i, (p, h, t) in enumerate(MERGED_ROWS[:-1], 1)) + f", (2, 1, {literal('Film')}, {literal('Theta')})) v(page, pos, heading, title)"


@REGISTRY.query(MERGED_SQL)
def case_merged_filmography(spark: SparkSession, _: str):
    """The works of a subpage first, then the page's own that it lacks, by heading."""
    pages = spark.createDataFrame([(1, "Ana", "{{Main|Ana filmography}}\n" + FILMOGRAPHY), (2, "Cy", "== Films ==\n"), (3, "Eve", None)], "page int, title string, text string")
    others = spark.createDataFrame([("Ana filmography", SUBPAGE), ("None such", "== Film ==\n* [[Kappa]]")], "title string, text string")
    pages = pages.unionByName(spark.createDataFrame([(2, "Cy", "{{Main list|Cy filmography}}\n== Film ==\n* [[Theta]]")], "page int, title string, text string")).filter("page <> 2 or text like '{{Main%'")
    return merge_subpages(pages, others, "page", "filmography", ["heading"], F.coalesce("wikititle", "title")).select("page", F.col("place").cast("int").alias("pos"), "heading", "title")
