"""Scalar functions of the catalogue as Column expressions; all run in the JVM but ``fold_marks``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words in brackets at the end of a page title that only tell works apart.
DISAMBIGUATION = r"(?i)\s*\([^()]*(?:film|series|movie|web series|TV series|talk show|game show|reality show|season|franchise|soundtrack)[^()]*\)\s*$"
# Namespaces whose pages are no articles.
NAMESPACES = (
    "draft talk,user talk,wikipedia talk,file talk,template talk,category talk,portal talk,help talk,mediawiki talk,module talk,book talk,gadget talk,wikiproject talk,"
    "draft,user,wikipedia,file,image,media,template,category,portal,help,mediawiki,module,book,gadget,wikiproject,topic,talk,special"
).split(",")
# Prefixes of pages that are no persons.
NOT_PERSON_PREFIX = r"(?i)^(?:file|image|media|category|wikipedia|wp|template|portal|help|special|draft|module|user|wikt|wiktionary|commons|list of|index of|table of|timeline of|glossary of|outline of)"
# Codes of languages.
LANGUAGE_ISO = {
    "hindi": "hi", "urdu": "ur", "punjabi": "pa", "bengali": "bn", "marathi": "mr", "gujarati": "gu", "odia": "or", "assamese": "as", "tamil": "ta", "telugu": "te", "kannada": "kn", "malayalam": "ml",
    "tulu": "tcy", "konkani": "kok", "sanskrit": "sa", "maithili": "mai", "santali": "sat", "nepali": "ne", "sindhi": "sd", "dogri": "doi", "bhojpuri": "bho", "rajasthani": "raj", "chhattisgarhi": "hne",
}
# The months in dates of facts and prose.
MONTHS = "january february march april may june july august september october november december".split()
SENTENCE_END = r"""(?<=[.!?])(?<![A-Z]\.)\s+(?=[A-Z"'“(\[])"""


@F.pandas_udf(T.StringType())
def fold_marks(text: pd.Series) -> pd.Series:
    """Text without the combining marks U+0300 to U+036F; Spark has no normalisation of its own."""
    return text.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if not "̀" <= c <= "ͯ"))


def or_else(c: Column, other: Column | str) -> Column:
    """The column, or the other where it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(other) if isinstance(other, str) else other)


def display_title(title: Column) -> Column:
    """A title without a bracketed disambiguator; the title itself if nothing is left."""
    return or_else(F.trim(F.regexp_replace(title, DISAMBIGUATION, "")), title)


def slugify(title: Column, pageid: Column | None = None) -> Column:
    """Lower-case words joined by hyphens; ``p`` and the page id (or ``px``) where no letter is left."""
    text = fold_marks(F.regexp_replace(F.coalesce(title, F.lit("")), DISAMBIGUATION, " "))
    text = F.regexp_replace(F.regexp_replace(text, "['’]", ""), "&", " and ")
    text = F.lower(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    other = F.coalesce(pageid.cast("string"), F.lit("x")) if pageid is not None else F.lit("x")
    return or_else(text, F.concat(F.lit("p"), other))


def wiki_url(title: Column) -> Column:
    """The article's address; characters that URIs leave bare stay bare."""
    path = F.url_encode(F.replace(F.coalesce(title, F.lit("")), F.lit(" "), F.lit("_")))
    for code, sign in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        path = F.replace(path, F.lit(code), F.lit(sign))
    return F.concat(F.lit("https://en.wikipedia.org/wiki/"), path)


def bucket_key(text: Column) -> Column:
    """The first letter A to Z, else #."""
    first = F.upper(F.substring(F.coalesce(text, F.lit("")), 1, 1))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise("#")


def is_mainspace(title: Column) -> Column:
    return F.coalesce((title != "") & ~F.trim(title).rlike("(?i)^(?:" + "|".join(NAMESPACES) + r")\s*:"), F.lit(False))


def is_non_title_name(name: Column) -> Column:
    """Names that head no work: short ones, award shows, seasons and lists of a year."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(n) < 4) | n.rlike(r"(?i)\bawards?( ceremony| function)?$") | n.rlike(r"(?i)\s\(season \d+\)$") | n.rlike(r"(?i)^(list of )?\d{4} in\b")


def is_person_like(title: Column, not_persons: list[str] = ()) -> Column:
    t = F.trim(F.replace(F.coalesce(title, F.lit("")), F.lit("_"), F.lit(" ")))
    bad = t.rlike(NOT_PERSON_PREFIX) | t.rlike(r"^\d") | t.rlike(r":(?!\s)") | (t == "")
    return ~(bad | F.lower(t).isin([x.lower() for x in not_persons])) if not_persons else ~bad


def is_list_page(title: Column) -> Column:
    return title.rlike(r"^(List of|Table of|Index of|Category:|Template:|\d{4} in)")


def archive_tier(year: Column, catalogue_year: int) -> Column:
    """True for every year but the catalogue's, the unknown one too."""
    return ~year.eqNullSafe(F.lit(catalogue_year))


def truncated(text: Column, most: int) -> Column:
    """Cut at ``most``, back to the last sentence if that is past half; null stays null."""
    cut = F.substring(text, 1, most)
    back = F.greatest(*[F.when(F.instr(cut, s) > 0, most + 1 - F.instr(F.reverse(cut.substr(1, most)), s[::-1]) - (len(s) - 1) + (F.length(cut) - most)).otherwise(0) for s in (". ", "!", "?")])
    ended = F.when(back > most * 0.5 + 1, F.substring(cut, F.lit(1), back)).otherwise(F.rtrim(cut))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(ended, F.lit(" […]")))


def clean_thumb(url: Column) -> Column:
    return F.split(url, r"\?")[0]


def image_filename(value: Column) -> Column:
    """The first image file named outside comments; null if none."""
    bare = F.regexp_replace(value, r"(?s)<!--.*?-->", "")
    return F.nullif(F.trim(F.regexp_extract(bare, r"(?i)([^\[\]|:]+\.(?:jpe?g|png|svg|gif|webp))", 1)), F.lit(""))


def tagline_of(text: Column) -> Column:
    """The first sentence if it has 40 to 200 characters."""
    first = F.split(F.trim(text), SENTENCE_END, 2)[0]
    return F.when(F.length(first).between(40, 200), first)


def start_date(value: Column) -> Column:
    """A start or film date template as YYYY, YYYY-MM or YYYY-MM-DD; null outside 1900 to 2100 or if not a date."""
    inner = F.regexp_extract(value, r"(?i)\{\{\s*(?:Start date|Film date)\s*\|([^{}]*)\}\}", 1)
    numbers = F.transform(F.filter(F.split(inner, r"\|"), lambda p: F.trim(p).rlike(r"^\d{1,4}$")), lambda p: F.trim(p).cast("int"))
    y, m, d = F.get(numbers, 0), F.get(numbers, 1), F.get(numbers, 2)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    fine = F.when(m.isNull(), y.cast("string")).when(~m.between(1, 12), None).when(d.isNull(), F.concat_ws("-", y, two(m))).when(d.between(1, 31), F.concat_ws("-", y, two(m), two(d)))
    return F.when(y.between(1900, 2100), fine)


def runtime_text(raw: Column) -> Column:
    """Minutes as hours and minutes; ranges keep both ends, other text stays."""
    a, b = (F.try_to_number(F.nullif(F.regexp_extract(raw, r"(\d{1,3})\s*[–—-]\s*(\d{1,3})", i), F.lit("")), F.lit("999")).cast("int") for i in (1, 2))
    one = F.try_to_number(F.nullif(F.regexp_extract(raw, r"(\d{1,3})", 1), F.lit("")), F.lit("999")).cast("int")
    hours = lambda n: F.concat(F.floor(n / 60).cast("string"), F.lit("h "), (n % 60).cast("string"), F.lit("m"))
    ranged = F.when(a >= 60, F.concat(hours(a), F.lit(" – "), hours(b))).otherwise(F.concat(a.cast("string"), F.lit("–"), b.cast("string"), F.lit(" min")))
    single = F.when(one < 60, F.concat(one.cast("string"), F.lit(" min"))).when(one % 60 == 0, F.concat(F.floor(one / 60).cast("string"), F.lit("h"))).otherwise(hours(one))
    return F.when(F.nullif(raw, F.lit("")).isNull(), None).when(a.isNotNull(), ranged).when(one.isNotNull(), single).otherwise(raw)


def sentence_chunks(paragraph: Column, most: int = 3) -> Column:
    """A paragraph's sentences in chunks of ``most``; initials end no sentence."""
    sentences = F.split(paragraph, SENTENCE_END)
    starts = F.sequence(F.lit(0), F.greatest(F.size(sentences) - 1, F.lit(0)), F.lit(most))
    chunks = F.transform(starts, lambda i: F.array_join(F.slice(sentences, i + 1, F.lit(most)), " "))
    return F.when(F.coalesce(F.trim(paragraph), F.lit("")) == "", F.array().cast("array<string>")).when(F.size(sentences) <= most, F.array(paragraph)).otherwise(chunks)


def lead_sentence(paragraph: Column) -> Column:
    """(lead, rest) of a paragraph."""
    parts = F.split(F.trim(F.coalesce(paragraph, F.lit(""))), SENTENCE_END, 2)
    return F.struct(parts[0].alias("lead"), F.trim(F.coalesce(F.get(parts, 1), F.lit(""))).alias("rest"))


def fact_date(value: Column) -> Column:
    """The first "5 March 1990" in a fact as a date; null if there is none."""
    day, name, year = (F.regexp_extract(value, r"(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})", i) for i in (1, 2, 3))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name))
    first = F.try_to_date(F.concat_ws("-", F.nullif(year, F.lit("")), F.lpad(month.cast("string"), 2, "0"), F.lit("01")))
    # Days past a month's end run on into the next.
    return F.when(month > 0, F.date_add(first, F.try_to_number(F.nullif(day, F.lit("")), F.lit("99")).cast("int") - 1))


def age_of(born: Column, died: Column, today: Column) -> Column:
    """Full years at death or today; null outside 0 to 129."""
    end = F.coalesce(died, today)
    early = (F.month(end) < F.month(born)) | ((F.month(end) == F.month(born)) & (F.dayofmonth(end) < F.dayofmonth(born)))
    age = F.year(end) - F.year(born) - early.cast("int")
    return F.when(age.between(0, 129), age)


def timeline_dates(text: Column, most: int = 6) -> Column:
    """Distinct dates of a text in order of first mention, at most ``most``; case doesn't tell dates apart."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:\d{1,2}\s+)?(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b"), F.lit(0))
    neat = F.transform(found, lambda d: F.regexp_replace(d, r"\s+", " "))
    first = F.filter(neat, lambda d, i: F.array_position(F.transform(neat, lambda x: F.lower(x)), F.lower(d)) == i + 1)
    return F.slice(first, 1, most)


def initials(name: Column) -> Column:
    """The first letters of the first two words."""
    words = F.slice(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""), 1, 2)
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def language_iso(language: Column) -> Column:
    first = F.lower(F.trim(F.split(language, "[,/]")[0]))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGE_ISO.items() for x in pair]), first)


def language_bonus(original: Column, language: Column) -> Column:
    iso = language_iso(language)
    return F.when(F.nullif(original, F.lit("")).isNull() | iso.isNull(), 0).when(original == iso, 3).otherwise(-3)


def plain_name(name: Column) -> Column:
    """A name's letters a to z only."""
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def escaped_html(text: Column) -> Column:
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def doc_url(doc_id: Column) -> Column:
    """The page of a search document ``kind:slug``; / for an unknown kind."""
    kind, slug = F.split(doc_id, ":", 2)[0], F.get(F.split(doc_id, ":", 2), 1)
    path = F.when(kind == "movie", "/movies/").when(kind == "series", "/series/").when(kind == "person", "/people/")
    return F.coalesce(F.concat(path, slug, F.lit("/")), F.lit("/"))


def language_slug(language: Column) -> Column:
    return F.regexp_replace(F.lower(language), "[^a-z0-9]+", "-")


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(500) * F.pow(F.lit(2), attempt), F.lit(30000)).cast("bigint")


def role_label(field: Column, known: dict[str, str]) -> Column:
    """A crew field as a label: a fixed one, else its words with capitals."""
    key = F.lower(F.trim(field))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), key), F.initcap(F.replace(key, F.lit("_"), F.lit(" "))))


def cache_key(text: Column, digits: int) -> Column:
    return F.substring(F.sha1(text), 1, digits)


def publisher_chip(url: Column, source: Column) -> Column:
    """The named source, else the host of the address without www."""
    return or_else(F.trim(source), F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), "^www\\.", ""))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def needs_fresh_search(found: Column, year: Column, year_now: int) -> Column:
    """Whether a title without a found id is of this year or later, when names still change."""
    return found.isNull() & (F.coalesce(year, F.lit(0)) >= year_now)


# Words of categories that only serve the upkeep of pages.
UPKEEP = ["articles", "templates", "stub", "navigation", "tracking", "maintenance", "pages needing", "cleanup", "categories", "disambiguation"]


def is_wanted_category(title: Column) -> Column:
    return ~title.rlike("(?i)(" + "|".join(UPKEEP) + ")")


def without(items: Column, others: Column) -> Column:
    """The items that are none of the others, whatever their case."""
    low = F.transform(others, F.lower)
    return F.filter(items, lambda x: ~F.array_contains(low, F.lower(x)))
