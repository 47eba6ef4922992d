"""Matching works across two sources without a common key: BM25 over all attributes, mutual nearest, confidence."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegrain.session import discard, written

# ISO codes of the language names the catalogue uses.
LANGUAGE_CODES = {"hindi": "hi", "tamil": "ta", "bengali": "bn", "marathi": "mr", "english": "en", "spanish": "es", "french": "fr", "portuguese": "pt", "german": "de", "telugu": "te", "malayalam": "ml", "kannada": "kn", "punjabi": "pa", "gujarati": "gu"}
# Endings that make a title another part of a story.
_PART = re.compile(r"\s+(?:(?:part|chapter|volume|vol)\s+)?(\d{1,2}|ii|iii|iv|v|vi|vii|viii|ix|x|two|thre|four|five|six|seven|eight|nine|ten|returns|again|reloaded|forever)\s*$")
_NUMBERS = {"ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10", "two": "2", "thre": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
# Weights of the kinds of terms beside their rarity; those of a date are y, m and x.
WEIGHTS = {"t": 1.0, "w": 1.0, "d": 0.12, "a": 1.0, "p": 1.0, "i": 0.5, "n": 0.3, "y": 0.8, "m": 0.6, "x": 0.8, "l": 0.5}
DATED = "ymx"
K1, B = 1.2, 0.3
RARE = 64  # records that a term may be in to be joined alone
PASSES, PASS_RECORDS = 16, 1000  # parts that the join is done in, and records of a part at least; the more parts, the less disk at a time
SIDE_PASSES = 4  # parts that the pairs meet the fields of their records in
VARIED = 5  # letters of a title that has variants


def folded(text: str | None) -> str:
    """Lower case without marks; common respellings of one sound (oo, ee, au, ae, doubled letters) become one."""
    text = unicodedata.normalize("NFKD", text or "").lower()
    text = "".join(c for c in text if not unicodedata.combining(c))
    for a, b in (("oo", "u"), ("ee", "i"), ("au", "o"), ("ae", "e")):
        text = text.replace(a, b)
    return re.sub(r"([^\W\d_])\1+", r"\1", text)


def part_of(title: str) -> tuple[str, str]:
    """A folded title without the ending that names another part, and that part ("1" for none)."""
    m = _PART.search(title)
    if not m or not title[: m.start()].strip():
        return title.strip(), "1"
    return title[: m.start()].strip(), _NUMBERS.get(m[1], m[1])


def person_keys(name: str) -> tuple[str, str]:
    """A person's name with its parts in order, and the form with only initials before the last part."""
    if "," in name:
        last, _, first = name.partition(",")
        name = f"{first} {last}"
    words = re.findall(r"\w+", folded(name))
    if not words:
        return "", ""
    return " ".join(words), " ".join([w[0] for w in words[:-1]] + words[-1:])


def terms_of(title: str, year, date: str, people: list[str], languages: list[str]) -> dict:
    """The terms (kind:text) of one record, and the folded fields for the check after the search."""
    title = re.sub(r"^(.*\S)\s*,\s*(the|an?)\s*$", r"\2 \1", re.sub(r"\s+", " ", folded(title)))
    base, part = part_of(title)
    words = [w for w in re.findall(r"\w+", base) if w not in ("and", "the", "a", "an")] or re.findall(r"\w+", base)
    whole = "".join(words)
    terms = {f"t:{whole}"} | {f"w:{w}" for w in words}
    if len(whole) >= VARIED:  # two titles but for one slip share one of these at least
        terms |= {f"d:{whole[:i]}{whole[i + 1 :]}" for i in range(len(whole))} | {f"d:{whole}"}
    terms.add(f"a:{part}")
    full, short = zip(*(person_keys(p) for p in people)) if people else ((), ())
    terms |= {f"p:{p}" for p in full if p} | {f"i:{p}" for p in short if p} | {f"n:{w}" for p in full for w in p.split() if len(w) > 1}
    date = date or ""
    if year:
        terms.add(f"y:{year}")
    if len(date) >= 7:
        terms.add(f"m:{date[:7]}")
    if len(date) == 10:
        terms.add(f"x:{date}")
    terms |= {f"l:{x}" for x in languages}
    return {"part": part, "words": words, "year": year, "date": date, "people": [p for p in full if p], "initials": [p for p in short if p], "terms": sorted(t for t in terms if len(t) > 2)}


_SCHEMA = "id long, block string, part string, words array<string>, year int, date string, people array<string>, initials array<string>, terms array<string>"


def _year(*values) -> int | None:
    for v in values:
        m = re.search(r"(?<!\d)(1[89]\d\d|20\d\d|21\d\d)(?!\d)", str(v)) if v is not None and v == v else None
        if m:
            return int(m[1])
    return None


def _plain(raw: str) -> list[str]:
    """Names in a raw parameter: what is linked, else what lines and list signs part."""
    raw = re.sub(r"<!--.*?-->|<ref\b[^>]*/>|<ref\b.*?</ref>", "", raw, flags=re.DOTALL)
    raw = re.sub(r"\{\{\s*(?:ubl|hlist|plainlist|flatlist|unbulleted list)\s*\|", "\n", raw, flags=re.IGNORECASE).replace("}}", "\n")
    raw = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", raw)
    parts = re.split(r"<br[^>]*>|\n|\||;|/|·|•|,|&|\*", raw, flags=re.IGNORECASE)
    return [p.strip(" \"'") for p in parts if re.search(r"\w", p)]


def title_terms(titles: DataFrame) -> DataFrame:
    """Records of the title table, one per pageid: of rows that differ the greatest."""

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                params = dict(r.params) if r.params is not None else {}
                people = [p for p in (r.directedby if r.directedby is not None else []) if p]
                people += [p for p in _plain(params.get("director") or "") if p not in people]
                languages = [LANGUAGE_CODES.get(x.strip().lower(), x.strip().lower()) for x in re.split(r"[,/]", r.language or "") if x.strip()]
                date = r.releasedate or ""
                if not date and (m := re.search(r"\|\s*(\d{4})\s*\|\s*(\d{1,2})\s*\|\s*(\d{1,2})", params.get("released") or "")):
                    date = f"{m[1]}-{int(m[2]):02}-{int(m[3]):02}"
                found = terms_of(r.title or re.sub(r"\s*\([^()]*\)\s*$", "", r.wikititle or ""), _year(date, r.year, re.search(r"\(([^()]*)\)\s*$", r.wikititle or "") and re.search(r"\(([^()]*)\)\s*$", r.wikititle)[1]), date, people, languages)
                out.append((r.pageid, r.kind, *[found[k] for k in ("part", "words", "year", "date", "people", "initials", "terms")]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCHEMA.split(", ")]).astype({"year": "Int32"})

    columns = ["kind", "title", "wikititle", "releasedate", "year", "language", "directedby", "params"]
    rows = titles.filter("pageid is not null").select("pageid", *columns, F.array_sort(F.map_entries("params")).alias("sorted"))
    once = rows.groupBy("pageid").agg(F.max_by(F.struct(*columns), F.struct(*[c for c in columns if c != "params"], "sorted")).alias("r")).select("pageid", "r.*")
    return once.mapInPandas(run, _SCHEMA)


def result_terms(results: DataFrame) -> DataFrame:
    """Records of the search results, one per id (of rows that differ the greatest); a film has a title, a series a name."""

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                film = r.title is not None and r.title == r.title and r.title != ""
                date = (r.release_date if film else r.first_air_date) or r.release_date or r.first_air_date or ""
                found = terms_of((r.title if film else r.name) or "", _year(date), date, [r.director] if r.director else [], [r.original_language] if r.original_language else [])
                out.append((r.id, "movie" if film else "series", *[found[k] for k in ("part", "words", "year", "date", "people", "initials", "terms")]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCHEMA.split(", ")]).astype({"year": "Int32"})

    once = results.filter("id is not null").select("id", "title", "name", "release_date", "first_air_date", "original_language", "director")
    once = once.groupBy("id").agg(F.max(F.struct(*once.columns[1:])).alias("r")).select("id", "r.*")
    return once.mapInPandas(run, _SCHEMA)


def _weight(term: Column) -> Column:
    kind = F.substring(term, 1, 1)
    return F.coalesce(*[F.when(kind == k, F.lit(w)) for k, w in WEIGHTS.items()])


def without_variants(records: DataFrame) -> DataFrame:
    """The records less the variants of their titles (d:), which follow from the whole title (t:)."""
    return records.withColumn("terms", F.filter("terms", lambda t: ~t.startswith("d:")))


def _whole() -> Column:
    """The whole title of a record, null without one."""
    whole = F.get(F.filter("terms", lambda t: t.startswith("t:")), F.lit(0))
    return whole.substr(F.lit(3), F.length(whole))


def _variants(whole: Column) -> Column:
    """The variants of a whole title, as ``terms_of`` makes them."""
    without = F.transform(F.sequence(F.lit(1), F.length(whole)), lambda i: F.concat(whole.substr(F.lit(1), i - 1), whole.substr(i + 1, F.length(whole))))
    return F.when(F.length(whole) >= VARIED, F.array_distinct(F.array_append(without, whole))).otherwise(F.array().cast("array<string>"))


def _idf(n_all: int, df: Column) -> Column:
    return F.log(1 + (n_all - df + 0.5) / (df + 0.5))


def title_slips(queries: DataFrame, index: DataFrame, n_all: int) -> DataFrame:
    """(h, own, near) of each whole title of the queries that has variants: what the variants add to its score.

    Records of one whole title share all its variants: ``own`` is the sum of their weights. Records of two titles share
    those variants that both titles have: ``near`` has (h, w, df) of each other title of the index and each variant
    shared. So variants are counted by titles, only those of several titles are kept, and none is ever a posting.
    """
    weight = lambda df: WEIGHTS["d"] * _idf(n_all, df)
    side = lambda df, n: df.select("block", _whole().alias("whole"), F.lit(n).alias("n")).filter(F.length("whole") >= VARIED)
    both = side(index, 1).unionByName(side(queries, 0)).groupBy("block", "whole").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    titles = written(both.select("block", "whole", F.xxhash64("block", F.concat(F.lit("t:"), "whole")).alias("h"), "n", (F.col("least") == 0).alias("asked")), "titles", lean=True)
    variants = F.transform(_variants(F.col("whole")), lambda x: F.xxhash64("block", F.concat(F.lit("d:"), x)))
    by_variant = titles.select("h", (F.col("n") * 2 + F.col("asked").cast("long")).alias("code"), F.explode(variants).alias("x")).repartition("x").groupBy("x").agg(F.collect_list(F.struct("h", (F.shiftright("code", 1)).alias("df"), (F.col("code") % 2 == 1).alias("asked"))).alias("of"))
    by_variant = by_variant.filter(F.size("of") > 1).withColumn("df", F.aggregate("of", F.lit(0).cast("long"), lambda a, x: a + x["df"])).filter("df > 0").withColumn("w", weight(F.col("df")))
    met = by_variant.select("w", "of", F.explode(F.filter("of", lambda x: x["asked"])).alias("at"))
    others = F.transform(F.filter("of", lambda x: (x["df"] > 0) & (x["h"] != F.col("at.h"))), lambda x: F.struct(x["h"].alias("h"), F.col("w").alias("w"), x["df"].alias("df")))
    met = met.select(F.col("at.h").alias("h"), "w", others.alias("near")).groupBy("h").agg(F.count("*").alias("met"), F.sum("w").alias("sum"), F.flatten(F.collect_list("near")).alias("near"))
    alone = F.when(F.col("n") > 0, (F.col("variants") - F.coalesce("met", F.lit(0))) * weight(F.col("n"))).otherwise(0.0)
    slips = written(titles.filter("asked").select("h", "n", F.size(_variants(F.col("whole"))).alias("variants")).join(met, "h", "left").select("h", (alone + F.coalesce("sum", F.lit(0.0))).alias("own"), "near"), "slips", lean=True)
    discard(titles)
    return slips


def nearest_pairs(queries: DataFrame, index: DataFrame, k: int = 4) -> DataFrame:
    """(q, d, score, dated, self, self_dated): the ``k`` best records of each query, and more where some tie.

    BM25 over all terms of the records of one block, by an inverted index, exactly pruned to the best ``k``. The score
    must be ln N at least: that is the evidence that singles out one of N records, and with less a pair is likelier
    chance than not. Terms of a query whose scores together stay below it can't bring a pair over it alone: the most
    frequent ones, which may be in a third of all rows, are set aside so and never joined (MaxScore). Of the others,
    those in RARE records at most are joined with the index. The rest are frequent too, and a pair that no rare term
    finds has two of the terms not joined, of which the scarcer one and all that are more frequent reach the least
    score, and still do with the second and what is more frequent than that; so they are joined by such twos, with an
    index of the twos of frequent terms of each record. Variants of titles count with the whole titles
    (``title_slips``).

    Both sides of the join have the hashes of all their terms, so a pair is scored in full where it is found, and kept
    only there where its first key is and only with the least score: pairs without it are never written. Keys are
    joined in PASSES parts, one after another, and each part leaves the ``k`` best of a query and no shuffle files, so
    the disk holds one part at a time. ``dated`` and ``self_dated`` are the parts that terms of dates have in the score
    and in the query's score with itself.
    """
    queries, index = without_variants(queries), without_variants(index).withColumn("n", F.size("terms") + F.size(_variants(F.coalesce(_whole(), F.lit("")))))
    size = index.agg(F.count("*").alias("n_all"), F.avg("n").alias("mean"))
    n_all, mean = size.first()
    if not n_all:
        zero = [F.lit(0.0).alias(c) for c in ("score", "dated", "self", "self_dated")]
        return written(queries.select(F.col("id").alias("q"), F.col("id").alias("d"), *zero).limit(0), "nearest", lean=True)
    least = float(np.log(n_all + 1.0))
    norm = (K1 + 1) / (1 + K1 * (1 - B + B * F.col("n") / mean))
    most = (K1 + 1) / (1 + K1 * (1 - B))
    reach = lambda x: x * most >= least * (1 - 1e-9)
    slips = title_slips(queries, index, n_all)

    own = F.explode("terms").alias("term")
    h, whole = F.xxhash64("block", "term").alias("h"), F.col("term").startswith("t:").alias("whole")
    postings = index.select(F.col("id").alias("d"), "n", "block", own).select("d", "n", h, whole)
    frequency = written(postings.groupBy("h").agg(F.count("*").alias("df")), "frequency", lean=True)
    rare = F.col("whole") | (F.col("df") <= RARE) | reach(_idf(n_all, F.col("df")))

    asked = queries.select(F.col("id").alias("q"), "block", own).select("q", h, whole, _weight(F.col("term")).alias("kind_weight"), F.substring("term", 1, 1).isin(*DATED).alias("dated"))
    asked = asked.join(frequency, "h", "left").join(slips, "h", "left").filter("df is not null or own > 0")
    zero = F.lit(0.0)
    w = F.coalesce(F.col("kind_weight") * _idf(n_all, F.col("df")), zero) + F.coalesce("own", zero)
    term = lambda rare, w, df, h, dated: F.struct(rare.alias("rare"), (w / df).alias("share"), h.alias("h"), w.alias("w"), dated.alias("dated"))
    slipped = F.transform("near", lambda x: term(F.lit(True), x["w"], x["df"], x["h"], F.lit(False)))
    found = F.when(F.col("df").isNotNull(), term(rare, F.col("w"), F.col("df"), F.col("h"), F.col("dated")))
    asked = asked.withColumn("w", w).select("q", "w", F.when(F.col("dated"), F.col("w")).otherwise(0.0).alias("v"), found.alias("found"), slipped.alias("slipped")).repartition("q")
    asked = asked.groupBy("q").agg(F.sum("w").alias("self"), F.sum("v").alias("self_dated"), F.array_sort(F.concat(F.collect_list("found"), F.flatten(F.collect_list("slipped")))).alias("ts"))
    below = F.transform("ts", lambda x, i: F.aggregate(F.slice("ts", 1, i + 1), zero, lambda a, y: a + y["w"]))
    asked = asked.filter(F.col("self") * most >= least).withColumn("below", below)
    # In rising order the terms joined alone are the last ones.
    alone = F.size(F.filter(F.arrays_zip("ts", "below"), lambda x: x["ts"]["rare"] & reach(x["below"])))
    asked = asked.withColumn("alone", alone).withColumn("u", F.filter(F.arrays_zip("ts", "below"), lambda x: ~x["ts"]["rare"]))
    twos = F.flatten(F.transform(F.filter("u", lambda j: reach(j["below"])), lambda j: F.transform(F.filter("u", lambda i: (i["below"] < j["below"]) & reach(j["ts"]["w"] + i["below"])), lambda i: _two(i["ts"]["h"], j["ts"]["h"]))))
    hs = F.transform("ts", lambda x: x["h"])
    keys = F.array_distinct(F.concat(F.slice(hs, F.size("ts") - F.col("alone") + 1, F.col("alone")), twos))
    asked = asked.select("q", "self", "self_dated", hs.alias("hs"), F.transform("ts", lambda x: x["w"]).alias("ws"), F.transform(F.filter("ts", lambda x: x["dated"]), lambda x: x["h"]).alias("dates"), "alone", keys.alias("keys"))
    asked = written(asked, "query-terms", lean=True)
    held = postings.join(frequency, "h").select("d", "n", "h", rare.alias("rare")).repartition("d").groupBy("d").agg(F.first("n").alias("n"), F.collect_list(F.when(F.col("rare"), F.col("h"))).alias("rare"), F.collect_list(F.when(~F.col("rare"), F.col("h"))).alias("frequent"))
    held = written(held, "held", lean=True)
    discard(frequency)
    discard(slips)

    of_record = F.concat("rare", F.flatten(F.transform("frequent", lambda x, i: F.transform(F.slice("frequent", i + 2, F.size("frequent")), lambda y: _two(x, y)))))
    total = lambda of: F.aggregate(of, zero, lambda a, i: a + F.get("ws", i)) * norm
    hash_at = lambda at: F.get("hs", at)
    met = F.filter(F.sequence(F.lit(0), F.size("hs") - 1), lambda i: F.array_contains("every", hash_at(i)))

    def first_key(met: Column) -> Column:
        alone = F.filter(met, lambda i: i >= F.size("hs") - F.col("alone"))
        return F.when(F.size(alone) > 0, hash_at(F.get(alone, F.lit(0)))).when(F.size(met) > 1, _two(hash_at(F.element_at(met, -1)), hash_at(F.element_at(met, -2))))

    # One array of one pair or none, by steps that each compute their part once.
    scores = F.filter(F.transform(F.array(met), lambda m: F.struct(m.alias("met"), total(m).alias("score"))), lambda x: (x["score"] >= least) & (first_key(x["met"]) == F.col("key")))
    scores = F.transform(scores, lambda x: F.struct(x["score"].alias("score"), total(F.filter(x["met"], lambda i: F.array_contains("dates", hash_at(i)))).alias("dated")))
    best = Window.partitionBy("q").orderBy(F.desc("score"))
    of_best = lambda df: df.withColumn("place", F.rank().over(best)).filter(F.col("place") <= k).drop("place")
    parts = []
    for part in range(passes := max(1, min(PASSES, n_all // PASS_RECORDS))):
        in_part = lambda keys: F.explode(F.filter(keys, lambda x: F.pmod(x, F.lit(passes)) == part)).alias("key")  # noqa: B023, E731
        left, right = asked.select("q", "hs", "ws", "dates", "alone", in_part(F.col("keys"))), held.select("d", "n", F.concat("rare", "frequent").alias("every"), in_part(of_record))
        scored = left.join(right, "key").select("q", "d", F.explode(scores).alias("x")).select("q", "d", "x.score", "x.dated")
        parts.append(written(of_best(scored), "nearest", lean=True))
    pairs = functools.reduce(DataFrame.unionByName, parts)
    pairs = written(of_best(pairs).join(asked.select("q", "self", "self_dated"), "q"), "nearest", lean=True)
    for df in (*parts, asked, held):
        discard(df)
    return pairs


def _two(x: Column, y: Column) -> Column:
    return F.xxhash64(F.least(x, y), F.greatest(x, y))


def _likeness(a: Column, b: Column) -> Column:
    """Edit likeness of what two titles don't share, 1 where they share all words."""
    x, y = F.array_join(F.array_except(a, b), ""), F.array_join(F.array_except(b, a), "")
    rest = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    squashed = F.array_join(a, "") == F.array_join(b, "")
    return F.when(squashed, 1.0).otherwise(rest)


# How the dates of two records agree, from best to worst.
DATE_LEVELS = ["day", "month", "year", "next year", "apart", "unknown"]


def _date_level() -> Column:
    q, d, apart = F.col("q_date"), F.col("d_date"), F.abs(F.col("q_year") - F.col("d_year"))
    return (
        F.when(apart.isNull(), "unknown").when(apart > 1, "apart").when(apart == 1, "next year")
        .when((F.length(q) == 10) & (q == d), "day").when((F.length(q) >= 7) & (F.length(d) >= 7) & (F.substring(q, 1, 7) == F.substring(d, 1, 7)), "month").otherwise("year")
    )


def _people_meet() -> Column:
    """Whether people of both records meet: in full, with initials, or but for a slip; null where a side has none."""
    same = (
        F.arrays_overlap("q_people", "d_people")
        | F.arrays_overlap("q_initials", "d_people")
        | F.arrays_overlap("q_people", "d_initials")
        | F.exists("q_people", lambda p: F.exists("d_people", lambda r: (F.length(p) >= 8) & (F.levenshtein(p, r) <= 2)))
    )
    return F.when((F.size("q_people") > 0) & (F.size("d_people") > 0), F.coalesce(same, F.lit(False)))


# What the logistic calibration reads of a pair; nothing of it comes from a date.
FEATURES = ["gap", "part_of_self", "alike", "same_title", "other_part", "people_meet", "people_differ"]


def candidate_pairs(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(q, d, score, plain, FEATURES, level, both_dated) of each query's best pairs; see ``nearest_pairs``.

    ``plain`` is the score without what dates have in it.

    ``gap`` is the score without dates less that of the query's best other record, at most 30 either way, or the whole
    score where there is no other.
    """
    side = lambda df, p: df.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("words", "part", "year", "date", "people", "initials")])
    nearest = nearest_pairs(queries, index)
    found = nearest.withColumn("plain", F.col("score") - F.col("dated"))
    of_q = Window.partitionBy("q").orderBy(F.desc("plain"), "d")
    top, second = F.first("plain").over(of_q), F.nth_value("plain", 2).over(of_q.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gap = F.when(F.row_number().over(of_q) == 1, F.col("plain") - F.coalesce(second, F.lit(0.0))).otherwise(F.col("plain") - top)
    asked = written(found.withColumn("gap", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), gap))).join(side(queries, "q"), "q"), "asked", lean=True)
    discard(nearest)
    share = F.col("plain") / F.greatest(F.col("self") - F.col("self_dated"), F.lit(1e-9))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    parts = []
    for part in range(SIDE_PASSES):
        in_part = F.pmod(F.xxhash64("d"), F.lit(SIDE_PASSES)) == part
        full = asked.filter(in_part).join(side(index, "d").filter(in_part), "d")
        full = full.withColumn("alike", _likeness(F.col("q_words"), F.col("d_words"))).withColumn("meet", _people_meet())
        full = full.select(
            "q", "d", "score", "plain", "gap", share.alias("part_of_self"), "alike", yes(F.array_join("q_words", "") == F.array_join("d_words", "")).alias("same_title"), yes(F.col("q_part") != F.col("d_part")).alias("other_part"),
            yes(F.col("meet")).alias("people_meet"), yes(~F.col("meet")).alias("people_differ"), _date_level().alias("level"), ((F.length("q_date") == 10) & (F.length("d_date") == 10)).alias("both_dated"),
        )
        parts.append(written(full, "pairs", lean=True))
    discard(asked)
    return functools.reduce(DataFrame.unionByName, parts)


class Calibration:
    """What makes a confidence of a pair: logistic weights, the share of labels seen, and odds of the levels of dates.

    The labels don't come from any rule on the pair: of pairs whose dates are both known to the day, those of one day
    are works found again, since two works seldom share it; so only pairs count that are found without their dates. Some
    dates differ for one work, so only a share c of the matches is labelled: P(one day | features) is c times a logistic
    function of features that know no date. A first regression on the labels gives c, its mean over the labelled pairs
    (Elkan and Noto 2008); then a pair without label is a match as likely as c and the function say, and the function is
    fitted to that, in turn. How likely a match, or another
    pair, is at each level of agreement of the dates is then counted over all pairs, weighted by their confidence, until
    it stands still; these odds multiply. A pair that dates alone have found has less evidence in its other terms than
    singles out one of N records, and its odds are held to that.
    """

    def __init__(self, sample: pd.DataFrame, rounds: int = 20):
        x = np.column_stack([np.ones(len(sample)), sample[FEATURES].to_numpy(float)]) if len(sample) else np.zeros((0, len(FEATURES) + 1))
        seen = sample["both_dated"].to_numpy(bool)
        label = (sample["level"] == "day").to_numpy()[seen].astype(float)
        logistic = lambda w: 1 / (1 + np.exp(-np.clip(x[seen] @ w, -30, 30)))
        self.weights = _logistic(x[seen], label)
        self.share = float(np.clip(logistic(self.weights)[label > 0].mean(), 0.05, 0.99)) if label.any() else 1.0
        for _ in range(rounds if label.any() else 0):
            found = logistic(self.weights)
            self.weights = _logistic(x[seen], np.where(label > 0, 1.0, found * (1 - self.share) / (1 - self.share * found)))
        plain = np.clip(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))), 1e-6, 1 - 1e-4)
        level = sample["level"].map(DATE_LEVELS.index).to_numpy(int) if len(sample) else np.zeros(0, int)
        odds, match = np.zeros(len(DATE_LEVELS)), plain
        for _ in range(rounds):
            yes, no = (np.bincount(level, w, len(DATE_LEVELS)) + 0.5 for w in (match, 1 - match))
            odds = np.log(yes / yes.sum()) - np.log(no / no.sum())
            match = 1 / (1 + np.exp(-np.clip(np.log(plain / (1 - plain)) + odds[level], -30, 30)))
        self.odds = dict(zip(DATE_LEVELS, odds.tolist()))

    def confidence(self, evidence: float) -> Column:
        """The confidence; its odds without dates are at most what the score has above ``evidence``, ln N."""
        z = sum((float(w) * F.col(c) for w, c in zip(self.weights[1:], FEATURES)), F.lit(float(self.weights[0])))
        plain = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-4), 1 / (1 + F.exp(-z))))
        odds = F.coalesce(*[F.when(F.col("level") == k, F.lit(v)) for k, v in self.odds.items()])
        return 1 / (1 + F.exp(-(F.least(F.log(plain / (1 - plain)), F.col("plain") - evidence) + odds)))


def match_records(queries: DataFrame, index: DataFrame, calibration_rows: int = 20_000, least: float = 0.5) -> DataFrame:
    """(d, q, score, gap, confidence) of the mutually nearest pairs with a confidence of ``least`` or more.

    The nearest record is the one with the highest confidence, then score (then the smaller id), for the query and for
    the indexed record. ``gap`` is the score without dates less that of the query's best other record. The confidence
    is calibrated (``Calibration``) on at most ``calibration_rows`` of the pairs that reach ln N without their dates,
    taken by a hash; it alone decides.

    Defined cases: records without title have few terms and match only by people and date; empty sides give no rows;
    repeated rows count once; without any pair of days nothing is known, and no pair comes out.
    """
    pairs = candidate_pairs(queries, index)
    evidence = float(np.log(index.count() + 1.0))
    model = Calibration(pairs.filter(F.col("plain") >= evidence).orderBy(F.xxhash64("q", "d")).select(*FEATURES, "level", "both_dated").limit(calibration_rows).toPandas())
    sure = pairs.select("d", "q", "score", "gap", model.confidence(evidence).alias("confidence")).filter(F.col("confidence") >= least)
    best = [F.desc("confidence"), F.desc("score")]
    ranked = sure.select("*", F.row_number().over(Window.partitionBy("q").orderBy(*best, "d")).alias("at_q"), F.row_number().over(Window.partitionBy("d").orderBy(*best, "q")).alias("at_d"))
    return ranked.filter("at_q = 1 and at_d = 1").select("d", "q", "score", "gap", "confidence")


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights of a slightly damped logistic regression by Newton's method; few rows leave the first one low."""
    n = x.shape[1]
    if not len(x):
        return np.array([-30.0] + [0.0] * (n - 1))
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = x / scale
    w = np.zeros(n)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(n), x.T @ (p - y) + 1e-2 * w)
    return w / scale
