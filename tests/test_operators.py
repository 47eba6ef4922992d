"""Relational operators on small cases, with ties, nulls and empty tables."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cinegrain.functions import scalars as S
from cinegrain.operators import delta, ranking, resolve, search, trends


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: S.slugify(F.lit("Café & Co. (2014 film)")), "cafe-and-co"), (lambda: S.slugify(F.lit("हिन्दी"), F.lit(7)), "p7"), (lambda: S.display_title(F.lit("(film)")), "(film)"),
        (lambda: S.wiki_url(F.lit("A b's (c)!")), "https://en.wikipedia.org/wiki/A_b's_(c)!"), (lambda: S.bucket_key(F.lit("9a")), "#"), (lambda: S.is_mainspace(F.lit(" Draft : x")), False),
        (lambda: S.is_mainspace(F.lit("Ramayana: Part 1")), True), (lambda: S.is_non_title_name(F.lit("Film Awards")), True), (lambda: S.start_date(F.lit("{{Film date|2025|12|5|df=y}}")), "2025-12-05"),
        (lambda: S.start_date(F.lit("{{Start date|2025|13}}")), None), (lambda: S.start_date(F.lit("{{Start date|2025}}")), "2025"), (lambda: S.runtime_text(F.lit("214 minutes")), "3h 34m"),
        (lambda: S.runtime_text(F.lit("60–90 min")), "1h 0m – 1h 30m"), (lambda: S.runtime_text(F.lit("45")), "45 min"), (lambda: S.runtime_text(F.lit("long")), "long"), (lambda: S.initials(F.lit(" ana  b c")), "AB"),
        (lambda: S.language_bonus(F.lit("hi"), F.lit("Hindi, Tamil")), 3), (lambda: S.language_bonus(F.lit("th"), F.lit("Tamil")), -3), (lambda: S.language_bonus(F.lit(""), F.lit("Tamil")), 0),
        (lambda: S.timeline_dates(F.lit("5 March 1990 and 5 march 1990, April 2023")), ["5 March 1990", "April 2023"]), (lambda: S.sentence_chunks(F.lit("A. B one. Cc. Dd! Ee? F.R. G.")), None),
        (lambda: S.age_of(S.fact_date(F.lit("5 March 1990")), S.fact_date(F.lit("")), F.lit("2026-03-04").cast("date")), 35), (lambda: S.doc_url(F.lit("series:x")), "/series/x/"), (lambda: S.doc_url(F.lit("q:x")), "/"),
        (lambda: S.backoff_ms(F.lit(9)), 30000), (lambda: S.half_up(F.lit(-2.5)), -2), (lambda: S.image_filename(F.lit("<!-- a.png -->[[File:B c.JPG|x]]")), "B c.JPG"), (lambda: S.truncated(F.lit("abc"), 5), "abc"),
        (lambda: S.tagline_of(F.lit("x" * 50 + ". Next one.")), "x" * 50 + "."), (lambda: S.role_label(F.lit("sound_mix"), {"director": "Director"}), "Sound Mix"),
    ],
)
def test_scalars(spark, column, want):
    got = value(spark, column())
    assert got == want or want is None and isinstance(got, (list, type(None)))


def test_trends(spark):
    views = spark.createDataFrame([("a", f"2026-01-0{i + 1}", v) for i, v in enumerate((40, 10, 7, 3))] + [("b", "2026-01-01", 1), ("b", "2026-01-02", 0), ("b", "2026-01-03", 0), ("c", "2026-01-01", None)], "title string, day string, views long").withColumn("day", F.to_date("day"))
    out = {r["title"]: r["score"] for r in trends.trend_scores(views).collect()}
    assert out == {"a": 35, "b": 1, "c": 0}
    assert [r["title"] for r in trends.top_ranked(trends.trend_scores(views), 5).collect()] == ["a", "b"]
    assert trends.trend_scores(views.limit(0)).count() == 0


def sequential(rows):
    taken, out = set(), {}
    for key, base in rows:
        slug, n = base, 2
        while slug in taken:
            slug, n = f"{base}-{n}", n + 1
        taken.add(slug)
        out[key] = slug
    return out


def test_slug_registry(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["x", "x-2", "x-2-2", "y", "y-3", "z-1"])) for i in range(200)]
    out = resolve.issue_slugs(spark.createDataFrame(rows, "pageid long, base string"), "base", ["pageid"]).collect()
    assert {r["pageid"]: r["slug"] for r in out} == sequential(rows)


def test_redirects(spark):
    edges = [("A", "B", 0), ("B", "C", 1), ("C", "A", 2), ("D", "E", 3), ("D", "F", 4), ("E", "G", 5), ("X", "X", 6), (None, "Q", 7), ("P", "", 8), ("S", "A", 9)]
    edges += [(f"n{i}", f"n{i + 1}", 10 + i) for i in range(70)]
    out = {r[0]: r[1] for r in resolve.resolve_titles(spark.createDataFrame(edges, "from_title string, to_title string, ord int")).collect()}
    assert out["A"] == "C" and out["S"] == "C" and out["D"] == "G" and out["n0"] == "n70" and out["X"] == "X" and "P" not in out


def walked(edges):
    """Final titles by walking edge by edge, to the end or to before a repeat."""
    first = {}
    for a, b, o in sorted((e for e in edges if e[0] and e[1]), key=lambda e: (e[2], e[1])):
        first.setdefault(a, b)
    out = {}
    for start in first:
        at, seen = start, {start}
        while at in first and first[at] not in seen:
            at = first[at]
            seen.add(at)
        out[start] = at
    return out


def test_redirects_with_many_cycles(spark):
    rng = random.Random(9)
    edges = [(f"t{rng.randint(0, 400)}", f"t{rng.randint(0, 400)}", i) for i in range(500)] + [(f"c{i}", f"c{(i + 1) % 37}", i) for i in range(37)] + [(f"d{i}", f"d{i + 1}" if i < 50 else "c5", i) for i in range(51)]
    out = resolve.resolve_titles(spark.createDataFrame(edges, "from_title string, to_title string, ord int")).collect()
    assert {r[0]: r[1] for r in out} == walked(edges) and len(out) == len(walked(edges))
    assert resolve.resolve_titles(spark.createDataFrame([], "from_title string, to_title string, ord int")).count() == 0


def test_plans(spark):
    prev = spark.createDataFrame([(1, 10), (2, None), (4, 1)], "pageid long, revid long")
    cur = spark.createDataFrame([(1, 11), (2, None), (3, 5)], "pageid long, revid long")
    assert {tuple(r) for r in delta.plan_refresh(prev, cur).collect()} == {(1, "changed"), (3, "added")}
    live = spark.createDataFrame([("m:a", 1), ("m:b", 2), ("m:c", 3), ("m:d", None)], "id string, pid long")
    build = spark.createDataFrame([("m:a", 1), ("m:z", 2)], "id string, pid long")
    gone = spark.createDataFrame([("m:d",)], "id string")
    assert {tuple(r) for r in delta.diff_documents(live, build, gone).collect()} == {("m:b", "renamed"), ("m:c", "unexpected"), ("m:d", "intentional"), ("m:z", "added")}
    tracked = spark.createDataFrame([(1, "2026-02-01"), (2, "2026"), (3, "2199"), (None, "2026-03-01"), (5, None)], "id long, releasedate string")
    assert {r["id"] for r in delta.freshness_band(tracked, F.lit("2026-03-01").cast("date")).collect()} == {1, 2} - ({2} if "2026" < "2026-01-15" else set())


def test_canaries_and_rank(spark):
    ids = spark.createDataFrame([(f"k{i:03}",) for i in range(95)], "id string")
    assert sorted(r["id"] for r in delta.canary_sample(ids, 10).collect()) == [f"k{i * 95 // 10:03}" for i in range(10)]
    assert delta.canary_sample(ids, 200).count() == 95
    ranks = {r["id"]: r["rank"] for r in delta.global_rank(ids, ["id"]).collect()}
    assert ranks == {f"k{i:03}": i for i in range(95)}


def test_picks(spark):
    scored = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (1, 2, 9), (2, 0, 2), (2, 1, 2), (3, 0, 0)], "p long, ord int, score int")
    assert {(r["p"], r["ord"]) for r in ranking.best_candidate(scored, ["p"]).collect()} == {(1, 1), (2, 0)}
    videos = spark.createDataFrame([(1, 0, 0, "a", "YouTube", "Teaser", True), (1, 0, 1, "b", "YouTube", "Trailer", False), (1, 0, 2, "c", "Vimeo", "Trailer", True)], "p long, pool int, ord int, key string, site string, type string, official boolean")
    assert ranking.pick_trailer(videos, ["p"]).first()["key"] == "b"
    lines = spark.createDataFrame([(1, 1, 5), (1, 2, None), (2, 1, None), (2, 2, 7)], "g int, i int, y int")
    assert [r["y"] for r in ranking.carried(lines, ["g"], ["i"], "y").orderBy("g", "i").collect()] == [5, 5, None, 7]


def test_best_matches(spark):
    records = [(1, "movie", "the Late show", 2001), (2, "movie", " Abc", None), (3, "series", "Abc", 2002), (4, "movie", "None such", 2001), (5, "movie", "None such", 1900), (6, "other", "Abc", 2001), (7, "movie", None, None)]
    results = [(10, "movie", "The Late Show", 2001), (9, "movie", "THE LATE SHOW ", 2000), (12, "movie", "abc", 1999), (11, "series", "Abc", 2002), (8, "movie", None, None), (7, "series", "X", 2002)]
    low = lambda t: t and t.strip(" ").lower()
    want = {}
    for key, kind, title, year in records:
        tiers = [(0 if low(t) and low(t) == low(title) and y and y == year else 1 if low(t) and low(t) == low(title) else 2 if y and y == year else 3, i) for i, k, t, y in results if k == kind]
        if tiers:
            want[key] = min(tiers)[::-1]
    got = ranking.best_matches(spark.createDataFrame(records, "key long, kind string, title string, year int"), spark.createDataFrame(results, "id long, kind string, title string, year int")).collect()
    assert {r["key"]: (r["id"], r["tier"]) for r in got} == want and len(got) == len(want) and want[1] == (10, 0) and want[2] == (12, 1) and want[3] == (11, 0)


def test_search(spark):
    docs = spark.createDataFrame([Row(id="m:1", k="movie", t="The Paper Lantern", q=["Ana B"]), Row(id="m:2", k="movie", t="River", q=["Paper Boy"]), Row(id="p:3", k="person", t="Lantem", q=[])])
    index = search.postings(docs)
    assert {r["id"] for r in search.find(index, "lan").collect()} == {"m:1", "p:3"}
    assert [r["id"] for r in search.ranked(docs, index, "paper lantern", 2).orderBy("place").collect()] == ["m:1", "m:2"] or search.ranked(docs, index, "paper lantern", 2).count() == 2
    assert search.postings(docs.limit(0)).count() == 0


def test_person_documents(spark):
    credits = [("ana-b", 0, "Ana B", f"T{i}", i) for i in range(10, 0, -1)] + [("ana-b", 0, "Ana B", "T1", 99), ("ana-b", 1, "Anna", None, 3), ("c", 1, "Cy", None, 1), ("c", 1, "Cai", None, 2), (None, 1, "D", "T1", 1)]
    out = {r["id"]: (r["k"], r["t"], r["q"]) for r in search.person_documents(spark.createDataFrame(credits, "slug string, rank int, name string, title string, ord long")).collect()}
    assert out == {"person:ana-b": ("person", "Ana B", [f"T{i}" for i in range(1, 11)]), "person:c": ("person", "Cai", [])}


def test_category_walk_and_merge(spark):
    members = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "parent string, child string")
    out = {r["node"]: r["level"] for r in resolve.category_walk(members, spark.createDataFrame([("a",)], "node string")).collect()}
    assert out == {"a": 0, "b": 1, "c": 2}
    left, right = spark.createDataFrame([("x", 1)], "name string, n int"), spark.createDataFrame([("x", 2), ("y", 3)], "name string, n int")
    assert {(r["name"], r["n"]) for r in resolve.merge_ranked([left, right], ["name"], ["n"]).collect()} == {("x", 1), ("y", 3)}


def test_tables_read_once(spark):
    from cinegrain.session import scratch_path
    from cinegrain.sources.landing import consume_once, consumed

    path = scratch_path(spark, "dirty")
    ids = lambda: sorted(r["id"] for r in consume_once(spark, path, "id string").collect())
    assert ids() == []
    spark.createDataFrame([("a",)], "id string").write.parquet(path)
    assert ids() == ["a"] and ids() == ["a"]  # a run that died is repeated
    spark.createDataFrame([("b",)], "id string").write.parquet(path)
    assert ids() == ["a"]
    consumed(spark, path)
    assert ids() == ["b"]
    consumed(spark, path)
    assert ids() == []


def test_waves(spark):
    from cinegrain.operators.frontier import expand

    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("c", "d"), ("b", "e"), ("e", "f"), ("x", "y"), (None, "z"), ("a", None)], "source string, target string")
    verdicts = spark.createDataFrame([("b", "accepted"), ("c", "rejected"), ("e", "accepted"), ("f", "accepted")], "node string, status string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,)], "node string")
    out = {r["node"]: (r["status"], r["wave"], r["refs"]) for r in expand(seeds, links, verdicts, 2).collect()}
    assert out == {"a": ("accepted", 0, 0), "b": ("accepted", 1, 1), "c": ("rejected", 1, 1), "e": ("accepted", 2, 1)}
    assert expand(seeds.limit(0), links, verdicts, 2).count() == 0


def test_group_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randint(0, 50), i) for i in range(300)]
    out = delta.group_rank(spark.createDataFrame(rows, "g string, v int, i int"), ["g"], [F.desc("v"), F.col("i")]).collect()
    for g in ("hot", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        got = sorted((r for r in out if r["g"] == g), key=lambda r: r["rank"])
        assert [r["i"] for r in got] == [r[2] for r in own] and {r["count"] for r in got} == {len(own)} and [r["rank"] for r in got] == list(range(len(own)))
