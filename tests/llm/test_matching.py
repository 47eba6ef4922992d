"""Problems 2, 3, 5 and 9 against brute force and on edge cases."""

import os
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cinegrain.llm.components import connected_groups
from cinegrain.llm.matching import FEATURES, Calibration, match_records, nearest_pairs, part_of, result_terms, terms_of, title_terms, without_variants
from cinegrain.llm.mixing import actual_shares, cross_entropy, mix_documents, mixture_plans, plan_mixture
from cinegrain.llm.names import _distances_to, coded, levenshtein_to, name_parts, radius_pairs, same_person, within_one
from cinegrain.session import discard, written


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components(spark):
    rng = random.Random(1)
    pairs = [(f"n{rng.randint(0, 300)}", f"n{rng.randint(0, 300)}") for _ in range(220)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)] + [("hub", f"s{i}") for i in range(100)] + [("me", "me"), ("x", None), (None, "y")]
    parent = {x: x for p in pairs for x in p if None not in p}
    for a, b in pairs:
        if a and b:
            ra, rb = find(parent, a), find(parent, b)
            parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(pairs + pairs[:50], "a string, b string").withColumn("node", F.lit("clash"))
    assert {r["node"]: r["group"] for r in connected_groups(df, "a", "b").collect()} == {x: find(parent, x) for x in parent}
    assert connected_groups(df.limit(0), "a", "b").count() == 0


def edit(a, b):
    """Damerau-Levenshtein distance by its definition."""
    seen, far = {}, len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        last = 0
        for j in range(1, len(b) + 1):
            k, m = seen.get(b[j - 1], 0), last
            cost = int(a[i - 1] != b[j - 1])
            if not cost:
                last = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        seen[a[i - 1]] = i
    return d[len(a), len(b)]


def test_distances():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    d = _distances_to(words, words)
    assert all(d[i, j] == edit(words[i], words[j]) for i in range(60) for j in range(60))
    codes, sizes = coded(words)
    assert all((within_one(codes[i], int(sizes[i]), codes, sizes) == (d[i] <= 1)).all() for i in range(60))


def test_radius_join_is_exact(spark, monkeypatch):
    monkeypatch.setattr("cinegrain.llm.names.MOST_CELL_ROWS", 40)  # cells are cut into stripes
    rng = random.Random(3)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(220)]
    want = {(a, b) for a, b in combinations(sorted(set(names)), 2) if edit(a, b) <= 1}
    got = radius_pairs(spark.createDataFrame([(x,) for x in [*names, None, ""]], "name string"))
    assert {tuple(r) for r in got.collect()} == want
    assert radius_pairs(spark.createDataFrame([], "name string")).count() == 0


@pytest.mark.parametrize(
    ("name", "parts"),
    [("C. Genirem", ("initial", "c", "genirem")), ("W.K. Kulanar", ("initial", "w", "kulanar")), ("WenishaDokutizad", ("full", "wenisha", "dokutizad")), ("Dreita-Gudpazek", ("full", "dreita", "gudpazek")), ("Ludbojir, Corovan", ("full", "corovan", "ludbojir")), ('Capt. Grian "Gr" Lutelek.', ("full", "grian", "lutelek")), ("Solo", ("one", "", "solo")), ("…", ("one", "", ""))],
)
def test_name_parts(name, parts):
    assert name_parts(name) == parts


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_by_bits():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    names = [word(rng.randint(1, 12)) for _ in range(40)] + [word(70), word(130), "a"]
    pivots = [word(rng.randint(1, 12)) for _ in range(12)] + [word(64), word(65), word(140)]
    d = levenshtein_to(names, pivots)
    assert all(d[i, j] == lev(a, b) for i, a in enumerate(names) for j, b in enumerate(pivots))


def test_distinct_letters_are_apart():
    assert _distances_to(["a"], ["\u015c"])[0, 0] == 1 and levenshtein_to(["a"], ["\u015c"])[0, 0] == 1


def grouped(pairs, n):
    parent = list(range(n + 1))
    for a, b in pairs:
        parent[find(parent, b)] = find(parent, a)
    return [find(parent, i) for i in range(n + 1)]


def test_first_names_of_one_letter_stay_apart(spark):
    rows = [("Amit Shah", None)] * 3 + [("Anita Shah", None)] * 2 + [("Ajay Shah", None), ("A. Shah", None), ("Bill Smith", None), ("William Smith", None), ("B. Sol", None), ("Bela Sol", None)]
    rows += [(f"{x} {last}", f"William {last}") for last in ("Rove", "Tark", "Undel") for x in ("William", "William", "Bill")]
    rows += [(f"{x} {last}", f"{first} {last}") for first, last in (("Zelul", "Marp"), ("Dreolo", "Visk"), ("Weneth", "Quod")) for x in (first, first, first[:3] + "i")] + [("Zeli Hentuvot", None), ("Zelul Hentuvot", None)]
    df = spark.createDataFrame([(i + 1, n, w) for i, (n, w) in enumerate(rows)], "entry_id long, name string, wikititle string")
    got = grouped((tuple(r) for r in same_person(df).collect()), len(rows))
    first = {n: i + 1 for i, (n, w) in reversed(list(enumerate(rows))) if w is None}
    assert len({got[first[n]] for n in ("Amit Shah", "Anita Shah", "Ajay Shah", "A. Shah")}) == 4
    assert got[first["Bill Smith"]] == got[first["William Smith"]] and got[first["B. Sol"]] == got[first["Bela Sol"]] and got[first["Zeli Hentuvot"]] == got[first["Zelul Hentuvot"]]


def test_same_person(spark):
    rows = [("Corovan Ludbojir", "Corovan Ludbojir")] * 5 + [("Ludbojir, Corovan", None), ("Corovan Ldbojir", None), ("C. Ludbojir", None), ("COROVAN LUDBOJIR", "Corovan_Ludbojir"), ("Dr. Corovan Ludbojir", None)]
    rows += [("Ana Mivek", "Ana Mivek (actress)"), ("Ana Mivek", "Ana Mivek (singer)"), ("Elin Torbek", None), (None, "X"), ("", None), ("  ", None)] + [("Corovan Zad", None), ("Elin Pos", None), ("Ana Rov", None)]
    df = spark.createDataFrame([(i + 1, n, w) for i, (n, w) in enumerate(rows)], "entry_id long, name string, wikititle string").withColumn("n", F.lit(0))
    pairs = {tuple(r) for r in same_person(df).collect()}
    group = [1, 6, 7, 8, 9, 10]
    assert pairs == set(combinations(group, 2))
    assert same_person(df.limit(0)).count() == 0


def test_parts_and_terms():
    assert part_of("x ii") == ("x", "2") and part_of("x part 3") == ("x", "3") and part_of("x again") == ("x", "again") and part_of("ii") == ("ii", "1") and part_of("36 days in y") == ("36 days in y", "1")
    assert part_of("rocky two") == part_of("rocky 2") == ("rocky", "2")
    assert "t:oldriver" in terms_of("Old  RIVER", 2001, "2001-02-03", ["B, A"], ["hi"])["terms"]


def works(spark, n=120, seed=4):
    rng = random.Random(seed)
    syllables = [a + b + c for a in "bdgklm" for b in "aeiou" for c in "dklnr"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(3))
    titles, results = [], []
    for i in range(n):
        name, director, year = f"The {word().title()} of {word().title()}", f"{word().title()} {word().title()}", rng.randint(1980, 2025)
        date = f"{year}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
        titles.append((i, "movie", name, name, date, year, "Hindi", [director], None))
        if i % 3:
            typo = name[:6] + name[7:] if i % 5 == 0 else name
            results.append((1000 + i, typo, None, date if i % 4 else None, None, "hi", director))
            results.append((3000 + i, name + " Returns", None, f"{year + 3}{date[4:]}", None, "hi", director))
            results.append((5000 + i, name, None, f"{year + 9}{date[4:]}", None, "hi", f"{word().title()} {word().title()}"))
            results.append((7000 + i, None, name, None, date, "hi", director))
    results += [results[0], (9000, None, None, None, None, None, None)]
    t = spark.createDataFrame([*titles, titles[0]], "pageid long, kind string, title string, wikititle string, releasedate string, year int, language string, directedby array<string>, params map<string,string>")
    r = spark.createDataFrame(results, "id long, title string, name string, release_date string, first_air_date string, original_language string, director string")
    return t, r


def test_matching(spark):
    t, r = works(spark)
    found = match_records(result_terms(r), title_terms(t)).collect()
    assert {(x["d"], x["q"]) for x in found} == {(i, 1000 + i) for i in range(120) if i % 3}
    assert all(0 <= x["confidence"] <= 1 for x in found)
    assert match_records(result_terms(r.limit(0)), title_terms(t)).count() == 0
    assert match_records(result_terms(r), title_terms(t.limit(0))).count() == 0


@pytest.mark.parametrize("rare", [64, 2, 0])
def test_pruning_is_exact(spark, monkeypatch, rare):
    """The best four records of every query, by full scores over all pairs and all terms."""
    monkeypatch.setattr("cinegrain.llm.matching.RARE", rare)  # the fewer are joined alone, the more by twos
    from cinegrain.llm.matching import B, K1, WEIGHTS

    t, r = works(spark, 60)
    index, queries = title_terms(t).toPandas(), result_terms(r).toPandas()
    n, mean = len(index), index["terms"].map(len).mean()
    df = {}
    for b, terms in zip(index["block"], index["terms"]):
        for x in terms:
            df[b, x] = df.get((b, x), 0) + 1
    weight = lambda b, x: WEIGHTS[x[0]] * np.log(1 + (n - df[b, x] + 0.5) / (df[b, x] + 0.5)) if (b, x) in df else 0
    best = {}
    for q in queries.itertuples():
        own = {x: weight(q.block, x) for x in q.terms}
        scores = []
        for d in index[index["block"] == q.block].itertuples():
            met = [own[x] for x in set(q.terms) & set(d.terms)], [own[x] for x in set(q.terms) & set(d.terms) if x[0] in "ymx"]
            norm = (K1 + 1) / (1 + K1 * (1 - B + B * len(d.terms) / mean))
            scores.append((sum(met[0]) * norm, sum(met[1]) * norm, d.id))
        kth = sorted((s for s, _, _ in scores), reverse=True)[:4][-1:]
        best |= {(q.id, d): (s, v) for s, v, d in scores if s >= np.log(n + 1) and s >= kth[0] - 1e-9}
    got = {(x["q"], x["d"]): (x["score"], x["dated"]) for x in nearest_pairs(result_terms(r), title_terms(t)).collect()}
    assert got.keys() == best.keys() and all(abs(got[k][i] - best[k][i]) < 1e-6 for k in best for i in (0, 1))


def nearest_by_all_scores(queries, index, k=4):
    """{(q, d): (score, dated, self, self_dated)} of the best pairs, by full scores over all pairs and all terms."""
    from cinegrain.llm.matching import B, K1, WEIGHTS

    n, mean, df = len(index), index["terms"].map(len).mean(), {}
    for b, terms in zip(index["block"], index["terms"]):
        for x in terms:
            df[b, x] = df.get((b, x), 0) + 1
    best = {}
    for q in queries.itertuples():
        own = {x: WEIGHTS[x[0]] * np.log(1 + (n - df[q.block, x] + 0.5) / (df[q.block, x] + 0.5)) for x in q.terms if (q.block, x) in df}
        dated = {x: w for x, w in own.items() if x[0] in "ymx"}
        scores = []
        for d in index[index["block"] == q.block].itertuples():
            norm = (K1 + 1) / (1 + K1 * (1 - B + B * len(d.terms) / mean))
            met = own.keys() & set(d.terms)
            scores.append((sum(own[x] for x in met) * norm, sum(dated[x] for x in met & dated.keys()) * norm, d.id))
        kth = sorted((s for s, _, _ in scores), reverse=True)[:k][-1:]
        best |= {(q.id, d): (s, v, sum(own.values()), sum(dated.values())) for s, v, d in scores if s >= np.log(n + 1) and s >= kth[0] - 1e-9}
    return best


@pytest.mark.parametrize("rare", [64, 3])
def test_slips_between_titles_count(spark, monkeypatch, rare):
    """Titles that lie close together share variants with several others, whether the index has them or not."""
    monkeypatch.setattr("cinegrain.llm.matching.RARE", rare)
    monkeypatch.setattr("cinegrain.llm.matching.PASS_RECORDS", 20)
    rng = random.Random(8)
    title = lambda: "".join(rng.choice("abc1") for _ in range(rng.randint(4, 7))) + rng.choice(["", "", " 2", " zug"])
    date = lambda: rng.choice([None, f"{rng.randint(1990, 2020)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}"])
    titles = [(i, rng.choice(["movie", "series"]), title(), None, date(), None, "Hindi", [f"{title()} {title()}"], None) for i in range(150)]
    results = [(1000 + i, title(), None, date(), None, "hi", f"{title()} {title()}") for i in range(60)] + [(2000 + t[0], t[2], None, t[4], None, "hi", t[7][0]) for t in titles[:40]] + [(3000, "", None, None, None, None, None)]
    index = title_terms(spark.createDataFrame(titles, "pageid long, kind string, title string, wikititle string, releasedate string, year int, language string, directedby array<string>, params map<string,string>"))
    queries = result_terms(spark.createDataFrame(results, "id long, title string, name string, release_date string, first_air_date string, original_language string, director string"))
    best = nearest_by_all_scores(queries.toPandas(), index.toPandas())
    for left, right in ((queries, index), (without_variants(queries), without_variants(index))):
        got = {(x["q"], x["d"]): (x["score"], x["dated"], x["self"], x["self_dated"]) for x in nearest_pairs(left, right).collect()}
        assert got.keys() == best.keys() and all(abs(got[p][i] - best[p][i]) < 1e-6 for p in best for i in range(4))


def test_pairs_below_the_least_score_are_not_written(spark):
    """No stage writes more than the terms of the records, however many pairs share a word, and no shuffle file stays."""
    n, syllables = 3000, [a + b for a in "bdgklmnprst" for b in "aeiou"]
    word = lambda i: "".join(syllables[(i // 55**k) % 55] for k in range(3))
    title = lambda i: f"{word(i * 7919 % 166_375)} {word(90_000 + i % 50)} {word(120_000 + i % 51)}"
    titles = [(i, "movie", title(i), None, None, None, None, None, None) for i in range(n)]
    results = [(10_000 + i, title(i), None, None, None, None, None) for i in range(n)]
    index = written(title_terms(spark.createDataFrame(titles, "pageid long, kind string, title string, wikititle string, releasedate string, year int, language string, directedby array<string>, params map<string,string>")), "index")
    queries = written(result_terms(spark.createDataFrame(results, "id long, title string, name string, release_date string, first_air_date string, original_language string, director string")), "queries")
    terms = sum(df.agg(F.sum(F.size("terms"))).first()[0] for df in (index, queries))
    context, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()
    none = lambda: (context._jvm.java.util.ArrayList(), False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda x: (x.apply(i) for i in range(x.size())))(store.stageList(*none()))}
    folders = [f.getPath() for f in context._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {os.path.join(at, f) for folder in folders for at, _, names in os.walk(folder) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    before, there = set(stages()), files()
    pairs = nearest_pairs(queries, index)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    assert {r["q"] for r in pairs.filter("q = d + 10000").collect()} == {10_000 + i for i in range(n)}
    assert max(r for i, r in stages().items() if i not in before) <= terms
    assert sum(map(os.path.getsize, files() - there)) < 200_000


def test_tables_that_are_read_stay(spark, tmp_path):
    """Only written tables are deleted, never one of the input."""
    t, r = works(spark, 12)
    r.write.parquet(f"{tmp_path}/results.parquet")
    kept = spark.read.parquet(f"{tmp_path}/results.parquet")
    assert match_records(result_terms(kept), title_terms(t.limit(0))).count() == 0
    discard(kept)
    assert kept.count() == r.count()


def test_confidence_needs_no_rule():
    """Labels are days that agree; a model of them tells matches from works of one title, also where days are unknown."""
    rng = np.random.default_rng(3)
    n = 4000
    match = rng.random(n) < 0.5
    x = {c: np.zeros(n) for c in FEATURES}
    x["gap"] = np.where(match, rng.normal(12, 6, n), rng.normal(-8, 6, n))
    x["part_of_self"] = np.where(match, 0.9, 0.4) + rng.normal(0, 0.15, n)
    x["alike"] = np.where(match, 0.95, 0.6) + rng.normal(0, 0.2, n)
    x["people_meet"] = ((rng.random(n) < 0.9) & match).astype(float)
    x["people_differ"] = ((rng.random(n) < 0.9) & ~match).astype(float)
    both = rng.random(n) < 0.8
    level = np.where(~both, "unknown", np.where(match & (rng.random(n) < 0.7), "day", np.where(match, "month", "apart")))
    sample = pd.DataFrame(x | {"level": level, "both_dated": both})
    model = Calibration(sample)
    assert 0.6 < model.share < 0.8 and model.odds["day"] > 4 and model.odds["apart"] < -3 and abs(model.odds["unknown"]) < 0.5
    found = 1 / (1 + np.exp(-np.column_stack([np.ones(n), sample[FEATURES]]) @ model.weights))
    for low, high in ((0.0, 0.1), (0.1, 0.9), (0.9, 1.1)):
        own = (found >= low) & (found < high)
        assert abs(match[own].mean() - found[own].mean()) < (0.2 if own.sum() < 100 else 0.05)
    assert Calibration(sample.iloc[:0]).weights[0] < -20


def test_plans():
    plan = plan_mixture({"a": 1000, "b": 100}, {"a": 1.0, "b": 1.0, "none": 1.0}, {"a": 2, "b": 4, "none": 9})
    assert plan["none"]["budget"] == 0 and abs(plan["a"]["share"] - 0.5) < 1e-6 and plan["b"]["repeats"] <= 4
    tight = plan_mixture({"a": 10_000, "b": 10}, {"a": 1.0, "b": 1.0}, {"a": 1, "b": 2}, budget=10_010)
    assert tight["b"]["budget"] == 20 and 0 < tight["b"]["power"] < 1 and tight["a"]["budget"] + tight["b"]["budget"] >= 2000
    assert plan_mixture({}, {"a": 1.0}, {"a": 1})["a"]["budget"] == 0


def test_target_entropy():
    tokens, weights, most = {"a": 4000, "b": 900, "c": 100}, {"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 2, "b": 2, "c": 4}
    exact, near = plan_mixture(tokens, weights, most), plan_mixture(tokens, weights, most, entropy_loss=0.02)
    target = dict.fromkeys(tokens, 1 / 3)
    loss = cross_entropy(target, {s: p["share"] for s, p in near.items()}) - cross_entropy(target, target)
    assert exact["c"]["power"] == 1 and sum(p["budget"] for p in exact.values()) == pytest.approx(1200, abs=2)
    assert loss == pytest.approx(0.02, abs=1e-6) and 0 < near["c"]["power"] < 1
    assert near["c"]["budget"] == 400 and sum(p["budget"] for p in near.values()) > 1300
    # Where the target can be met at full size, it is.
    assert plan_mixture(tokens, weights, {"a": 9, "b": 9, "c": 99}, entropy_loss=0.02)["a"]["share"] == pytest.approx(1 / 3)


def test_expected_shares(spark):
    counted = spark.createDataFrame([(i, s, 10) for i, s in enumerate(["a"] * 60 + ["b"] * 30 + ["c"] * 10)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", "a", 2.0, 1), ("m", "b", 1.0, 1), ("m", "c", 1.0, 2), ("m", "d", 1.0, 2)], "mix_id string, source string, weight double, max_repeats int")
    plans = mixture_plans(spark, counted, targets)
    got = {r["source"]: (r["target_share"], r["planned_share"], r["actual_share"], r["n_tokens"], r["n_documents"], r["repeats"]) for r in actual_shares(mix_documents(counted, plans), plans).collect()}
    assert got == {"a": (0.4, 0.5, 0.5, 400, 40, pytest.approx(2 / 3)), "b": (0.2, 0.25, 0.25, 200, 20, pytest.approx(2 / 3)), "c": (0.2, 0.25, 0.25, 200, 20, 2.0), "d": (0.2, 0.0, 0.0, 0, 0, 0.0)}


def test_mixing(spark):
    rng = random.Random(6)
    docs = [(i, s, rng.randint(1, 50)) for i, s in enumerate(["a"] * 5000 + ["b"] * 200 + ["c"] * 800)] + [(9000, None, 5), (9001, "a", 0)]
    counted = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", "a", 2.0, 1), ("m", "b", 1.0, 8), ("m", "c", 1.0, 2), ("m", "d", 1.0, 2), ("w", "a", 0.0, 1), ("w", "c", 5.0, 3)], "mix_id string, source string, weight double, max_repeats int")
    plans = mixture_plans(spark, counted, targets)
    mixed = mix_documents(counted, plans).cache()
    assert mixed.groupBy("mix_id", "doc_id", "epoch").count().filter("count > 1").count() == 0
    shares = {(r["mix_id"], r["source"]): r for r in actual_shares(mixed, plans).collect()}
    for key, share in {("m", "a"): 0.5, ("m", "b"): 0.25, ("m", "c"): 0.25, ("w", "c"): 1.0}.items():
        assert abs(shares[key]["actual_share"] - share) < 0.01
    limits = {("m", "a"): 1, ("m", "b"): 8, ("m", "c"): 2, ("w", "c"): 3}
    assert all(shares[k]["repeats"] <= v for k, v in limits.items()) and shares["m", "d"]["n_tokens"] == 0
    assert sorted(map(tuple, mix_documents(counted, plans).collect())) == sorted(map(tuple, mixed.collect()))
