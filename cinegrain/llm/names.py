"""Variant spellings of names typed by people: a metric-space radius join and the persons it yields."""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegrain.llm.components import connected_groups
from cinegrain.llm.matching import folded
from cinegrain.session import cut, written

# Forms of address before a name.
_TITLES = re.compile(r"^(?:(?:shri|sri|smt|shrimati|kumari|capt|captain|dr|prof|professor|mr|mrs|ms|miss|sir|dame|lord|lady|late|pt|pandit|ustad|begum|col|colonel|maj|major|gen|lt|rev|saint|st)\b\.?\s+)+", re.IGNORECASE)
_NICK = re.compile(r"\s*(?:[\"“”„‘’«»]|(?<!\w)')[^\"“”„‘’«»']*(?:[\"“”„‘’«»]|'(?!\w))\s*|\s*\([^)]*\)\s*")
MOST_CELL_ROWS = 4000


def unmarked(text: str) -> str:
    """Lower case without marks, the spelling else as it is."""
    return "".join(c for c in unicodedata.normalize("NFKD", text).lower() if not unicodedata.combining(c))


def name_parts(name: str, fold=folded) -> tuple[str, str, str]:
    """(kind, first, last) of a typed name, folded: kind is full, initial (first is one letter), or one (no parts)."""
    text = re.sub(r"\s+", " ", _NICK.sub(" ", name.replace("\xa0", " "))).strip()
    text = _TITLES.sub("", text).strip(" .,;")
    if "," in text:
        last, _, first = text.partition(",")
        text = f"{first.strip()} {last.strip()}".strip()
    if " " not in text:
        text = re.sub(r"(?<=[^\W\d_])-(?=[^\W\d_])", " ", re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])", " ", text)) if not re.fullmatch(r"(?:\w\.)+\w+", text) else text
    words = [w for w in re.findall(r"[^\W_]+", fold(text)) if w]
    long = [w for w in words if len(w) > 1]
    if not long:
        return "one", "", "".join(words)
    if len(long) == 1:
        short = [w for w in words if len(w) == 1]
        return ("initial", short[0], long[0]) if short else ("one", "", long[0])
    return "full", long[0], " ".join(long[1:])


def page_title(title: str | None) -> str | None:
    """A page title as the wiki resolves it: underscores are spaces, the first letter's case doesn't count."""
    text = re.sub(r"[\s_]+", " ", title or "").strip()
    return text[:1].upper() + text[1:] if text else None


def edit_distances(xs: np.ndarray, nx: np.ndarray, ys: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """True Damerau-Levenshtein distances (a metric) of many pairs of coded strings, rows padded by 0, at once."""
    m, wx, wy = len(xs), xs.shape[1], ys.shape[1]
    far = wx + wy
    d = np.full((wx + 2, wy + 2, m), far, np.int16)
    d[1, 1:] = np.arange(wy + 1, dtype=np.int16)[:, None]
    d[1:, 1] = np.arange(wx + 1, dtype=np.int16)[:, None]
    every = np.arange(m)
    last_row = np.zeros((int(max(xs.max(initial=0), ys.max(initial=0))) + 1, m), np.int16)
    flat = d.reshape(-1)
    for i in range(1, wx + 1):
        a = xs[:, i - 1]
        last_col = np.zeros(m, np.int16)
        for j in range(1, wy + 1):
            b = ys[:, j - 1]
            row, col = last_row[b, every], last_col
            same = a == b
            best = np.minimum(d[i, j] + ~same, np.minimum(d[i + 1, j], d[i, j + 1]) + 1)
            swap = np.flatnonzero((row > 0) & (col > 0))
            if len(swap):
                r, c = row[swap].astype(np.int64), col[swap].astype(np.int64)
                cost = flat[(r * (wy + 2) + c) * m + swap] + (i - r - 1) + 1 + (j - c - 1)
                best[swap] = np.minimum(best[swap], cost)
            d[i + 1, j + 1] = best
            last_col = np.where(same & (b > 0), np.int16(j), last_col)
        last_row[a, every] = i
    return d[nx + 1, ny + 1, every]


def coded(names: list[str], width: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Names as rows of codes, and their lengths. Longer names are kept whole by widening the rows.

    The codes are small numbers given to the letters of these names as they come, so distinct letters never meet.
    """
    return coded_together([names], width)[0]


def coded_together(lists: list[list[str]], width: int = 24) -> list[tuple[np.ndarray, np.ndarray]]:
    """Several lists of names in one code; see ``coded``."""
    number: dict[str, int] = {}
    out = []
    for names in lists:
        wide = max([width, *map(len, names)]) if names else width
        codes, sizes = np.zeros((len(names), wide), np.int32), np.array([len(n) for n in names], np.int64)
        for i, name in enumerate(names):
            codes[i, : len(name)] = [number.setdefault(c, len(number) + 1) for c in name]
        out.append((codes, sizes))
    return out


def _distances_to(names: list[str], pivots: list[str], most_cells: int = 6_000_000) -> np.ndarray:
    """A row of Damerau-Levenshtein distances to all pivots for each name, in blocks by length."""
    out = np.zeros((len(names), len(pivots)), np.int16)
    order = sorted(range(len(names)), key=lambda i: len(names[i]))
    (codes, sizes), (py, pn) = coded_together([[names[i] for i in order], pivots], 1)
    at = 0
    while at < len(order):
        size = max(1, min(len(order) - at, most_cells // max(1, len(pivots) * (len(names[order[at]]) + 4) * (py.shape[1] + 2))))
        xs, xn = codes[at : at + size], sizes[at : at + size]
        x, y = np.repeat(np.arange(len(xs)), len(pivots)), np.tile(np.arange(len(pivots)), len(xs))
        out[order[at : at + size]] = edit_distances(xs[x, : xn.max()], xn[x], py[y], pn[y]).reshape(len(xs), len(pivots))
        at += size
    return out


def levenshtein_to(names: list[str], pivots: list[str]) -> np.ndarray:
    """A row of Levenshtein distances to all pivots for each name: a column of the table as bits of 64-bit words.

    The recurrence on vertical differences (Myers 1999), for all pivots at once, a word for each of a pivot's 64
    letters; the horizontal differences pass from word to word.
    """
    (codes, sizes), (py, pn) = coded_together([names, pivots], 1)
    one, top = np.uint64(1), np.uint64(63)
    words = -(-py.shape[1] // 64)
    masks = np.zeros((int(max(codes.max(initial=0), py.max(initial=0))) + 1, words, len(pivots)), np.uint64)
    for j in range(py.shape[1]):
        at = np.flatnonzero(j < pn)
        masks[py[at, j], j // 64, at] |= one << np.uint64(j % 64)
    last_word, last_bit = (pn - 1) // 64, ((pn - 1) % 64).astype(np.uint64)
    out = np.empty((len(names), len(pivots)), np.int16)
    order = np.argsort(sizes, kind="stable")
    block = max(1, 200_000 // max(1, len(pivots)))
    for start in range(0, len(order), block):
        own = order[start : start + block]
        n, shape = sizes[own], (len(own), len(pivots))
        pv, mv = [np.full(shape, ~np.uint64(0)) for _ in range(words)], [np.zeros(shape, np.uint64) for _ in range(words)]
        score = np.broadcast_to(pn, shape).astype(np.int16)
        for t in range(int(n.max(initial=0))):
            live = np.flatnonzero(n > t)[0]  # names are in order of length
            plus, minus = np.full((shape[0] - live, shape[1]), one), np.zeros((shape[0] - live, shape[1]), np.uint64)
            for w in range(words):
                p, m = pv[w][live:], mv[w][live:]
                eq = masks[codes[own[live:], t], w]
                xv = eq | m
                eq = eq | minus
                xh = (((eq & p) + p) ^ p) | eq
                ph, mh = m | ~(xh | p), p & xh
                ends = last_word == w
                if ends.any():
                    score[live:][:, ends] += ((ph[:, ends] >> last_bit[ends]) & one).astype(np.int16) - ((mh[:, ends] >> last_bit[ends]) & one).astype(np.int16)
                out_plus, out_minus = ph >> top, mh >> top
                ph, mh = (ph << one) | plus, (mh << one) | minus
                pv[w][live:], mv[w][live:] = mh | ~(xv | ph), ph & xv
                plus, minus = out_plus, out_minus
        out[own] = score
    return out


def letter_masks(codes: np.ndarray) -> np.ndarray:
    """The letters of each coded name as bits of a word; one edit changes two of them at most."""
    bits = np.where(codes > 0, np.uint64(1) << (codes % 64).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1) if codes.shape[1] else np.zeros(len(codes), np.uint64)


def within_one(x: np.ndarray, n: int, ys: np.ndarray, ns: np.ndarray) -> np.ndarray:
    """Whether each coded name is at distance 1 at most from x: exact, by common beginnings and ends."""
    width = ys.shape[1]
    x = np.pad(x[:width], (0, max(0, width - len(x))))
    same = ys == x
    head = np.minimum(np.where(same.all(axis=1), width, np.argmin(same, axis=1)), np.minimum(n, ns))
    back = np.arange(1, width + 1)
    xr = x[(n - back) % width]
    yr = ys[np.arange(len(ys))[:, None], (ns[:, None] - back[None, :]) % width]
    equal = (xr[None, :] == yr) & (back[None, :] <= np.minimum(n, ns)[:, None])
    tail = np.where(equal.all(axis=1), width, np.argmin(equal, axis=1))
    longest = np.maximum(n, ns)
    one = (np.abs(ns - n) <= 1) & (head + tail >= longest - 1)
    h = np.clip(head, 0, width - 2)
    rows = np.arange(len(ys))
    swapped = (ns == n) & (head + tail == n - 2) & (ys[rows, h] == x[h + 1]) & (ys[rows, h + 1] == x[h])
    return one | swapped


def radius_pairs(names: DataFrame, name: str = "name", most_pivots: int = 1500) -> DataFrame:
    """(a, b), a < b: every pair of different names at a Damerau-Levenshtein distance of 1. Exact.

    Metric-space partitioning under the Levenshtein distance: about the square root of the number of names, at most
    ``most_pivots`` and bounded thus in size, serve as pivots. Every name is at home at its nearest pivot p and a guest
    at each pivot q with d(x, q) <= d(x, p) + 2, for by the triangle inequality a name within 1 of a resident of q
    can't be farther. In a cell, residents meet all its names whose distance from the pivot and whose length differ by
    1 at most. A cell of more than MOST_CELL_ROWS names is cut into stripes, and each pair of stripes is a task of its
    own, so no task holds more than two stripes, whatever the skew. Two letters swapped are one edit but two of that
    metric's; those pairs have the same letters, and ``swapped_pairs`` finds them.

    Defined cases: null and empty names have no pairs, repeated names are one; no names give no rows.
    """
    spark = names.sparkSession
    distinct = cut(names.select(F.col(name).alias("name")).filter("name is not null and name <> ''").distinct())
    n = distinct.count()
    size = min(most_pivots, max(1, math.isqrt(n)))
    pivots = [r["name"] for r in distinct.orderBy(F.xxhash64("name"), "name").limit(size).collect()]
    if not pivots:
        return spark.createDataFrame([], "a string, b string")
    shared = spark.sparkContext.broadcast(pivots)

    def assign(frames):
        for frame in frames:
            own = frame["name"].tolist()
            for at in range(0, len(own), 4000):
                part = own[at : at + 4000]
                d = levenshtein_to(part, shared.value)
                near = d.argmin(axis=1)
                guest = d <= d[np.arange(len(part)), near][:, None] + 2
                x, cell = np.nonzero(guest)
                yield pd.DataFrame({"cell": cell.astype(np.int32), "name": np.array(part, object)[x], "d": d[x, cell].astype(np.int32), "home": near[x] == cell})

    members = cut(distinct.repartition(max(1, min(2000, n // 500))).mapInPandas(assign, "cell int, name string, d int, home boolean"))
    sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / MOST_CELL_ROWS).cast("int").alias("k"))
    striped = members.join(F.broadcast(sizes), "cell").withColumn("s", F.pmod(F.xxhash64("name"), F.col("k")).cast("int"))
    # Stripe s meets every stripe t: the task of (s, t) is that of (smaller, larger).
    met = striped.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("cell", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "name", "d", "home")

    def join(_, frame):
        own = frame["name"].to_numpy(object)
        codes, sizes = coded(list(own))
        masks = letter_masks(codes)
        d, home = frame["d"].to_numpy(), frame["home"].to_numpy()
        a, b = [], []
        order = np.lexsort((sizes, d))
        own, codes, sizes, d, home, masks = own[order], codes[order], sizes[order], d[order], home[order], masks[order]
        ends = np.searchsorted(d, np.stack([d - 1, d + 2]))
        for x in np.flatnonzero(home):
            lo, hi = ends[:, x]
            ok = np.flatnonzero((np.bitwise_count(masks[lo:hi] ^ masks[x]) <= 2) & (np.abs(sizes[lo:hi] - sizes[x]) <= 1)) + lo
            if len(ok) > 1:
                for y in ok[within_one(codes[x], int(sizes[x]), codes[ok], sizes[ok])]:
                    if own[x] != own[y]:
                        a.append(min(own[x], own[y]))
                        b.append(max(own[x], own[y]))
        return pd.DataFrame({"a": a, "b": b}, dtype=object)

    return met.groupBy("cell", "i", "j").applyInPandas(join, "a string, b string").unionByName(swapped_pairs(distinct)).distinct()


def swapped_pairs(names: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of different ``name`` that two neighbouring letters swapped make equal.

    Only names that share their letters with another are looked at. Each gives, for each place, itself with the two
    letters there in order: at one place at most two names give the same text, so no group is more than a pair.
    """
    lettered = names.select("name", F.array_join(F.array_sort(F.split("name", "")), "").alias("bag"))
    several = lettered.groupBy("bag").agg(F.count("*").alias("n")).filter("n > 1").select("bag")
    places = lettered.join(several, "bag", "left_semi").filter("char_length(name) > 1").select("name", F.explode(F.expr("sequence(1, char_length(name) - 1)")).alias("i"))
    one, two = F.expr("substring(name, i, 1)"), F.expr("substring(name, i + 1, 1)")
    keyed = places.filter(one != two).select("name", "i", F.concat(F.expr("substring(name, 1, i - 1)"), F.least(one, two), F.greatest(one, two), F.expr("substring(name, i + 2)")).alias("at"))
    return keyed.groupBy("i", "at").agg(F.min("name").alias("a"), F.max("name").alias("b")).filter("a <> b").select("a", "b")


def spellings(entries: DataFrame, key: str, name: str, page: str) -> DataFrame:
    """(entry, n, page, kind, first, last, plain_first, plain_last) of each distinct (name, page) with a non-empty name."""

    def parse(frames):
        for frame in frames:
            parts = [(*name_parts(x), *name_parts(x, unmarked)[1:]) for x in frame["name"]]
            out = frame[["entry", "n"]].copy()
            out["page"] = [page_title(x) if isinstance(x, str) else None for x in frame["page"]]
            for i, column in enumerate(("kind", "first", "last", "plain_first", "plain_last")):
                out[column] = [x[i] for x in parts]
            yield out

    found = entries.filter(F.col(name).isNotNull() & F.col(name).rlike(r"(?U)\S")).groupBy(F.col(name).alias("name"), F.col(page).alias("page")).agg(F.min(key).alias("entry"), F.count("*").alias("n"))
    return found.select("entry", "n", "page", "name").mapInPandas(parse, "entry long, n long, page string, kind string, first string, last string, plain_first string, plain_last string")


def oriented(rows: DataFrame) -> DataFrame:
    """Full names with their parts in order: the first name is what is more often a first part, over distinct spellings."""
    parts = F.array(F.struct(F.col("first").alias("w"), F.lit(1).alias("f")), F.struct(F.col("last").alias("w"), F.lit(0).alias("f")))
    uses = rows.select(F.explode(parts).alias("u")).groupBy("u.w").agg((F.sum("u.f") / F.count("*")).alias("share"))
    both = rows.join(uses.select(F.col("w").alias("first"), F.col("share").alias("s1")), "first").join(uses.select(F.col("w").alias("last"), F.col("share").alias("s2")), "last")
    turn = F.col("s2") > F.col("s1")
    swap = lambda x, y: [F.when(turn, F.col(y)).otherwise(F.col(x)).alias(x), F.when(turn, F.col(x)).otherwise(F.col(y)).alias(y)]
    return both.select("entry", "n", "page", "kind", *swap("first", "last"), *swap("plain_first", "plain_last"))


def _shared(x: str, y: str, place) -> F.Column:
    """The number of letters that two texts share at one end."""
    most = F.least(F.length(x), F.length(y))
    return F.array_max(F.filter(F.sequence(F.lit(0), most), lambda i: place(F.col(x), i) == place(F.col(y), i)))


def _begin(c, i):
    return F.substring(c, F.lit(1), i)


def _end(c, i):
    return F.substring(c, F.length(c) - i + 1, i)


def learned_short_forms(full: DataFrame, least_share: float = 0.05, least_pages: int = 3) -> tuple[list[str], list[str], DataFrame]:
    """What first names one person goes by, learned from spellings with one page and one last name.

    ``full`` is (page, first, folded, last, n), ``first`` as it is spelled. Each first name that isn't within one edit
    of the page's most frequent one, folded or not, is a pair with it. Returned are the endings put in place of a longer name's end, the beginnings put in place of its
    beginning (two letters at least stay), and the pairs (first, other) of two pages or more. An ending or beginning
    is learned from ``least_pages`` pages and ``least_share`` of all with such pairs, so there are 20 of a kind at
    most, whatever the size.
    """
    paged = full.filter("page is not null").groupBy("page", "last", "first", "folded").agg(F.sum("n").alias("n"))
    main = paged.groupBy("page", "last").agg(F.max_by(F.struct("first", "folded"), F.struct("n", "first")).alias("m")).select("page", "last", F.col("m.first").alias("main"), F.col("m.folded").alias("main_folded"))
    letters = lambda c: F.array_sort(F.split(c, ""))
    apart = (F.levenshtein("first", "main") > 1) & (F.levenshtein("folded", "main_folded") > 1) & (letters("first") != letters("main")) & (letters("folded") != letters("main_folded"))
    pairs = cut(paged.join(main, ["page", "last"]).filter(apart).select("page", "main", F.col("first").alias("short")).distinct())
    known = pairs.groupBy("short", "main").agg(F.count_distinct("page").alias("k")).filter("k >= 2").select(F.col("short").alias("first"), F.col("main").alias("other"))
    total = pairs.select("page").distinct().count()
    rules = []
    for place in (_begin, _end):
        same = _shared("main", "short", place)
        rest = F.expr("substring(short, same + 1)") if place is _begin else F.expr("substring(short, 1, length(short) - same)")
        counted = pairs.withColumn("same", same).filter("same >= 2").select("page", rest.alias("rest")).filter("rest <> ''").groupBy("rest").agg(F.count_distinct("page").alias("k"))
        rules.append(sorted(r["rest"] for r in counted.filter((F.col("k") >= least_pages) & (F.col("k") >= least_share * total)).collect()))
    return rules[0], rules[1], known


def _short_links(people: DataFrame, endings: list[str], beginnings: list[str], known: DataFrame) -> DataFrame:
    """(group, to): groups without page whose short or other first name leads to one other group of the last name.

    ``people`` is (group, page, first, last), first names as they are spelled. A short form gives its stem, a longer name all its beginnings and ends,
    and they meet by last name and stem; learned pairs meet by the other name. A stem has no more short forms than
    there are endings, so no pairs arise within a group of one last name.
    """
    several = people.groupBy("last").agg(F.min("first").alias("x"), F.max("first").alias("y")).filter("x <> y").select("last")
    own = cut(people.join(several, "last", "left_semi"))
    none = F.array().cast("array<string>")
    inner = lambda place, mark: F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.length("first") - 1, F.lit(2))), lambda i: i < F.length("first")), lambda i: F.concat(F.lit(mark), place(F.col("first"), i)))
    long = F.concat(F.array(F.concat(F.lit("="), "first")), inner(_begin, ">"), inner(_end, "<"))
    cut_end = [F.when(F.col("first").endswith(e) & (F.length("first") >= len(e) + 2), F.concat(F.lit(">"), F.expr(f"substring(first, 1, length(first) - {len(e)})"))) for e in endings]
    cut_begin = [F.when(F.col("first").startswith(b) & (F.length("first") >= len(b) + 2), F.concat(F.lit("<"), F.expr(f"substring(first, {len(b) + 1})"))) for b in beginnings]
    stems = F.filter(F.array(*cut_end, *cut_begin), lambda x: x.isNotNull()) if endings or beginnings else none
    longs = own.select("last", F.col("group").alias("to"), F.col("page").alias("to_page"), F.col("first").alias("to_first"), F.explode(long).alias("at"))
    shorts = own.select("last", "group", "page", "first", F.explode(stems).alias("at"))
    shorts = shorts.unionByName(own.join(known, "first").select("last", "group", "page", "first", F.concat(F.lit("="), "other").alias("at")))
    met = shorts.join(longs, ["last", "at"]).filter("group <> to and not (page is not null and to_page is not null)")
    met = met.select("group", "page", "to", "to_page").unionByName(met.select(F.col("to").alias("group"), F.col("to_page").alias("page"), F.col("group").alias("to"), F.col("page").alias("to_page")))
    return met.filter("page is null").groupBy("group").agg(F.min("to").alias("to"), F.max("to").alias("other")).filter("to = other").select("group", "to")


def persons(entries: DataFrame, key: str = "entry_id", name: str = "name", page: str = "wikititle") -> DataFrame:
    """(entry, page, person): each spelling, a distinct (name, page) by its smallest key, with the person it means.

    Names are read in two ways, without case, marks, address and nicknames in quotation marks, and with respelled
    sounds folded besides; their parts are put in order, and names at distance 1 in either way are neighbours
    (``radius_pairs``). Spellings with one page are of one person, those with two pages never are. Of two neighbours
    the rarer name joins the more frequent one, unless that would bring two pages together. A person without page joins
    the only other person of the last name whose first name is a known short or other form of its own
    (``learned_short_forms``). A name with an initial joins the only person of its last name and letter; where there
    are several it stays apart.

    Defined cases: null and blank names are no spellings; repeated rows count once; names of several pages link to
    none of them without one; ties of neighbours go to the more frequent, then the smaller name; short forms of short
    forms are followed twice.
    """
    rows = written(spellings(entries, key, name, page), "spellings")
    node = F.when(F.col("kind") == "full", F.concat_ws(" ", "first", "last")).otherwise(F.concat_ws("|", "kind", "first", "last"))
    full, other = rows.filter("kind = 'full'"), rows.filter("kind <> 'full'")
    rows = cut(oriented(full).unionByName(other).withColumn("node", node).withColumn("plain", F.concat_ws(" ", "plain_first", "plain_last")))

    # Names: how frequent, of which pages (two are as good as many).
    names = cut(rows.groupBy("node", "kind", "first", "last").agg(F.sum("n").alias("n"), F.min("page").alias("page"), F.max("page").alias("other"), F.max_by(F.substring("plain_first", 1, 1), F.struct("n", "entry")).alias("letter")))
    known = names.filter("kind = 'full'").select("node", "n", "page", "other")
    ways = cut(rows.filter("kind = 'full'").select("node", F.explode(F.array("node", "plain")).alias("text")).distinct())
    near = radius_pairs(ways, "text")
    one, two = ways.select(F.col("text").alias("a"), F.col("node").alias("x")), ways.select(F.col("text").alias("b"), F.col("node").alias("y"))
    near = cut(near.join(one, "a").join(two, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    a, b = known.toDF("a", "na", "pa", "oa"), known.toDF("b", "nb", "pb", "ob")
    single = "coalesce(pa = oa, true) and coalesce(pb = ob, true) and coalesce(pa = pb, true)"
    rarer = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    centre = both.join(a, "a").join(b, "b").filter(rarer & F.expr(single)).groupBy("a", "pa").agg(F.max_by("b", F.struct("nb", "b")).alias("b"), F.max_by("pb", F.struct("nb", "b")).alias("pb"))
    # A name without page that several neighbours of different pages would join is left to those without one.
    brought = centre.groupBy("b").agg(F.min("pa").alias("p1"), F.max("pa").alias("p2"))
    centre = centre.join(brought, "b").filter("pa is null or pb is not null or p1 = p2").select("a", "b")
    mark = lambda kind, c: F.concat(F.lit(kind), c)
    edge = lambda df, x, y: df.select(x.alias("x"), y.alias("y"))
    named, paged = mark("n:", F.col("node")), mark("p:", F.col("page"))
    edges = edge(names, named, F.when(F.col("page") == F.col("other"), paged).otherwise(named))
    edges = edges.unionByName(edge(centre, mark("n:", F.col("a")), mark("n:", F.col("b")))).unionByName(edge(rows.filter("page is not null"), paged, paged))
    groups = cut(connected_groups(edges, "x", "y"))

    # Short and other forms of first names.
    page_of = groups.filter("node like 'p:%'").groupBy("group").agg(F.min("node").alias("page"))
    of_name = cut(names.select("node", "kind", "first", "last", "letter", named.alias("at")).join(groups.withColumnRenamed("node", "at"), "at").join(page_of, "group", "left"))
    spelt = rows.filter("kind = 'full'").select("node", "page", F.col("plain_first").alias("first"), F.col("first").alias("folded"), "last", "n")
    endings, beginnings, pairs = learned_short_forms(spelt)
    people = spelt.select("node", "first", "last").distinct().join(of_name.select("node", "group", "page"), "node").select("group", "page", "first", "last").distinct()
    links = cut(_short_links(people, endings, beginnings, pairs))
    # A link's own link is followed; of two groups linked to each other the smaller stays.
    links = links.join(links.select(F.col("group").alias("to"), F.col("to").alias("on")), "to", "left").filter("on is null or on <> group or to < group")
    links = cut(links.select("group", F.when(F.col("on") == F.col("group"), F.col("to")).otherwise(F.coalesce("on", "to")).alias("to")))

    # Initials.
    whole = of_name.join(links, "group", "left").select("kind", "last", "letter", "page", "group", F.coalesce("to", "group").alias("person"))
    alone = whole.filter("kind = 'full'").groupBy("last", "letter").agg(F.min("person").alias("to"), F.max("person").alias("other")).filter("to = other").select("last", "letter", "to")
    initials = whole.filter("kind = 'initial' and page is null").join(alone, ["last", "letter"]).groupBy("group").agg(F.min("to").alias("to"), F.max("to").alias("other")).filter("to = other and to <> group").select("group", "to")
    links = links.unionByName(initials.join(links, "group", "left_anti"))
    final = groups.join(links, "group", "left").select(F.col("node").alias("at"), F.coalesce("to", "group").alias("person"))

    # A spelling with a page belongs to the page's person, one without to its name's.
    at = F.when(F.col("page").isNotNull(), paged).otherwise(named)
    return rows.select("entry", "page", at.alias("at")).join(final, "at").select("entry", "page", "person")


def same_person(entries: DataFrame, key: str = "entry_id", name: str = "name", page: str = "wikititle") -> DataFrame:
    """(entry_a, entry_b), entry_a < entry_b: the members of each person (see ``persons``) as pairs, none of two pages."""
    placed = cut(persons(entries, key, name, page))
    a, b = placed.toDF("entry_a", "page_a", "person"), placed.toDF("entry_b", "page_b", "person")
    return a.join(b, "person").filter("entry_a < entry_b and coalesce(page_a = page_b, true)").select("entry_a", "entry_b")
