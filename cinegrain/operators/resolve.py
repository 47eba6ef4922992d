"""Resolution across redirects, credits, slugs and categories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegrain.operators.delta import group_rank
from cinegrain.session import cut


def first_edges(redirects: DataFrame) -> DataFrame:
    """(from_title, to_title): the first edge of each title by ord; edges without an end are no edges."""
    edges = redirects.filter("from_title <> '' and to_title <> ''")
    return edges.groupBy("from_title").agg(F.min_by("to_title", F.struct("ord", "to_title")).alias("to_title"))


def _jumped(known: DataFrame, end: str, times: int = 3) -> DataFrame:
    """(from_title, at, ``end``) after ``times`` more jumps by the same table: each title points (times + 1) as far on.

    A title without a row of its own is an end and stays; ``end`` says of the last jump whether it found a row, or
    whether that row is marked. The table has one row per title, so a title that many point to can be split.
    """
    for i in range(times):
        on = known.select(F.col("from_title").alias("at"), F.col("at").alias("_on"), F.col(end).alias("_end"))
        stepped = (known if not i else stepped).drop(end).join(on, "at", "left")
        stepped = stepped.select("from_title", F.coalesce("_on", "at").alias("at"), F.coalesce("_end", F.lit(True)).alias(end))
    return stepped


def resolve_titles(redirects: DataFrame) -> DataFrame:
    """(from_title, final_title): each title followed along first edges to the end or to before a repeat.

    Pointer jumping: after round k a title points 4**k edges on, so chains settle in a logarithmic number of rounds.
    What doesn't settle leads into a cycle. The titles such jumps end at are the cycles themselves as soon as the next
    edge maps them one to one; every walk then ends before the title of the cycle it meets first, which a second
    pointer jumping finds. No path is ever gathered.
    """
    edges = cut(first_edges(redirects))
    known = edges.select("from_title", F.col("to_title").alias("at"), F.lit(False).alias("settled"))
    after = edges.select(F.col("from_title").alias("at"), "to_title")
    while True:
        known = cut(_jumped(known, "settled").withColumn("settled", F.lit(False)).join(after.select("at", F.lit(True).alias("_more")), "at", "left").select("from_title", "at", F.col("_more").isNull().alias("settled")))
        done = known.filter("settled").select("from_title", F.col("at").alias("final_title"))
        ring = known.filter("not settled").select("at").distinct().join(after, "at").select(F.col("at").alias("from_title"), "to_title")
        n, onto = ring.agg(F.count("*"), F.count_distinct("to_title")).first()
        if not n:
            return done
        # Chains still on their way would end at titles whose next edge leads to others yet, or to an end.
        if n == onto and not ring.select(F.col("to_title").alias("from_title")).join(ring, "from_title", "left_anti").head(1):
            break
    ring = cut(ring)
    before = ring.select(F.col("to_title").alias("at"), F.col("from_title").alias("final_title"))
    # The first title of a cycle on each walk: titles of cycles stay where they are.
    tails = known.filter("not settled").select("from_title").join(ring, "from_title", "left_anti").join(edges, "from_title")
    walk = ring.select("from_title", F.col("from_title").alias("at"), F.lit(True).alias("inside")).unionByName(tails.select("from_title", F.col("to_title").alias("at"), F.lit(False).alias("inside")))
    while walk.filter("not inside").head(1):
        walk = cut(_jumped(walk, "inside"))
    return done.unionByName(walk.join(before, "at").select("from_title", "final_title"))


def canonical(df: DataFrame, resolved: DataFrame, title: str) -> DataFrame:
    """The rows with ``canonical``: the title at the end of redirects, or the title itself."""
    ends = resolved.select(F.col("from_title").alias(title), F.col("final_title").alias("_end"))
    return df.join(ends, title, "left").withColumn("canonical", F.coalesce("_end", title)).drop("_end")


def page_ids(wanted: DataFrame, resolved: DataFrame, pages: DataFrame, title: str) -> DataFrame:
    """(title, canonical, pageid) of each wanted title: the page at the end of redirects, -1 where there is none.

    ``pages`` is (title, pageid); of several pages of one title the least id counts. Null titles have no row.
    """
    ends = canonical(wanted.filter(F.col(title).isNotNull()).select(title).distinct(), resolved, title)
    ids = pages.groupBy(F.col("title").alias("canonical")).agg(F.min("pageid").alias("pageid"))
    return ends.join(ids, "canonical", "left").select(title, "canonical", F.coalesce("pageid", F.lit(-1)).cast("bigint").alias("pageid"))


def unique_names(people: DataFrame, name: str, key: str) -> DataFrame:
    """(name, key) of names that one key alone has."""
    return people.filter(F.col(name).isNotNull()).groupBy(name).agg(F.min(key).alias(key), F.max(key).alias("_other")).filter(F.col(key) == F.col("_other")).drop("_other")


def first_credits(cast: DataFrame, crew: DataFrame) -> DataFrame:
    """(person, pageid, role): for each person and title the first cast entry, else the first crew entry."""
    both = cast.select("person", "pageid", "role", F.lit(0).alias("tier"), "ord").unionByName(crew.select("person", "pageid", "role", F.lit(1).alias("tier"), "ord"))
    return both.filter("person is not null").groupBy("person", "pageid").agg(F.min_by("role", F.struct("tier", "ord", "role")).alias("role"))


def issue_slugs(records: DataFrame, base: str, order: list[str]) -> DataFrame:
    """The records with ``slug``: the base, or the base with the first free -2, -3, ... in the total order.

    All issued slugs count, so a natural ``x-2`` can take the place of a second ``x``. A base and its followers stay
    within the family of the base without trailing numbers, so families are issued apart from each other. In a family
    of one base that has no number itself nothing can come in between, so its records are numbered by their rank, which
    ranges give: a base of any size is spread over tasks. Only families of several bases are read in order, each by one
    task that keeps its set of issued slugs.
    """
    root = F.regexp_replace(base, r"(?:-\d+)+$", "")
    rows = records.withColumn("_family", root)
    bases = rows.groupBy("_family").agg(F.min(base).alias("_least"), F.max(base).alias("_most"))
    plain = bases.filter("_least = _most and _least = _family").select(F.col("_family").alias("_plain"))
    alone = rows.join(plain, F.col("_family") == F.col("_plain"), "left_semi")
    ranked = group_rank(alone, ["_family"], [F.col(c) for c in order])
    number = F.when(F.col("rank") == 0, F.col(base)).otherwise(F.concat(base, F.lit("-"), (F.col("rank") + 1).cast("string")))
    easy = ranked.withColumn("slug", number).select(*records.columns, "slug")
    hard = rows.join(plain, F.col("_family") == F.col("_plain"), "left_anti")
    return easy.unionByName(_in_order(hard, base, order))


def _in_order(rows: DataFrame, base: str, order: list[str]) -> DataFrame:
    """Slugs of the records of each family, issued one after the other."""
    parts = rows.repartition("_family").sortWithinPartitions("_family", *order)
    schema = T.StructType([*parts.schema.fields, T.StructField("slug", T.StringType())])

    def run(frames):
        family, taken, following = None, set(), {}
        for frame in frames:
            out = []
            for own, b in zip(frame["_family"], frame[base]):
                if own != family:
                    family, taken, following = own, set(), {}
                slug, n = b, following.get(b, 2)
                while slug in taken:
                    slug = f"{b}-{n}"
                    n += 1
                following[b] = n
                taken.add(slug)
                out.append(slug)
            frame = frame.copy()
            frame["slug"] = pd.Series(out, index=frame.index, dtype=object)
            yield frame

    return parts.mapInPandas(run, schema).drop("_family")


def category_walk(members: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(node, level): what is reached from the roots along (parent, child) within ``depth`` steps, at its first level."""
    seen = cut(roots.select("node", F.lit(0).alias("level")).distinct())
    front = seen
    for level in range(1, depth + 1):
        found = front.join(members, front["node"] == members["parent"]).select(F.col("child").alias("node")).distinct()
        front = found.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level))
        seen = cut(seen.unionByName(front))
        front = seen.filter(F.col("level") == level)
    return seen


def merge_ranked(sources: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union of sources in priority order; each key keeps its row of the first source (and first in order)."""
    both = None
    for rank, df in enumerate(sources):
        part = df.withColumn("source_rank", F.lit(rank))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("source_rank", *order))
    return both.withColumn("_p", place).filter("_p = 1").drop("_p")


def admitted(walk: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Watchlist entries that the walk lacks, once per title and once per page id, the first listed wins."""
    fresh = watchlist.filter("title <> '' and pageid > 0").join(walk.select("title"), "title", "left_anti")
    by_title = fresh.withColumn("_t", F.row_number().over(Window.partitionBy("title").orderBy("ord"))).filter("_t = 1")
    return by_title.withColumn("_p", F.row_number().over(Window.partitionBy("pageid").orderBy("ord"))).filter("_p = 1").drop("_t", "_p")
