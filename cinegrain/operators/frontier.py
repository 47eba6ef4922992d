"""Waves that follow links from accepted pages, with the state of every page met."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegrain.session import cut


def expand(seeds: DataFrame, links: DataFrame, verdicts: DataFrame, waves: int) -> DataFrame:
    """(node, status, wave, refs): what is reached from ``seeds`` (node) over ``links`` (source, target).

    Seeds are accepted in wave 0. Each wave judges the targets of the pages accepted in the wave before that aren't in
    the state yet: their status is that of ``verdicts`` (node, status), or missing without one. Only accepted pages are
    followed. ``refs`` counts the different accepted pages that link to a page and were followed. The state grows by
    one checkpointed table a wave; links meet a distinct list of nodes, so hot targets are counted before they move.
    It ends early when a wave accepts none. Null nodes and ends don't count, repeats count once.
    """
    links = cut(links.filter("source is not null and target is not null").select("source", "target").distinct())
    judged = verdicts.filter("node is not null").groupBy("node").agg(F.min("status").alias("status"))
    state = cut(seeds.filter("node is not null").select("node").distinct().select("node", F.lit("accepted").alias("status"), F.lit(0).alias("wave")))
    front = state.select("node")
    for wave in range(1, waves + 1):
        met = links.join(front.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        fresh = met.join(state.select("node"), "node", "left_anti").join(judged, "node", "left")
        fresh = cut(fresh.select("node", F.coalesce("status", F.lit("missing")).alias("status"), F.lit(wave).alias("wave")))
        state = state.unionByName(fresh)
        front = fresh.filter("status = 'accepted'").select("node")
        if not front.head(1):
            break
    followed = state.filter((F.col("status") == "accepted") & (F.col("wave") < waves)).select(F.col("node").alias("source"))
    refs = links.join(followed, "source", "left_semi").groupBy(F.col("target").alias("node")).agg(F.count("*").alias("refs"))
    return state.join(refs, "node", "left").select("node", "status", "wave", F.coalesce("refs", F.lit(0)).cast("bigint").alias("refs"))


def rejudge(state: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(node, status, was) of the accepted and rejected pages of a state whose present verdict is another."""
    old = state.filter("status in ('accepted', 'rejected')").select("node", F.col("status").alias("was"))
    return old.join(verdicts.groupBy("node").agg(F.min("status").alias("status")), "node").filter("status <> was").select("node", "status", "was")
