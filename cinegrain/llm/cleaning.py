"""Markup residue in text documents: the kept elements of every text, and differencing of neighbouring pages."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegrain.llm.elements import elements
from cinegrain.session import cut

_FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("content", T.StringType())]))
_FOUND_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("pos", pa.int64()), ("content", pa.string())]))


def numbered(found: list[tuple[str, str]]) -> list[dict]:
    """Elements with their position among those of their kind, from 1."""
    seen: dict[str, int] = {}
    out = []
    for kind, content in found:
        seen[kind] = pos = seen.get(kind, 0) + 1
        out.append({"kind": kind, "pos": pos, "content": content})
    return out


def text_elements(texts: DataFrame) -> DataFrame:
    """(src, row_id, kind, pos, content) of every element kept in ``texts`` (src, row_id, markup, text).

    ``markup`` names the markup of a text, null tells it from the text. Whole texts are read in one narrow pass; only
    the elements, a fraction of the text, are shuffled to drop repeated rows.

    Defined cases: a null or empty text has no rows, as has one without markup; a row given twice counts once (of
    rows that share src and row_id but not the text, the greatest list of elements); rows with a null row_id are treated as one row.
    """

    def run(batches):
        for batch in batches:
            found = [numbered(elements(t, m)) for m, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _FOUND_ARROW)], names=["src", "row_id", "found"])

    schema = T.StructType([T.StructField("src", T.StringType()), T.StructField("row_id", T.LongType()), T.StructField("found", _FOUND)])
    rows = texts.select("src", "row_id", "markup", "text").filter("text is not null and text <> ''").mapInArrow(run, schema)
    once = rows.filter("size(found) > 0").groupBy("src", "row_id").agg(F.max("found").alias("found"))
    return once.select("src", "row_id", F.explode("found").alias("e")).select("src", "row_id", "e.kind", "e.pos", "e.content")


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """The places in ``a`` of a longest common subsequence of two lists of lines (Hunt and Szymanski)."""
    places: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    ends: list[int] = []
    links: list[tuple | None] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, at = set(), links[-1] if links else None
    while at:
        out.add(at[0])
        at = at[1]
    return out


def page_differences(pages: DataFrame, key: str, host: str, path: str, text: str) -> DataFrame:
    """(key, near_key, n_lines, n_shared, text): each page without the lines it shares with the nearest page.

    The nearest page is the neighbour in path order within the host: the nearest other path before, for pages of the
    first path the one after; of a path's pages its last, the one with the greatest key, stands for it. Paths are
    range partitioned and sorted, so a host of any size is spread over tasks. What a partition needs from others is the
    last path before it and the first after it, and these go by one row per host and partition: its first and last path.

    Defined cases: a page alone in its host, or whose host has one path, keeps its text, with a null near_key; null
    texts are left out; null hosts and paths are values; repeated rows are pages of one path and not compared.
    """

    def run(frames):
        for frame in frames:
            out = []
            for k, mine, near, other in frame.itertuples(index=False, name=None):
                lines = mine.split("\n")
                stripped = [x.strip() for x in lines]
                kept = [i for i, x in enumerate(stripped) if x]
                has = near is not None and near == near
                shared = {kept[i] for i in shared_lines([stripped[i] for i in kept], [x.strip() for x in other.split("\n") if x.strip()])} if has else set()
                out.append((k, near if has else None, len(kept), len(shared), "\n".join(x for i, x in enumerate(lines) if i not in shared)))
            yield pd.DataFrame(out, columns=["key", "near", "n", "s", "t"])

    rows = pages.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.col(text).alias("text"))
    near = neighbours(rows.groupBy("host", "path").agg(F.max("key").alias("last")))
    # Texts are moved by key alone: once to their page, once to the neighbour's key, and those that stand for a path.
    whose = rows.select("key", "host", "path").join(near, ["host", "path"], "left").groupBy("key").agg(F.max("near").alias("other_key"))
    stands = near.select(F.col("near").alias("other_key")).distinct()
    other = rows.select(F.col("key").alias("other_key"), F.col("text").alias("other")).join(stands, "other_key", "left_semi").groupBy("other_key").agg(F.max("other").alias("other"))
    pairs = rows.select("key", "text").join(whose, "key", "left").join(other, "other_key", "left").select(F.col("key").cast("string").alias("key"), "text", F.col("other_key").cast("string").alias("near"), "other")
    found = pairs.mapInPandas(run, "key string, near string, n long, s long, t string")
    kind = pages.schema[key].dataType
    return found.select(F.col("key").cast(kind).alias(key), F.col("near").cast(kind).alias(f"near_{key}"), F.col("n").alias("n_lines"), F.col("s").alias("n_shared"), F.col("t").alias("text"))


def neighbours(paths: DataFrame) -> DataFrame:
    """(host, path, near_path, near): the path before within the host, for the first one the path after, with its last key.

    ``paths`` is (host, path, last), one row per path. Range partitions are read as streams; the path before a
    partition's first and the one after its last come from the other partitions' ends, one row per host and partition.
    """
    kind = paths.schema["last"].dataType
    ordered = cut(paths.repartitionByRange("host", "path").sortWithinPartitions("host", "path").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    # A partition's rows are numbered in order, and the numbers rise from partition to partition.
    inner = Window.partitionBy("part", "host").orderBy("at")
    seen = ordered.withColumn("b", F.lag(F.struct("path", "last")).over(inner)).withColumn("a", F.lead(F.struct("path", "last")).over(inner))
    ends = ordered.groupBy("host", "part").agg(F.min_by(F.struct("path", "last"), "at").alias("first"), F.max_by(F.struct("path", "last"), "at").alias("end"))
    by_host = Window.partitionBy("host").orderBy("part")
    ends = ends.select("host", "part", F.lag("end").over(by_host).alias("before"), F.lead("first").over(by_host).alias("after"))
    near = F.coalesce("b", "before", "a", "after")
    return seen.join(ends, ["host", "part"]).select("host", "path", near["path"].alias("near_path"), near["last"].cast(kind).alias("near"))
