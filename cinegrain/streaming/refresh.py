"""Incremental refresh as a stream: landed pages go into a versioned table of each page's newest version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinegrain.operators.incremental import StateStore, merge_buckets, read_buckets
from cinegrain.session import cut, scratch_path

COLUMNS = ["pageid", "revid", "fetchedat", "title"]


def newest_of(pages: DataFrame) -> DataFrame:
    """(pageid, revid, fetchedat, title): each page's row with the highest revid, then the latest fetch."""
    at = F.expr("try_cast(fetchedat as timestamp)")
    best = F.max_by(F.struct(*COLUMNS), F.struct(F.coalesce(F.col("revid"), F.lit(-1)), at, F.col("title")))
    return pages.filter("pageid is not null and not coalesce(missing, false)").groupBy("pageid").agg(best.alias("r")).select("r.*")


def refresh_stream(spark: SparkSession, source: str, schema: StructType, store: StateStore, checkpoint: str, files_per_batch: int = 100) -> None:
    """Take in what has landed since the last run and stop.

    Each batch is merged with the buckets of the valid state that it touches, and these are swapped in at once. A batch
    that is repeated after a failure merges to the same state, so no page is skipped or counted twice.
    """
    held = StructType([schema[c] for c in COLUMNS])

    def newest(old: DataFrame, fresh: DataFrame) -> DataFrame:
        return newest_of(old.unionByName(fresh).withColumn("missing", F.lit(False)))

    def merge(batch: DataFrame, _: int) -> None:
        fresh = cut(newest_of(batch))
        if fresh.head(1):
            merge_buckets(store, held, fresh, "pageid", newest)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_refresh(spark: SparkSession, source: str) -> DataFrame:
    """The state after one run over a folder of landed files."""
    schema = spark.read.parquet(source).schema
    store = StateStore(spark, scratch_path(spark, "refresh-state"))
    refresh_stream(spark, source, schema, store, scratch_path(spark, "refresh-offsets"))
    return read_buckets(store, StructType([schema[c] for c in COLUMNS])).select(*COLUMNS)


def changes_since(feed: DataFrame, last_day: str | None, today: str, back: int = 14) -> DataFrame:
    """Distinct (kind, id) of a dated change feed from the day after the last run, at most ``back`` days ago."""
    first = F.date_sub(F.lit(today).cast("date"), back)
    start = F.greatest(first, F.date_add(F.lit(last_day).cast("date"), 1)) if last_day else first
    return feed.filter(F.col("day").between(start, F.lit(today).cast("date"))).select("kind", "id").distinct()
