"""Reading landed files and writing the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrain.functions.scalars import bucket_key
from cinegrain.session import cut, hadoop_path

PAGE_SCHEMA = "pageid bigint, title string, wikitext string, thumb string, extract string, missing boolean, fetchedat string, revid bigint"
WATCH_SCHEMA = "title string, pageid bigint, kind string, admittedat string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Cached pages from JSON files: corrupt files and rows without a positive page id or a title are left out."""
    rows = spark.read.schema(PAGE_SCHEMA + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("_corrupt is null and pageid > 0 and title <> ''").drop("_corrupt")


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """The watchlist; a corrupt file fails the read, since a lost entry would be dropped from the catalogue."""
    rows = spark.read.schema(WATCH_SCHEMA).option("mode", "FAILFAST").json(path)
    return rows.filter("title <> '' and pageid > 0 and kind in ('movie', 'series')")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id) of the lines of a list, without blank ones and comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("id")).filter(~line.startswith("#") & (line != ""))


def fresh_answers(cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Cached answers (path, payload, written_at) that still hold: an empty search expires after ``days``."""
    empty = F.col("path").startswith("/search/") & ((F.try_parse_json("payload").isNotNull()) & (F.get_json_object("payload", "$.total_results") == "0"))
    return cache.filter(~(F.coalesce(empty, F.lit(False)) & (F.col("written_at") < now - F.expr(f"interval {days} days"))))


def write_titles(titles: DataFrame, path: str) -> None:
    """Titles by (kind, bucket of the slug), the folder replaced as a whole; a lookup reads one bucket."""
    titles.withColumn("bucket", F.when(bucket_key(F.col("slug")) == "#", "_").otherwise(bucket_key(F.col("slug")))).write.mode("overwrite").partitionBy("kind", "bucket").parquet(path)


def read_title(spark: SparkSession, path: str, kind: str, slug: str) -> DataFrame:
    """One title, by a scan that is pruned to its kind and bucket."""
    first = slug[:1].upper()
    bucket = first if "A" <= first <= "Z" else "_"
    return spark.read.parquet(path).filter((F.col("kind") == kind) & (F.col("bucket") == bucket) & (F.col("slug") == slug))


def write_buckets(rows: DataFrame, path: str, name: str) -> None:
    """Rows by the first letter of a name, the folder replaced as a whole."""
    letter = bucket_key(F.col(name))
    rows.withColumn("bucket", F.when(letter == "#", "_").otherwise(letter)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_bucket(spark: SparkSession, path: str, name: str, first: str) -> DataFrame:
    """The rows whose name begins with a letter, by a scan that is pruned to it."""
    bucket = first[:1].upper() if "A" <= first[:1].upper() <= "Z" else "_"
    return spark.read.parquet(path).filter(F.col("bucket") == bucket).drop("bucket")


def append_watchlist(rows: DataFrame, path: str) -> DataFrame:
    """Append the entries (title, pageid, kind) whose page id the watchlist lacks, one row each; returns the whole list."""
    spark = rows.sparkSession
    fresh = rows.groupBy("pageid").agg(F.min_by(F.struct("title", "kind"), "title").alias("r")).select("r.title", "pageid", "r.kind")
    files, at = hadoop_path(spark, path)
    if files.exists(at):
        fresh = fresh.join(spark.read.parquet(path).select("pageid"), "pageid", "left_anti").select("title", "pageid", "kind")
    cut(fresh).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def consume_once(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a table that is read once: it is renamed, and deleted by ``consumed`` when its rows are dealt with.

    A run that dies in between leaves the renamed table; the next run reads that one first, and rows written since wait
    for the run after. Without either there are no rows.
    """
    files, at = hadoop_path(spark, path)
    taken = f"{path}.taken"
    _, to = hadoop_path(spark, taken)
    if not files.exists(to):
        if not files.exists(at):
            return spark.createDataFrame([], schema)
        files.rename(at, to)
    return spark.read.schema(schema).parquet(taken)


def consumed(spark: SparkSession, path: str) -> None:
    """Say that the rows of ``consume_once`` are dealt with."""
    files, to = hadoop_path(spark, f"{path}.taken")
    files.delete(to, True)
