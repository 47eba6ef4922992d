"""Search documents and an inverted index over them: prefix and fuzzy words, scores by BM25."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinegrain.session import cut

K1, B = 1.2, 0.75
BOOST = {"t": 3.0, "q": 1.0}


def build_documents(titles: DataFrame, cast: DataFrame, most: int = 8) -> DataFrame:
    """(id, k, t, q): titles with their directors, then linked cast in billing order; distinct names, at most ``most``.

    The list is cut by the format of the documents; entries without an order come last.
    """
    base = titles.select("pageid", "kind", "slug", "title", F.posexplode_outer("directedby").alias("at", "name"))
    directors = base.filter("name is not null").select("pageid", "name", F.struct(F.lit(0).alias("tier"), F.col("at").cast("bigint").alias("o"), F.lit(0).cast("bigint").alias("e")).alias("k"))
    members = cast.filter("name is not null").select("pageid", "name", F.struct(F.lit(1).alias("tier"), F.coalesce(F.col("ord").cast("bigint"), F.lit(1_000_000)).alias("o"), F.col("entry_id").alias("e")).alias("k"))
    names = directors.unionByName(members).groupBy("pageid", "name").agg(F.min("k").alias("k"))
    place = F.row_number().over(Window.partitionBy("pageid").orderBy("k"))
    kept = names.withColumn("n", place).filter(F.col("n") <= most).groupBy("pageid").agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("x"))
    q = F.transform(F.coalesce("x", F.array().cast("array<struct<n:int,name:string>>")), lambda x: x["name"])
    docs = titles.select("pageid", "kind", "slug", "title").join(kept, "pageid", "left")
    return docs.select(F.concat_ws(":", "kind", "slug").alias("id"), F.col("kind").alias("k"), F.col("title").alias("t"), q.alias("q"))


def person_documents(credits: DataFrame) -> DataFrame:
    """(id, k, t, q): each linked person with the distinct titles credited to them, all of them, in order of ``ord``.

    ``credits`` is (slug, rank, name, title, ord). The name is one of the least rank, the most frequent of these, the
    first in a tie. Rows without slug are no persons'; a person none of whose titles are known has an empty list.
    """
    linked = credits.filter("slug is not null")
    named = linked.filter("name is not null").groupBy("slug", "rank", "name").agg(F.count("*").alias("n"))
    named = named.groupBy("slug").agg(F.min_by("name", F.struct("rank", -F.col("n"), "name")).alias("t"))
    titles = linked.filter("title is not null").groupBy("slug", "title").agg(F.min("ord").alias("ord"))
    titles = titles.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("ord", "title"))).alias("x"))
    q = F.coalesce(F.transform("x", lambda x: x["title"]), F.array().cast("array<string>"))
    docs = linked.select("slug").distinct().join(named, "slug", "left").join(titles, "slug", "left")
    return docs.select(F.concat(F.lit("person:"), "slug").alias("id"), F.lit("person").alias("k"), "t", q.alias("q"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(docs: DataFrame) -> DataFrame:
    """(word, field, id, n, size): the words of titles (t) and of further names (q)."""
    fields = F.array(F.struct(F.lit("t").alias("field"), words(F.col("t")).alias("w")), F.struct(F.lit("q").alias("field"), words(F.array_join("q", " ")).alias("w")))
    rows = docs.select("id", F.explode(fields).alias("f")).select("id", "f.field", F.size("f.w").alias("size"), F.explode("f.w").alias("word"))
    return rows.groupBy("word", "field", "id", "size").agg(F.count("*").alias("n"))


def matches(word: Column, wanted: str, fuzzy: float) -> Column:
    """Exact words, words that begin so, and words within an edit distance of a share of the length."""
    near = word.startswith(wanted)
    slips = math.floor(fuzzy * len(wanted) + 0.5)
    return near | (F.levenshtein(word, F.lit(wanted), slips) >= 0) if slips else near


def find(index: DataFrame, wanted: str, fuzzy: float = 0.2, fields: list[str] = ("t", "q")) -> DataFrame:
    """The ids of documents with a matching word."""
    return index.filter(F.col("field").isin(*fields) & matches(F.col("word"), wanted.lower(), fuzzy)).select("id").distinct()


def write_index(index: DataFrame, path: str) -> None:
    """Keep an index: its words, and the postings by the first letter of the word."""
    first = F.substring("word", 1, 1)
    index.select("field", "word").distinct().write.mode("overwrite").parquet(f"{path}/words")
    index.withColumn("letter", F.when(first.rlike("^[a-z0-9]$"), first).otherwise("_")).repartition("letter", "word").write.mode("overwrite").partitionBy("letter").parquet(f"{path}/postings")


def find_written(spark: SparkSession, path: str, wanted: str, fuzzy: float = 0.2, fields: list[str] = ("t", "q")) -> DataFrame:
    """``find`` on a kept index: words are compared with the list of words only, and then the postings of the letters
    that matched, 37 at most, are read for the matching words."""
    words = cut(spark.read.parquet(f"{path}/words").filter(F.col("field").isin(*fields) & matches(F.col("word"), wanted.lower(), fuzzy)))
    first = F.substring("word", 1, 1)
    letters = [r[0] for r in words.select(F.when(first.rlike("^[a-z0-9]$"), first).otherwise("_")).distinct().collect()]
    return spark.read.parquet(f"{path}/postings").filter(F.col("letter").isin(*letters)).join(words, ["field", "word"], "left_semi").select("id").distinct()


def ranked(docs: DataFrame, index: DataFrame, query: str, most: int, fuzzy: float = 0.2) -> DataFrame:
    """(k, place, id, score) of the best documents for any word of the query, grouped by kind; ``place`` is the hit's.

    BM25 per field with its boost; inexact words count by how near they are. The words of the query are scanned for
    together, so the index is read once.
    """
    wanted = [w for w in query.lower().split() if w]
    n_docs = docs.count()
    hit = F.coalesce(*[F.when(matches(F.col("word"), w, fuzzy), F.lit(i)) for i, w in enumerate(wanted)])
    near = F.coalesce(*[F.when(matches(F.col("word"), w, fuzzy), F.lit(len(w)) / F.greatest(F.length("word"), F.lit(len(w)))) for w in wanted])
    found = index.withColumn("term", hit).withColumn("near", near).filter("term is not null")
    df = found.groupBy("field", "term").agg(F.count_distinct("id").alias("df"))
    mean = index.groupBy("field").agg(F.avg("size").alias("mean"))
    scored = found.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(mean), "field")
    boost = F.coalesce(*[F.when(F.col("field") == f, b) for f, b in BOOST.items()])
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    best = scored.groupBy("id").agg(F.round(F.sum(boost * F.col("near") * weight), 6).alias("score")).join(docs.select("id", "k"), "id")
    top = best.orderBy(F.desc("score"), "id").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("k", "place", "id", "score")
