"""Queries of the problems on texts, names and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrain.llm.cleaning import page_differences, text_elements
from cinegrain.llm.components import connected_groups, is_filled
from cinegrain.llm.languages import label_languages
from cinegrain.llm.matching import match_records, result_terms, title_terms, without_variants
from cinegrain.llm.mixing import actual_shares, counted_once, mix_documents, mixture_plans
from cinegrain.llm.names import same_person
from cinegrain.llm.tokenize import count_tokens, encode_corpus
from cinegrain.plans.registry import Registry
from cinegrain.session import table, written

REGISTRY = Registry()
# What the mixtures may lose against their target shares, in nats, for the sake of their size.
ENTROPY_LOSS = 0.02

P3_SQL = r"""
with recursive e as (
  select distinct from_title a, to_title b from redirects where regexp_matches(from_title, '[^\s]') and regexp_matches(to_title, '[^\s]')),
both_ways as (select a, b from e union select b, a from e),
reach as (select a as title, a as other from both_ways union select r.title, x.b from reach r join both_ways x on x.a = r.other)
select title, min(other) as group_title from reach group by title
"""


@REGISTRY.query(P3_SQL)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "redirects").filter(is_filled(F.col("from_title")) & is_filled(F.col("to_title")))
    return connected_groups(pairs, "from_title", "to_title").toDF("title", "group_title")


def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, markup, text) of the three sources."""
    pages = table(spark, sf_dir, "raw_pages").select(F.lit("wikitext").alias("src"), F.col("fetch_id").alias("row_id"), F.lit("wiki").alias("markup"), F.col("wikitext").alias("text"))
    sections = table(spark, sf_dir, "page_sections")
    bodies = sections.select(F.lit("body").alias("src"), F.col("section_id").alias("row_id"), F.lit("wiki").alias("markup"), F.col("body").alias("text"))
    texts = sections.select(F.lit("text").alias("src"), F.col("section_id").alias("row_id"), F.lit(None).cast("string").alias("markup"), "text")
    return pages.unionByName(bodies).unionByName(texts)


@REGISTRY.query()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_elements(marked_texts(spark, sf_dir))


@REGISTRY.query()
def p4_page_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fetched page without the lines it shares with the page of the nearest path; a page's path is its title."""
    pages = table(spark, sf_dir, "raw_pages").select("fetch_id", F.lit("wiki").alias("host"), F.replace(F.lower("title"), F.lit(" "), F.lit("_")).alias("path"), "wikitext")
    return page_differences(pages.dropDuplicates(["fetch_id"]), "fetch_id", "host", "path", "wikitext")


@REGISTRY.query()
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


@REGISTRY.query()
def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by source and language label."""
    counts = count_tokens(table(spark, sf_dir, "documents"), ["source", "lang"])
    return counts.groupBy("source", "lang").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))


def matched_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = written(without_variants(result_terms(table(spark, sf_dir, "search_results"))), "result-terms", lean=True)
    titles = written(without_variants(title_terms(table(spark, sf_dir, "titles"))), "title-terms", lean=True)
    return match_records(results, titles)


@REGISTRY.query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_works(spark, sf_dir).select(F.col("d").alias("pageid"), F.col("q").alias("id"))


@REGISTRY.query()
def p2_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_works(spark, sf_dir).select(F.col("d").alias("pageid"), F.col("q").alias("id"), "score", "gap", "confidence")


@REGISTRY.query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_person(table(spark, sf_dir, "cast_entries"))


def mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counted = counted_once(count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"]))
    plans = mixture_plans(spark, counted, table(spark, sf_dir, "mix_targets"), entropy_loss=ENTROPY_LOSS)
    return mix_documents(counted, plans), plans


@REGISTRY.query()
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir)[0]


@REGISTRY.query()
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actual_shares(*mixture(spark, sf_dir))


@REGISTRY.query()
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = label_languages(table(spark, sf_dir, "documents"))
    return found.filter("seg > 0 or label is null or label <> lang").select("doc_id", "seg", "lang")


@REGISTRY.query()
def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_languages(table(spark, sf_dir, "documents"))
