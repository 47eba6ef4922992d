"""The extractors over DataFrames: one Arrow pass per family returns the records of a page; positions are kept."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cinegrain.markup import core, honours, lists, tables

_S = "string"
FAMILIES: dict[str, tuple[str, Callable]] = {
    "infobox": ("array<struct<name:string,value:string>>", lambda t: [{"name": k, "value": v} for k, v in (core.infobox(t) or {}).items()]),
    "sections": ("array<struct<title:string,level:int,body:string>>", core.sections),
    "links": ("array<struct<target:string,label:string>>", core.wiki_links),
    "references": ("array<struct<label:string,url:string,source:string,date:string>>", core.references),
    "templates": ("array<struct<name:string,n_params:int>>", lambda t: [{"name": x["name"], "n_params": len(x["params"])} for x in core.templates(t or "", ".")]),
    "cast": ("array<struct<name:string,wikititle:string,role:string>>", lists.cast),
    "people": ("array<struct<target:string,label:string,role:string>>", lambda t: lists.person_links(core.infobox(t), lists.cast(t))),
    "episodes": ("array<struct<number:string,title:string,director:string,writer:string,airdate:string,summary:string,season:int>>", lists.episodes),
    "tracks": ("array<struct<number:string,title:string,singers:string,lyrics:string,length:string>>", lambda t: lists.soundtrack(t)["tracks"]),
    "filmography": ("array<struct<heading:string,medium:string,year:string,title:string,wikititle:string,role:string,notes:string>>", lists.filmography),
    "discography": ("array<struct<heading:string,year:string,film:string,song:string,singers:string,writers:string>>", lists.discography),
    "awards": ("array<struct<year:string,award:string,awardwikititle:string,category:string,work:string,workwikititle:string,recipients:string,result:string>>", honours.awards),
    "awards_page": ("array<struct<year:string,award:string,awardwikititle:string,category:string,work:string,workwikititle:string,recipients:string,result:string>>", lambda t: honours.awards(t, whole=True)),
    "article": ("array<struct<title:string,text:string>>", core.article_sections),
    "facts": ("array<struct<label:string,value:string>>", core.person_facts),
    "external": ("array<struct<label:string,url:string>>", lambda t: core.external_links(t)["links"]),
    "bio": ("array<struct<heading:string,text:string>>", lists.bio_sections),
    "grid": ("array<struct<tab:int,row:int,col:int,value:string>>", lambda t: [{"tab": n, "row": i, "col": j, "value": core.plain(c)} for n, x in enumerate(tables.find_tables(t or "")) for i, r in enumerate(tables.read_table(x)["rows"]) for j, c in enumerate(r)]),
    "list_items": ("array<string>", core.list_items),
    "plain": (_S, core.plain),
    "lead": (_S, core.lead),
    "plot": (_S, lambda t: core.plain(core.plot_section(t)) or None),
    "fact_date": (_S, core.date_text),
}


def family_fields(family: str) -> list[str]:
    """The fields of a family's records."""
    return [f.name for f in T._parse_datatype_string(FAMILIES[family][0]).elementType.fields]


def subpage_of(text: Column, subject: str) -> Column:
    """The page that a {{Main}} pointer of each text names for a subject; see ``lists.subpage``."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: lists.subpage(t, subject), na_action="ignore")

    return read(text)


def extracted(df: DataFrame, key: str, text: str, family: str) -> DataFrame:
    """(key, found): the records of a family in each text; a null text has none."""
    kind, read = FAMILIES[family]
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("found", T._parse_datatype_string(kind))])

    def run(batches):
        arrow = to_arrow_type(schema["found"].dataType)
        for batch in batches:
            found = [None if t is None else read(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], names=["key", "found"])

    return df.select(key, text).mapInArrow(run, schema).toDF(key, "found")


def exploded(df: DataFrame, key: str, text: str, family: str) -> DataFrame:
    """One row per record with ``pos`` from 1; texts without records have no rows."""
    found = extracted(df, key, text, family)
    rows = found.select(key, F.posexplode("found").alias("_at", "_r"))
    fields = found.schema["found"].dataType.elementType
    columns = [F.col(f"_r.{f.name}").alias(f.name) for f in fields.fields] if isinstance(fields, T.StructType) else [F.col("_r").alias("value")]
    return rows.select(key, (F.col("_at") + 1).cast("bigint").alias("pos"), *columns)
