"""Queries of the general problems 1, 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrain.operators.incremental import StateStore, content_hash, page_state, run_incremental, run_pages
from cinegrain.operators.snapshot_diff import diff_snapshots
from cinegrain.operators.split_values import split_values
from cinegrain.plans.registry import Registry
from cinegrain.session import scratch_path, table

REGISTRY = Registry()
PACKED_PARAMETERS = ["starring", "director", "writer", "producer", "music", "studio", "language"]
MOST_ACTS = 10_000
SEARCH_FIELDS = ["t", "y", "l", "p", "r", "rd", "q"]


def packed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, row_id, value) of every packed field."""
    songs = table(spark, sf_dir, "song_rows")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("singers", "writers")])
    of_songs = songs.select(F.col("song_id").alias("row_id"), F.explode(pairs).alias("p")).select("p.field", "row_id", "p.value")
    titles = table(spark, sf_dir, "titles").filter("params is not null")
    pairs = F.array(*[F.struct(F.lit(f"params.{f}").alias("field"), F.try_element_at("params", F.lit(f)).alias("value")) for f in PACKED_PARAMETERS])
    of_titles = titles.select(F.col("pageid").alias("row_id"), F.explode(pairs).alias("p")).select("p.field", "row_id", "p.value")
    return of_songs.unionByName(of_titles)


def act_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """The names in ``acts``, a table of a fixed 24 rows; more than MOST_ACTS are refused rather than sent to every task."""
    rows = table(spark, sf_dir, "acts").select("name").filter("name is not null").distinct().limit(MOST_ACTS + 1).collect()
    if len(rows) > MOST_ACTS:
        raise ValueError(f"acts has more than {MOST_ACTS} names")
    return [r["name"] for r in rows]


@REGISTRY.query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_values(packed_fields(spark, sf_dir), "field", "row_id", "value", act_names(spark, sf_dir))


P6_SQL = """
with d as (
  select distinct s.snapshot_day, s.id, s.pid, coalesce(t,'') t, y, coalesce(l,'') l, coalesce(p,'') p, r, coalesce(rd,'') rd,
         list_sort(coalesce(q, [])) q
  from search_docs s join (select snapshot_day, max(loaded_at) m from search_docs group by 1) x
    on s.snapshot_day = x.snapshot_day and s.loaded_at = x.m),
days as (select snapshot_day, lag(snapshot_day) over (order by snapshot_day) prev from (select distinct snapshot_day from search_docs)),
cur as (select d.*, days.prev from d join days using (snapshot_day) where prev is not null),
old as (select d.*, days.snapshot_day as nxt from d join days on days.prev = d.snapshot_day),
changed as (select cur.snapshot_day, cur.id, 'changed' change from cur join old on old.nxt = cur.snapshot_day and old.id = cur.id
  where (cur.t, cur.l, cur.p, cur.rd, cur.q) is distinct from (old.t, old.l, old.p, old.rd, old.q)
     or cur.y is distinct from old.y or cur.r is distinct from old.r),
plus as (select cur.snapshot_day, cur.id, cur.pid from cur where not exists (select 1 from old where old.nxt = cur.snapshot_day and old.id = cur.id)),
minus as (select old.nxt snapshot_day, old.id, old.pid from old where not exists (select 1 from cur where old.nxt = cur.snapshot_day and old.id = cur.id)),
both_sides as (select plus.snapshot_day, plus.id new_id, minus.id old_id from plus join minus on plus.snapshot_day = minus.snapshot_day and plus.pid = minus.pid)
select snapshot_day, id, change from changed
union all select snapshot_day, new_id, 'renamed' from both_sides
union all select snapshot_day, id, 'added' from plus where (snapshot_day, id) not in (select snapshot_day, new_id from both_sides)
union all select snapshot_day, id, 'removed' from minus where (snapshot_day, id) not in (select snapshot_day, old_id from both_sides)
"""


@REGISTRY.query(P6_SQL)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_snapshots(table(spark, sf_dir, "search_docs"), "id", SEARCH_FIELDS, second_key="pid").select("snapshot_day", "id", "change")


P6_FIELDS_SQL = (
    P6_SQL[: P6_SQL.index("changed as (")]
    + """pairs as (select cur.snapshot_day, cur.id, x.field, x.same from cur join old on old.nxt = cur.snapshot_day and old.id = cur.id,
  lateral (values ('t', cur.t = old.t), ('y', cur.y is not distinct from old.y), ('l', cur.l = old.l), ('p', cur.p = old.p), ('r', cur.r is not distinct from old.r), ('rd', cur.rd = old.rd), ('q', cur.q = old.q)) x(field, same))
select snapshot_day, id, field from pairs where not same"""
)


@REGISTRY.query(P6_FIELDS_SQL)
def p6_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per changed field of the changed documents."""
    found = diff_snapshots(table(spark, sf_dir, "search_docs"), "id", SEARCH_FIELDS, second_key="pid")
    return found.filter("change = 'changed'").select("snapshot_day", "id", F.explode("fields").alias("field"))


P7_SQL = """
with v as (select pageid, revid, fetchedat::timestamptz ts from raw_pages where not coalesce(missing, false)),
top as (select pageid, max(revid) revid from v group by 1),
newest as (
  select t.pageid, t.revid, case when t.revid is null then max(v.ts) else min(v.ts) end ts
  from top t join v on v.pageid = t.pageid and v.revid is not distinct from t.revid group by 1, 2),
done as (select c.pageid, c.revid, date_trunc('second', c.fetchedat::timestamptz) ts
         from cache_entries c join refresh_runs r on r.run_id = c.run_id where r.status = 'ok')
select n.pageid, case when exists (select 1 from done d where d.pageid = n.pageid) then 'changed' else 'added' end as change
from newest n
where not exists (select 1 from done d where d.pageid = n.pageid
                  and (d.revid = n.revid or (d.revid is null and d.ts >= date_trunc('second', n.ts))))
"""


@REGISTRY.query(P7_SQL)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the next run takes: a state with what earlier runs took in is committed, then one run is made from it."""
    store = StateStore(spark, scratch_path(spark, "page-state"))
    store.swap(store.stage(page_state(table(spark, sf_dir, "cache_entries"), table(spark, sf_dir, "refresh_runs"))))
    return run_pages(store, table(spark, sf_dir, "raw_pages"))


P7_CONTENT_SQL = """
with f as (select pageid, title, wikitext, thumb, extract, fetch_id, landed_at from raw_pages where not coalesce(missing, false)),
cut as (select max(landed_at) till from raw_pages where landed_at <= (select max(started_at) from refresh_runs where status = 'ok')),
newest as (select pageid, max_by(f, (landed_at, fetch_id)) v from f group by 1),
before as (select pageid, max_by(f, (landed_at, fetch_id)) v from f, cut where landed_at <= cut.till group by 1)
select n.pageid, case when b.pageid is null then 'added' else 'changed' end as change
from newest n left join before b using (pageid)
where b.pageid is null or (n.v.title, n.v.wikitext, n.v.thumb, n.v.extract) is distinct from (b.v.title, b.v.wikitext, b.v.thumb, b.v.extract)
"""


@REGISTRY.query(P7_CONTENT_SQL)
def p7_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose content (title, text, picture, extract) is new or other than at the start of the last ok run.

    Two runs of the incremental operator on the hash of the content: over what had landed then, and over all.
    """
    fetched = table(spark, sf_dir, "raw_pages").filter("not coalesce(missing, false)")
    pages = fetched.select("pageid", "landed_at", F.struct("landed_at", "fetch_id").alias("place"), content_hash(*[F.col(c) for c in ("title", "wikitext", "thumb", "extract")]).alias("digest"))
    started = table(spark, sf_dir, "refresh_runs").filter("status = 'ok'").agg(F.max("started_at").alias("at"))
    store = StateStore(spark, scratch_path(spark, "content-state"))
    run_incremental(store, pages.join(F.broadcast(started), pages["landed_at"] <= started["at"]).drop("at"), "pageid", "digest", lambda todo: None, order="place")
    return run_incremental(store, pages, "pageid", "digest", lambda todo: todo.select("pageid", "change"), order="place")
