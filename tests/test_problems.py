"""Problems 1, 6 and 7 on small cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cinegrain.operators.incremental import StaleRunError, StateStore, changed_records, content_hash, merge_buckets, newest_versions, page_state, pending_pages, read_buckets, run_incremental, run_pages
from cinegrain.operators.snapshot_diff import diff_snapshots
from cinegrain.operators.split_values import acts_pattern, atoms, neat, split_values
from cinegrain.session import scratch_path

ACTS = ["Ash; Or Not", "Quill, Ink & Co."]


@pytest.mark.parametrize(
    ("raw", "values"),
    [
        ("A B; C D", ["A B", "C D"]),
        ('"X, Y", C D', ["X, Y", "C D"]),
        ('"A ""Z"" B","C D"', ['A "Z" B', "C D"]),
        ("1. A B 2. C D", ["A B", "C D"]),
        ("A B (feat. Ash; Or Not, C D)", ["A B", "Ash; Or Not", "C D"]),
        ("A B (chorus, handclaps), , C D,", ["A B (chorus, handclaps)", "C D"]),
        ("Sung by A B and C D", ["A B", "C D"]),
        ("{{plainlist|\n* [[A B (actor)|A B]]<ref>x, y</ref>\n* Quill, Ink & Co.\n}}", ["A B", "Quill, Ink & Co."]),
        ("[[A, B]]<br/>C D<!-- n, o -->", ["A, B", "C D"]),
        ("n/a", []),
        ("", []),
    ],
)
def test_pieces(raw, values):
    assert [v for _, _, p in atoms(raw, acts_pattern(ACTS)) if (v := neat(p))] == values


def test_split_values_learns_separators(spark):
    rows = [("s", i, f"Ab C{c}, Da E{c}") for i, c in enumerate("abcdef")] + [("s", 10 + i, f"Ab{c}-Fa Co{c}") for i, c in enumerate("abcdef")]
    rows += [("s", 20 + i, f"Mo N{c}") for i, c in enumerate("abcdefgh")] + [("s", 99, None), ("s", 98, "—"), ("s", 0, "Ab Ca, Da Ea")]
    df = spark.createDataFrame(rows, "source string, row long, value string").withColumn("extra", F.lit(1))
    out = {(r["row"], r["pos"]): r["val"] for r in split_values(df, "source", "row", "value", ACTS).collect()}
    assert out[(0, 1)] == "Ab Ca" and out[(0, 2)] == "Da Ea"
    assert out[(10, 1)] == "Aba-Fa Coa" and (10, 2) not in out
    assert not any(k[0] in (98, 99) for k in out) and len(out) == 12 + 6 + 8
    assert split_values(df.limit(0), "source", "row", "value").count() == 0


def docs(spark, rows):
    return spark.createDataFrame(rows, "snapshot_day string, loaded_at timestamp, id string, pid long, t string, r double, q array<string>")


def test_snapshots(spark):
    t1, t2, t3 = datetime(2026, 1, 1), datetime(2026, 1, 2), datetime(2026, 1, 3)
    rows = [
        ("d1", t1, "a", 1, "A", 1.0, ["x", "y"]), ("d1", t1, "a", 1, "A", 1.0, ["x", "y"]), ("d1", t1, "b", 2, "B", None, []), ("d1", t1, "c", 3, "C", 1.0, []), ("d1", t1, "e", None, "E", 1.0, None), ("d1", t1, None, 9, "N", 1.0, None),
        ("d3", t2, "zzz", 8, "Z", 1.0, []),
        ("d3", t3, "a", 1, "A", 1.0, ["y", "x"]), ("d3", t3, "b", 2, "B", 2.0, None), ("d3", t3, "c-2", 3, "C", 1.0, []), ("d3", t3, "f", None, "F", 1.0, []),
    ]
    out = diff_snapshots(docs(spark, rows), "id", ["t", "r", "q"], second_key="pid").collect()
    assert {(r["id"], r["change"], tuple(r["fields"])) for r in out} == {("b", "changed", ("r",)), ("c-2", "renamed", ()), ("e", "removed", ()), ("f", "added", ())}
    assert diff_snapshots(docs(spark, []), "id", ["t"]).count() == 0


def test_pending_pages(spark):
    pages = spark.createDataFrame(
        [(1, 5, "2026-01-01T00:00:00Z", None), (1, 6, "2026-01-02T05:30:00.9+05:30", False), (2, None, "2026-01-03T00:00:00.5Z", None), (3, 7, "2026-01-01T00:00:00Z", None), (3, 8, "2026-01-05T00:00:00Z", True), (4, None, "2026-01-04T00:00:00Z", None), (5, 1, "2026-01-01T00:00:00Z", None)],
        "pageid long, revid long, fetchedat string, missing boolean",
    )
    entries = spark.createDataFrame([(1, 5, "2026-01-01T00:00:00Z", 1), (2, None, "2026-01-03T00:00:00Z", 1), (3, 7, "x", 1), (4, None, "2026-01-03T23:59:59Z", 1), (5, 1, "2026-01-01T00:00:00Z", 2), (1, None, "2026-01-01T00:00:00Z", 1)], "pageid long, revid long, fetchedat string, run_id int")
    runs = spark.createDataFrame([(1, "ok"), (2, "failed")], "run_id int, status string")
    out = {r["pageid"]: r["change"] for r in pending_pages(newest_versions(pages), page_state(entries, runs)).collect()}
    assert out == {1: "changed", 4: "changed", 5: "added"}
    assert pending_pages(newest_versions(pages.limit(0)), page_state(entries, runs)).count() == 0


def test_state_survives_failure(spark):
    store = StateStore(spark, scratch_path(spark, "state"))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "z")], "k long, v string").withColumn("h", content_hash(F.col("v")))
    assert run_incremental(store, rows, "k", "h", lambda df: df.count()) == 2

    def fails(df):
        raise RuntimeError

    more = rows.unionByName(spark.createDataFrame([(3, "c")], "k long, v string").withColumn("h", content_hash(F.col("v"))))
    before = store.version()
    with pytest.raises(RuntimeError):
        run_incremental(store, more, "k", "h", fails)
    assert store.version() == before
    assert run_incremental(store, more, "k", "h", lambda df: df.count()) == 1
    assert run_incremental(store, more, "k", "h", lambda df: df.count()) == 0


def hashed(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v string").withColumn("h", content_hash(F.col("v")))


def test_records_that_go_back_are_changed_again(spark):
    store = StateStore(spark, scratch_path(spark, "state"))
    changes = lambda todo: todo.select("k", "v", "change")
    seen = [{tuple(r) for r in run_incremental(store, hashed(spark, (1, v), (2, "same")), "k", "h", changes).collect()} for v in "ABA"]
    assert seen == [{(1, "A", "added"), (2, "same", "added")}, {(1, "B", "changed")}, {(1, "A", "changed")}]
    assert [spark.read.parquet(p).count() for p in store.outputs()] == [2, 1, 1]
    assert store.read("k long, h string").count() == 2
    assert sum(name.startswith("state-") for name in store._listed(store.path)) == 2 and not any(name.startswith("todo-") for name in store._listed(store.path))


def test_rows_of_one_key(spark):
    rows = hashed(spark, (1, "A"), (1, "A"), (1, "B"), (None, "C"), (2, None)).withColumn("change0", F.when(F.col("v") == "B", 2).otherwise(1))
    out = changed_records(rows, hashed(spark, (1, "A")).limit(1), "k", "h", order="change0").collect()
    assert {(r["k"], r["v"], r["change"]) for r in out} == {(1, "B", "changed"), (2, None, "added")}
    assert changed_records(rows.limit(0), hashed(spark), "k", "h").count() == 0


def test_run_that_dies(spark, monkeypatch):
    store = StateStore(spark, scratch_path(spark, "state"))
    rows = hashed(spark, (1, "A"))

    def dies(*_):
        raise RuntimeError

    with monkeypatch.context() as m:  # after processing, before the commit
        m.setattr(StateStore, "swap", dies)
        with pytest.raises(RuntimeError):
            run_incremental(store, rows, "k", "h", lambda todo: todo)
    assert store.version() is None and store.outputs() == []
    with monkeypatch.context() as m:  # after the commit
        m.setattr(StateStore, "_tidy", dies)
        with pytest.raises(RuntimeError):
            run_incremental(store, rows, "k", "h", lambda todo: todo)
    assert run_incremental(store, rows, "k", "h", lambda todo: todo).count() == 0
    assert sum(spark.read.parquet(p).count() for p in store.outputs()) == 1


def test_two_runs_at_once(spark):
    store = StateStore(spark, scratch_path(spark, "state"))

    def other_run(todo):
        run_incremental(store, hashed(spark, (1, "A"), (2, "B")), "k", "h", lambda own: own)
        return todo

    with pytest.raises(StaleRunError):
        run_incremental(store, hashed(spark, (1, "A")), "k", "h", other_run)
    assert [spark.read.parquet(p).count() for p in store.outputs()] == [2]
    assert run_incremental(store, hashed(spark, (1, "A"), (2, "C")), "k", "h", lambda todo: todo).count() == 1


def test_page_runs_follow_each_other(spark):
    store = StateStore(spark, scratch_path(spark, "pages"))
    schema = "pageid long, revid long, fetchedat string, missing boolean"
    first = [(1, 5, "2026-01-01T00:00:00Z", None), (2, None, "2026-01-03T00:00:00Z", None)]
    assert {tuple(r) for r in run_pages(store, spark.createDataFrame(first, schema)).collect()} == {(1, "added"), (2, "added")}
    more = first + [(1, 6, "2026-01-05T00:00:00Z", None), (2, None, "2026-01-03T00:00:00.4Z", None), (3, 1, "2026-01-05T00:00:00Z", None)]
    assert {tuple(r) for r in run_pages(store, spark.createDataFrame(more, schema)).collect()} == {(1, "changed"), (3, "added")}
    assert run_pages(store, spark.createDataFrame(first, schema)).count() == 0


def test_buckets_that_are_touched(spark):
    store, schema = StateStore(spark, scratch_path(spark, "buckets")), "k long, v string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    last = lambda old, fresh: old.join(fresh.select("k"), "k", "left_anti").unionByName(fresh)
    assert read_buckets(store, schema).count() == 0
    merge_buckets(store, schema, rows(*[(i, "a") for i in range(40)]), "k", last, n=8)
    before = store.buckets()
    merge_buckets(store, schema, rows((3, "b"), (99, "b")), "k", last, n=8)
    assert sum(before[b] != at for b, at in store.buckets().items()) <= 2
    for _ in range(3):
        merge_buckets(store, schema, rows((5, "c")), "k", last, n=8)
    assert {r["k"]: r["v"] for r in read_buckets(store, schema).collect()} == {i: "a" for i in range(40)} | {3: "b", 99: "b", 5: "c"}
