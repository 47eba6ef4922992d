"""Queries named *_all read every row, where the queries of the same name without it keep the cuts of their SQL."""

import os
import re
import sys
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from cinegrain.markup.udfs import FAMILIES
from cinegrain.plans.extraction import cast_read

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize(("name", "source"), [("episodes_round_trip_all", "orders"), ("fill_episodes_all", "lineitem"), ("taglines_all", "documents")])
def test_every_row_comes_out(spark, name, source):
    assert entry.queries()[name](spark, DATA).count() == duckdb.sql(f"select count(*) from '{DATA}/{source}.parquet'").fetchall()[0][0]


def test_cast_of_any_name(spark):
    rows = [(1, 9, "O'Brien-Šmíd, Ana", None, "Dr. X"), (2, 9, "weneth tirehor", "Weneth_T", None), (3, 9, "R.K. Genigul", "R. K. (actor)", ""), (4, 9, None, "Only link", "Y"), (5, 9, "", "Other link", ""), (6, 9, None, None, "Z"), (7, 9, 'Ana "B" Cé', "A (b)", "Z")]
    out = cast_read(spark.createDataFrame(rows, "entry_id long, pageid long, name string, wikititle string, role string")).collect()
    want = [(n or w, w or "", r or "") for _, _, n, w, r in rows if n or w]
    assert [(r["name"], r["wikititle"], r["role"]) for r in sorted(out, key=lambda r: r["pos"])] == want


def first_sentence(text):
    """By the character: up to white space after an end sign, not after an initial, before a capital, quotation or bracket."""
    text = text.strip(" ")
    for i, sign in enumerate(text):
        after = text[i + 1 :]
        rest = after.lstrip()
        if sign in ".!?" and after != rest and re.match(r"[A-Z\"'“(\[]", rest) and not (sign == "." and i and "A" <= text[i - 1] <= "Z"):
            return text[: i + 1]
    return text


def test_taglines_of_any_text(spark, tmp_path):
    texts = ["It's the well-known “Café” of R. K. Narayan's elder sister! Next one.", "One two three four five six seven eight nine ten? (So) it is.", "Short. Next.", "a" * 250 + ". B", None, "", "नाम " * 15 + "x! Then", "No end sign at all but longer than forty characters", 'He said that "all is well here today, my friends." "Then" he left.']
    spark.createDataFrame([(i, t, ("English", "en-IN", None, "hi")[i % 4]) for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["tagline"] for r in entry.queries()["taglines_all"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None or not 40 <= len(first_sentence(t)) <= 200 else first_sentence(t) for i, t in enumerate(texts)}
    assert sum(v is not None for v in got.values()) >= 3


def test_persons_have_documents(spark):
    rows = entry.queries()["search_documents_all"](spark, DATA).toPandas()
    t = f"'{DATA}/titles.parquet'"
    titles = duckdb.sql(f"select count(distinct pageid) from {t}").fetchall()[0][0]
    links = duckdb.sql(f"select count(distinct wikititle) from '{DATA}/cast_entries.parquet'").fetchall()[0][0]
    assert rows["id"].is_unique and (~rows["id"].str.startswith("person:")).sum() == titles
    assert rows["id"].str.startswith("person:").sum() >= links


def calls(read, text):
    """Calls of functions, those of C too, that reading a text takes."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        read(text)
    finally:
        sys.setprofile(None)
    return n


@pytest.mark.parametrize(
    ("family", "head", "row"),
    [
        ("awards", "== Awards ==\n{|\n! Year !! Award !! Category !! Film !! Result\n|-\n| rowspan=100 | 1999 || [[Grand Prize]] || c || ''W'' || {{won}}\n", "|-\n| [[Grand Prize]] || category %(i)d || ''Work %(k)d'' || {{nom}}\n"),
        ("filmography", "== Filmography ==\n{|\n! Year !! Title !! Role\n|-\n| rowspan=100 | 1999 || ''[[A]]'' || r\n", "|-\n| ''[[Part %(i)d|work %(k)d]]'' || role %(k)d\n"),
    ],
)
def test_rows_of_tables_are_read_in_few_steps(family, head, row):
    """Cells that come again aren't read again, and steps without anything to do are left out."""
    n, read = 400, FAMILIES[family][1]
    text = head + "".join(row % {"i": i, "k": i % 5} for i in range(n)) + "|}"
    assert len(read(text)) == n + 1
    fresh = text.replace("category", "kind").replace("Part", "Number")
    assert (taken := calls(read, fresh)) < 200 * n, taken / n


@pytest.mark.parametrize("name", ["awards_round_trip", "filmography_round_trip"])
def test_lines_are_placed_after_the_joins(spark, tmp_path, name):
    """As in the SQL, a line without its part or order has no place; and no window is needed to place the others."""
    lines = [(1, 7, 1, 1, 5.0, "R"), (1, 8, 1, 2, 5.0, "A"), (1, 9, 1, 3, 5.0, "N"), (1, 8, 1, 4, 5.0, "R"), (2, 9, 1, 1, 5.0, "N"), (3, 9, 1, 1, 5.0, "N"), (4, 7, 1, 1, 5.0, "A")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, datetime(1990 + k, 1, 1)) for k in (1, 2, 4, 5)], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(8, "red bolt"), (9, "old ring"), (10, "x")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    found = entry.queries()[name](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(entry.oracle_sql()[name]).fetchall())
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
