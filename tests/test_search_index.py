"""Posting lists against a plain scan of the texts."""

import pytest
from pyspark.sql import functions as F

from quantloom.operators import search_index

ROWS = [("000001", "平安银行"), ("600519", "贵州茅台"), ("000002", "万科A"), ("300750", "宁德时代"), ("A1", "Acme first-class Works 7"), ("A1", "Acme first-class Works 7"),
        ("B2", None), ("C3", ""), ("D4", "aaaaaa"), (None, "Acme"), ("E5", "x" * 5000 + "yz"), ("F6", "Anna's über-Shop")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "postings")
    universe = spark.createDataFrame(ROWS, "symbol string, name string").withColumns({"gram": F.lit(1), "key": F.lit("k"), "places": F.lit(0)})
    fields = {"code": F.col("symbol"), "name": F.col("name"), "initials": search_index.initials(F.col("name"))}
    search_index.write(search_index.postings(universe, "symbol", fields), path)
    return search_index.read(spark, path), universe.withColumn("initials", fields["initials"])


def test_initials(index):
    got = {r["name"]: r["initials"] for r in index[1].collect()}
    assert got["贵州茅台"] == "GZMT" and got["宁德时代"] == "NDSD" and got["万科A"] == "WKA"
    assert got["Acme first-class Works 7"] == "AFCW7" and got[None] is None and got[""] == ""


def test_found_as_by_a_scan(index):
    """Every piece of up to five characters of the short texts, and some that are nowhere."""
    postings, universe = index
    rows = {(r["symbol"], f, (r[c] or "").upper()) for r in universe.collect() for f, c in (("code", "symbol"), ("name", "name"), ("initials", "initials")) if r["symbol"]}
    texts = sorted({t[i : i + n] for _, _, t in rows if len(t) < 100 for n in range(1, 6) for i in range(len(t) - n + 1)} | {"AAAAAA", "AAAAAAA", "ACE", "XYZ", "XXYZ", "ZZ", "0000002"})
    want = {}
    for t in texts:
        if t.strip():
            for key, field, text in rows:
                if t.strip() in text:
                    want.setdefault((t.strip(), key), set()).add(field)
    asked = postings.sparkSession.createDataFrame([(t.lower(),) for t in texts] + [(None,), ("",), (" ",)], "text string")
    got = {(r["text"], r["key"]): set(r["fields"].split(",")) for r in search_index.find(postings, asked, None).collect()}
    assert got == want
    few = {(r["text"], r["key"]) for r in search_index.find(postings, ["0", " gzm ", "", None], most=2).collect()}
    assert few == {("0", "000001"), ("0", "000002"), ("GZM", "600519")}


def test_a_search_reads_its_grams(index):
    plan = search_index.find(index[0], ["gzmt"])._jdf.queryExecution().toString()
    assert "In(gram, [GZM,ZMT])" in plan and "name" not in plan.split("== Physical Plan ==")[1].split("ReadSchema")[1].split(">")[0]


def test_no_rows(spark):
    nothing = spark.createDataFrame([], "symbol string, name string")
    index = search_index.postings(nothing, "symbol", {"name": F.col("name")})
    assert search_index.find(index, ["a"]).count() == 0
    assert search_index.find(index, []).count() == 0
