import sqlite3

import pytest
from pyspark.sql import functions as F

from paperloom.operators import dsl, search

TEXTS = [
    (1, "Deep graph networks", "graph networks learn well", "", "", "2020 icml"),
    (2, "Networks of graphs", "a deep study of deep networks", "graph graph graph", "", ""),
    (3, "Cooking", "no such thing", "deep in the text a graph networks note", "graph", "graph"),
    (4, "Café culture", "coffee", "", "", ""),
    (5, "深度学习综述", "学习 深度", "", "", ""),
]
COLUMNS = ("title", "summary", "source", "translated", "metadata")


@pytest.fixture(scope="module")
def posts(spark):
    df = spark.createDataFrame(TEXTS, "id int, " + ", ".join(f"{c} string" for c in COLUMNS))
    return search.postings(df, "id", {c: F.col(c) for c in COLUMNS}).cache()


@pytest.fixture(scope="module")
def sqlite():
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, {', '.join(COLUMNS)}, tokenize='unicode61')")
    import re

    spaced = lambda t: re.sub(r"(?<=[一-鿿])(?=[一-鿿])", " ", t)
    con.executemany("INSERT INTO f VALUES (?,?,?,?,?,?)", [(r[0], *map(spaced, r[1:])) for r in TEXTS])
    return con


@pytest.mark.parametrize("text", ["deep", "graph networks", "deep OR coffee", "graph AND deep OR cafe", "networks deep", "深度", "2020", "nothing"])
def test_scores_as_sqlite_gives_them(spark, posts, sqlite, text):
    q = " ".join(search.rewritten(text))
    want = dict(sqlite.execute("SELECT id, bm25(f, 0.0, 3.0, 1.0, 1.0, 2.0, 1.0) FROM f WHERE f MATCH ?", (q,)).fetchall())
    got = {r["id"]: r.score for r in search.ranked(posts, "id", search.parse(text)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert {r["id"] for r in search.matching(posts, "id", search.parse(text)).collect()} == set(want)


def test_phrases_and_snippet_column(posts, sqlite):
    q = search.TextQuery((("graph", "networks"),), ((0,),))
    want = {r[0] for r in sqlite.execute("SELECT id FROM f WHERE f MATCH '\"graph networks\"'")}
    assert {r["id"] for r in search.matching(posts, "id", q).collect()} == want == {1, 3}
    assert {r["id"]: r.col for r in search.best_column(posts, "id", q).collect()} == {1: "summary", 3: "source"}


def test_rewriting():
    assert search.rewritten("深度学习 transformer") == ['"深 度 学 习"', '"transformer"']
    assert search.rewritten("AND a or OR b and") == ['"a"', "OR", '"b"']
    assert search.rewritten("café，title:x") == ['"cafe"', '"titlex"']
    assert search.parse("") == search.TextQuery((), ())
    assert search.parse("a b OR a c").groups == ((0, 1), (0, 2))


def test_empty_query(posts):
    assert search.ranked(posts, "id", search.parse("…")).count() == 0


def test_query_language():
    T = dsl.Term
    assert dsl.parse_query("") == [[]]
    assert dsl.parse_query('tag:ml "deep net" -venue:icml OR year:2020..2021') == [[T("tag", "ml"), T(None, "deep net"), T("venue", "icml", True)], [T("year", "2020..2021")]]
    assert dsl.parse_query('"OR" x "-y"') == [[T(None, "x"), T(None, "y", True)]]
    assert dsl.parse_query("foo:bar title:") == [[T(None, "foo:bar"), T(None, "title:")]]
    assert dsl.words('a"b c"d e') == ["ab cd", "e"]


def library(spark):
    rows = [(1, "Deep Nets", ["Ann Lee"], ["ml", "vision"], "ICML", "2020", "01"), (2, "Shallow", ["Bo Li", "Ann"], ["MLOps"], "Journal", "1999", "unknown"), (3, "", [], [], "", "unknown", "unknown")]
    df = spark.createDataFrame(rows, "id int, title string, authors array<string>, tags array<string>, venue string, year string, month string")
    c = F.col
    return df, dsl.Library(c("title"), c("authors"), c("tags"), c("venue"), c("year"), c("month"))


@pytest.mark.parametrize(
    "text, ids",
    [("", {1, 2, 3}), ("tag:ml", {1}), ("tag:mlo", {2}), ("tag:visi", {1}), ("author:ann", {2}), ("author:lee", {1}), ("-tag:ml", {2, 3}), ("year:2021..2000", {1}), ("year:19", {2}), ("year:2020", {1}), ("month:01", {1}), ("venue:ic", {1}), ("nets icml", {1}), ("deep OR shallow", {1, 2}), ('"nets icml"', {1}), ("year:x..y", set())],
)
def test_search_language(spark, text, ids):
    df, lib = library(spark)
    assert {r["id"] for r in dsl.search(df, text, lib).collect()} == ids


def test_filters(spark):
    f = dsl.parse_filters('pdf:yes,0 source:has no:translated has:summary,bogus tmpl:A,b template:"c d" junk')
    assert f.presence == {"pdf": {"with", "without"}, "source": {"with"}, "translated": {"without"}, "summary": {"with"}} and f.templates == {"a", "b", "c d"}
    assert dsl.allowed(["yes", "no"]) is None and dsl.allowed([]) is None and dsl.allowed(["has"]) == {"with"}
    assert dsl.merged({"with"}, {"without"}) == set() and dsl.merged(None, {"with"}) == {"with"}
    df = spark.createDataFrame([(1, True), (2, False)], "id int, p boolean")
    ids = lambda w: {r["id"] for r in df.where(dsl.presence_condition(w, F.col("p"))).collect()}
    assert ids({"with"}) == {1} and ids({"without"}) == {2} and ids(set()) == ids(None) == {1, 2}


def test_years_and_sorts(spark):
    df, lib = library(spark)
    y = F.col("year").try_cast("int")
    assert {r["id"] for r in df.where(dsl.year_expression("-2000", y)).collect()} == {2}
    assert {r["id"] for r in df.where(dsl.year_expression("2000-", y)).collect()} == {1}
    with pytest.raises(ValueError):
        dsl.year_expression("-", y)
    by = lambda *o: [r["id"] for r in df.orderBy(*o).collect()]
    assert by(*dsl.library_sort("title", "asc", lib, F.col("id"))) == [1, 2, 3] and by(*dsl.library_sort("title", "desc", lib, F.col("id"))) == [2, 1, 3]
    assert by(*dsl.search_sort("year_asc", lib.title, lib.venue, lib.year)) == [2, 1, 3]
    with pytest.raises(ValueError):
        dsl.search_sort("best", lib.title, lib.venue, lib.year)
