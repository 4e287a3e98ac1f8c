import json

import pytest
from pyspark.sql import functions as F

from paperloom import api, cli
from paperloom.operators import linkage as L
from paperloom.operators import records as R
from paperloom.plans import snapshot
from paperloom.queries import papers

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library(spark):
    base = papers(spark, D).withColumn("bibtex_raw", F.when(F.col("ordinal") == 5, "@a{k}")).withColumn("bibtex_key", F.lit("k"))
    return api.Library(snapshot.build(base, "b1", "now"), "https://s.org/")


def test_search_pages_and_sorts(library):
    every = library.search()
    assert every.total == library.papers.count() and len(every.items) == 20 and every.has_more
    years = [int(i["year"]) for i in every.items]
    assert years == sorted(years, reverse=True)
    second = library.search(page=2)
    assert not {i["paper_id"] for i in second.items} & {i["paper_id"] for i in every.items}
    found = library.search("the OR de")
    assert 0 < found.total <= every.total and all("[[[" in i["snippet"] or i["snippet"] for i in found.items)
    scores = [i["score"] for i in found.items]
    assert scores == sorted(scores)
    assert library.search("zzzznothing").items == []
    for bad in ({"text": "x" * 501}, {"page_size": 101}, {"page": 0}, {"page": 101, "page_size": 100}, {"sort": "best"}, {"sort": "relevance"}):
        with pytest.raises(ValueError):
            library.search(**bad)


def test_details(library):
    ident = library.papers.where("doi = '10.1/5'").first().paper_id
    one = library.paper(ident)
    assert one["doi"] == "10.1/5" and one["templates"] == ["simple"] and one["has_source"] and not one["has_pdf"] and one["pdf_url"] is None
    assert one["summary_urls"]["simple"] == f"https://s.org/summary/{ident}/simple.json?v=b1" and one["authors"]
    assert library.bibtex(ident)["bibtex_raw"] == "@a{k}"
    for call, error in ((lambda: library.paper("none"), api.NotFound), (lambda: library.paper("../x"), ValueError), (lambda: library.bibtex("none"), api.NotFound)):
        with pytest.raises(error):
            call()


def test_facets_and_tools(library):
    venues = library.facet("venues")
    counts = [i["paper_count"] for i in venues.items]
    assert counts == sorted(counts, reverse=True)
    top = venues.items[0]
    assert library.facet_papers("venue", top["value"].upper()).total == top["paper_count"]
    stats = library.facet_stats("venue", top["value"])
    assert stats["total"] == top["paper_count"] and {"author", "year"} <= set(stats["related"])
    assert library.facet_stats("venue", "none") == {"total": 0, "related": {}}
    whole = library.stats()
    assert whole["total"] == library.papers.count() and len(whole["venue"]) <= 20
    assert all(r["year"] == "1995" for r in library.filter(year="1995", limit=5)) and library.filter(author="author fr", tag="q", limit=200)
    assert library.top_facets("output_languages", 1) == [{"value": "en", "paper_count": whole["total"]}]
    assert library.keyword_search("en", 3)


def test_file_guesses_and_stubs(spark):
    files = spark.createDataFrame([("/p/Lee - 2020 - Deep Graph Networks Again.pdf", "Lee - 2020 - Deep Graph Networks Again.pdf"), ("/p/x.pdf", "x.pdf"), ("/p/y_++.pdf", "y_++.pdf"), ("/p/2019 - Alone.pdf", "2019 - Alone.pdf")], "path string, name string")
    recs = spark.createDataFrame([(1, "Deep graph networks again", ["Ann Lee"], "2020", None), (2, "q", [], None, "/m/X.pdf-0123abcd9.md"), (3, "q", [], None, "/m/y.md"), (4, "w", [], None, "/m/none.md")], "id int, title string, authors array<string>, year string, source_path string")
    got = R.matched_files(recs, "id", files)
    assert {r.ident: r.target for r in got.collect()} == {1: "/p/Lee - 2020 - Deep Graph Networks Again.pdf", 2: "/p/x.pdf", 3: "/p/y_++.pdf"}
    (stub,) = R.stubs(files, got).collect()
    assert (stub.title, stub.publication_date, stub.pdf_only) == ("Alone", "2019", True)
    assert recs.select(R.relative_path(F.col("source_path"), ["/m"])).collect()[1][0] == "X.pdf-0123abcd9.md"


def test_references_and_templates(spark):
    recs = spark.createDataFrame([(1, "t", None), (2, "t", "much more"), (3, "u", "x")], "id int, title string, summary string")
    matches = spark.createDataFrame([(1, "r1", "title", 1.0), (2, "r1", "title", 1.0), (3, "r2", "title", 0.5)], "ident int, target string, match_type string, score double")
    assert sorted(r.id for r in R.best_for_reference(matches, recs, "id", {"title": "string", "summary": "string"}).collect()) == [2, 3]
    base = spark.createDataFrame([(1, "a", None), (2, "b", "s")], "id int, title string, summary string")
    other = spark.createDataFrame([(7, "a", "new"), (8, "z", "w"), (9, "c", "q")], "id int, title string, summary string")
    whole, skipped, diffs = R.templates_merged(base, [("deep", other, spark.createDataFrame([(7, 1), (9, 2)], "ident int, target int"))], "id", ["title", "summary"])
    assert {tuple(r) for r in whole.collect()} == {(1, "a", "new"), (2, "b", "s")}
    assert [r.ident for r in skipped.collect()] == ["8"] and {tuple(r) for r in diffs.collect()} == {("deep", "title", 1), ("deep", "summary", 1)}
    posts = L.targets(spark.createDataFrame([(1, "one title", "2020", "lee")], "id int, t string, y string, a string"), "id", "id", F.col("t"), F.col("y"), F.col("a"))
    q = spark.createDataFrame([("x", "unlike", "2020", "kim"), ("y", "one title", None, None), ("z", "q", "1999", None)], "id string, t string, y string, a string")
    got = {r.ident: (r.target, r.match_type, r.score) for r in R.relaxed(L.queries(q, "id", F.col("t"), F.col("y"), F.col("a")), posts).collect()}
    assert got == {"x": (1, "year_relaxed", 0.0), "y": (1, "title", 1.0)}


def test_command_line(spark, tmp_path, capsys):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text(json.dumps({"template_tag": "simple", "papers": [{"paper_title": "One title", "paper_authors": ["A"], "publication_date": "2020-05", "source_hash": "h1", "ai_generated_tags": ["ml"], "summary": "about graphs"}, {"paper_title": "Two", "paper_authors": "B, C", "publication_date": "2019"}]}))
    b.write_text(json.dumps({"template_tag": "simple", "papers": [{"paper_title": "One title", "paper_authors": ["A"], "source_hash": "h1"}, {"paper_title": "Three", "paper_authors": ["D"]}]}))
    root = f"file://{tmp_path}/snap"
    cli.main(["build", str(a), "--root", root, "--build-id", "b1"])
    cli.main(["update", str(a), str(b), "--root", root, "--build-id", "b2"])
    cli.main(["search", "graphs", "--root", root])
    found = json.loads(capsys.readouterr().out)
    assert found["total"] == 1 and found["items"][0]["title"] == "One title"
    cli.main(["compare", str(a), str(b), "--out", f"file://{tmp_path}/cmp"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/cmp").where("side = 'MATCH'").first().match_score == "1.0000"
    cli.main(["split", str(a), "--out", f"file://{tmp_path}/split", "--by", "year"])
    assert {p.name for p in (tmp_path / "split").iterdir() if p.is_dir()} == {"part=2020", "part=2019"}
    (tmp_path / "x.md").write_text("see [1]")
    cli.main(["fix", str(tmp_path / "x.md"), "--out", f"file://{tmp_path}/fixed"])
    assert spark.read.json(f"file://{tmp_path}/fixed").first().text == "see [^1]"
