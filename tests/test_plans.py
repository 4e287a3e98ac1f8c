import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import docops, facets
from paperloom.plans import snapshot, storage, workflow
from paperloom.queries import papers
from paperloom.sources import readers, sinks
from paperloom.streaming import incremental

D = "/root/testdata/sf0.001"


def test_snapshot_build_update_and_read(spark, tmp_path):
    base = papers(spark, D)
    old = snapshot.build(base.where("ordinal < 100"), "b1", "2024-01-01")
    n = old["paper"].count()
    assert n == old["paper"].select("paper_id").distinct().count() and old["paper"].agg(F.max("paper_index")).first()[0] == n
    assert old["year_count"].agg(F.sum("paper_count")).first()[0] == n
    root = f"file://{tmp_path}/snap"
    old.write(root, "b1")
    again = snapshot.read(spark, root)
    new = snapshot.update(again, base, "b2", "2024-01-02")
    whole = snapshot.build(base, "b3", "2024-01-03")
    ids = lambda s: {r[0] for r in s["paper"].select("paper_id").collect()}
    assert ids(again) < ids(new) == ids(whole)
    edges = lambda s: s["facet_edge"].join(s["facet_node"].select(F.col("node_id").alias("node_id_a"), F.col("value").alias("a")), "node_id_a").join(s["facet_node"].select(F.col("node_id").alias("node_id_b"), F.col("value").alias("b")), "node_id_b").select("a", "b", "paper_count")
    assert set(map(tuple, new["facet_node"].select("value", "paper_count").collect())) >= {("stub", len(ids(whole)))}
    assert edges(whole).count() > 0 and all(r.node_id_a < r.node_id_b for r in whole["facet_edge"].limit(50).collect())
    # identity is inherited: another title under the same DOI keeps its id
    same = snapshot.build(base.withColumn("title", F.lit("new title")).where("ordinal % 5 = 0"), "b4", "x", whole["paper_key_alias"])
    assert ids(same) <= ids(whole)


def test_migrate_and_previous(spark, tmp_path):
    legacy = spark.createDataFrame([("p", "https://doi.org/10.1/X", "")], "paper_id string, doi string, year string")
    r = snapshot.migrate(legacy).first()
    assert r.doi == "10.1/x" and r.year == "unknown" and r.month == "unknown" and set(r.asDict()) == set(snapshot.PAPER_COLUMNS)
    legacy.drop("doi").write.parquet(f"file://{tmp_path}/old")
    assert readers.previous(spark, f"file://{tmp_path}/old", {"paper_id": "string", "doi": "string"}).first().doi is None
    assert readers.previous(spark, f"file://{tmp_path}/none", {"paper_id": "string"}).count() == 0


def test_unpacking(spark):
    paper = spark.createDataFrame([("p1", "T", "h1", "deep"), ("p2", "T", None, "simple")], "paper_id string, title string, pdf_content_hash string, preferred_summary_template string")
    pdfs = spark.createDataFrame([("h1", "/x/Some File.pdf")], "sha256 string, path string")
    assert {r.paper_id: r.name for r in snapshot.unpack_names(paper, pdfs).collect()} == {"p1": "Some File", "p2": "T"}
    sums = spark.createDataFrame([("p1", "deep", "a"), ("p2", "simple", "b")], "paper_id string, template_tag string, text string")
    assert snapshot.unpack_summaries(paper, sums, "deep", True).count() == 1
    assert {tuple(r) for r in snapshot.unpack_summaries(paper, sums, "deep", False).collect()} == {("p1", "deep", "a"), ("p2", "simple", "b")}
    known = spark.createDataFrame([("h1", "/a.md")], "hash string, path string")
    assert {tuple(r) for r in snapshot.missing_paths(paper.withColumn("md", F.coalesce("pdf_content_hash", F.lit("zz"))), "md", known).select("paper_id", "path").collect()} == {("p1", "/a.md"), ("p2", "zz.md")}


def test_stages():
    S = workflow.Stage
    assert workflow.levels([S("a"), S("b"), S("c", depends_on=("a",))]) == [["a"], ["b", "c"]]
    with pytest.raises(ValueError, match="unknown"):
        workflow.levels([S("a", depends_on=("q",))])
    with pytest.raises(ValueError, match="circle"):
        workflow.levels([S("a", depends_on=("b",)), S("b", depends_on=("a",))])
    assert workflow.object_in('x ```json\n{"a": 1}\n```') == {"a": 1} and workflow.object_in('{"a": 1') == {"a": 1} and workflow.object_in("no") is None


def test_workflow_reuses_what_did_not_change(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(1, 5)], "id long, text string")
    stages = [workflow.Stage("one", ("a",)), workflow.Stage("two", ("a", "b"))]
    run = workflow.run_stages(docs, "id", "text", stages, workflow.echo)
    assert run.asked == {"one": 4, "two": 4} and run.errors.isEmpty()
    assert json.loads({r["id"]: r.record for r in run.merged.collect()}[3]) == {"a": "two:a:3", "b": "two:b:3"}
    changed = docs.withColumn("text", F.when(F.col("id") == 2, "new").otherwise(F.col("text")))
    assert workflow.run_stages(changed, "id", "text", stages, workflow.echo, state=run.state).asked == {"one": 1, "two": 1}
    assert workflow.run_stages(docs, "id", "text", stages, workflow.echo, state=run.state, force=True).asked == {"one": 4, "two": 4}
    bad = workflow.run_stages(docs, "id", "text", stages, lambda r: "{}" if r["stage"] == "one" and len(r["text"]) == 1 else workflow.echo(r))
    assert {(r["id"], r.stage, r.error) for r in bad.errors.collect()} == {(1, "one", "missing a")} and bad.asked["two"] == 3


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"template_tag": "simple", "papers": [{"paper_title": "T", "paper_authors": "A, B", "x": 1}, {"paper_title": "U", "paper_authors": ["C"]}]}))
    rows = readers.records(readers.bundles(spark, str(tmp_path / "a.json"))).orderBy("ordinal").collect()
    assert [(r.paper_title, r.authors, r.template_tag) for r in rows] == [("T", ["A", "B"], "simple"), ("U", ["C"], "simple")]
    (tmp_path / "b.json").write_text('[{"paper_title": "L", "summary": "s"}]')
    loose = readers.bundles(spark, str(tmp_path / "b.json"), strict=False)
    assert readers.inferred_tag(loose, {"other": ["z"], "simple": ["summary"]}).first().template_tag == "simple"
    with pytest.raises(Exception, match="not a bundle"):
        readers.bundles(spark, str(tmp_path / "b.json")).collect()
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "one.md").write_bytes("é".encode())
    (tmp_path / "m" / "two.en.md").write_bytes("é".encode("latin-1"))
    assert [r.text for r in readers.markdown(spark, str(tmp_path / "m")).collect()] == ["é", "é"]
    listed = readers.files(spark, str(tmp_path / "m"))
    assert tuple(readers.translations(listed).first())[:2] == ("two", "en")
    assert readers.roots_summary(listed, [str(tmp_path), str(tmp_path / "m")]).first().root == str(tmp_path / "m")
    (tmp_path / "l.txt").write_text(" a.md \n\n/b.md\n")
    assert [r.path for r in readers.path_list(spark, str(tmp_path / "l.txt"), "/base").collect()] == ["/base/a.md", "/b.md"]


def test_bibtex(spark, tmp_path):
    text = '@comment{x}\n@Article{k1, title = {A {Nested} Title}, year = 2020, author = "Lee, Ann and Bo Kim", note = "a" # {b}}\n@inproceedings{k2, title={T}}'
    found = list(readers.parse_bibtex(text))
    assert [e["key"] for e in found] == ["k1", "k2"] and found[0]["fields"] == {"title": "A {Nested} Title", "year": "2020", "note": "ab"}
    assert found[0]["persons"] == {"author": ["Lee, Ann", "Bo Kim"]} and found[0]["type"] == "article"
    (tmp_path / "x.bib").write_text(text + "\n@article{k1, title={short}}")
    entries = readers.bibtex(spark, str(tmp_path / "x.bib"))
    assert {r.key: r.fields["title"] for r in sinks.bibtex_merged(entries).collect()} == {"k1": "A {Nested} Title", "k2": "T"}
    back = entries.where("key = 'k2'").select(readers.bibtex_text(F.col("key"), F.col("type"), F.col("fields"))).first()[0]
    assert back == "@inproceedings{k2,\n  title = {T}\n}"


def test_schemas():
    spec = {"type": "object", "required": ["paper_title", "paper_authors"], "properties": {"paper_title": {"type": "string"}, "paper_authors": {"type": "array", "items": {"type": "string"}}, "n": {"type": ["integer", "null"]}}}
    assert readers.struct_of(readers.required_schema(json.dumps(spec))).simpleString() == "struct<paper_title:string,paper_authors:array<string>,n:bigint>"
    with pytest.raises(ValueError):
        readers.required_schema('{"type": "object"}')


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "beta"), (2, ""), (3, "alpha")], "id long, t string")
    assert {r["id"]: r.part for r in sinks.split(df, "alphabetical", "t", "id").collect()} == {1: "B", 2: "#", 3: "A"}
    with pytest.raises(ValueError):
        sinks.split(df, "weight", "t", "id")
    path = f"file://{tmp_path}/blobs"
    sinks.write_new_blobs(sinks.blobs(df, F.col("t").cast("binary")), path)
    sinks.write_new_blobs(sinks.blobs(df.withColumn("t", F.lit("beta")), F.col("t").cast("binary")), path)
    assert spark.read.parquet(path).count() == 3
    assert [r[0] for r in df.select(sinks.rendered(df, "# {t} ({id})", df.columns)).collect()] == ["# beta (1)", "#  (2)", "# alpha (3)"]


def test_letters_of_titles_are_one_character_as_in_sql(spark, tmp_path):
    import duckdb

    from paperloom.queries import QUERIES, SQL

    odd = ["ß und", "ŉ a", "ᾳ b", "ǆ", "ﬁ", "\u00a0x", "\nbody", " \nbody", "  ", "", None, "# head", "\tq", "é", "ÿ"]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.connect().execute(SQL["split_letter"].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert dict(map(tuple, QUERIES["split_letter"](spark, str(tmp_path)).select("doc_id", "part").collect())) == dict(want)


def test_facet_names_and_pages(spark):
    assert facets.facet_type("Templates") == "summary_template" and facets.facet_type("authors") == "author" and facets.facet_type("translations") == "translation_lang"
    with pytest.raises(ValueError):
        facets.facet_type("colour")
    with pytest.raises(ValueError):
        facets.page(spark.range(3), 1, 101)
    pairs = facets.incidence(spark.createDataFrame([(1, ["A", " a "], "X"), (2, None, "unknown")], "id int, l array<string>, v string"), "id", {"tag": F.col("l"), "venue": F.col("v")})
    assert {tuple(r) for r in pairs.collect()} == {(1, "tag", "a"), (1, "venue", "x")}
    assert facets.related_by_type(pairs, "id", "tag", "none").count() == 0


def test_stream_appends_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 01:00:00")], "event_id long, ts string")
    rows.write.parquet(f"{tmp_path}/in")
    seen = []
    for _ in range(2):
        q = incremental.maintain(incremental.new_rows(spark, f"{tmp_path}/in", "event_id long, ts string", "event_id", "ts"), f"{tmp_path}/out", f"{tmp_path}/cp", "event_id", lambda df: seen.append(df.count()))
        q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").select("event_id").distinct().count() == spark.read.parquet(f"{tmp_path}/out").count() == 2
    spark.createDataFrame([(2, "2024-01-01 02:00:00"), (3, "2024-01-01 02:00:00")], "event_id long, ts string").write.mode("append").parquet(f"{tmp_path}/in")
    incremental.maintain(incremental.new_rows(spark, f"{tmp_path}/in", "event_id long, ts string", "event_id", "ts"), f"{tmp_path}/out", f"{tmp_path}/cp", "event_id").awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_layouts(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name / "images").mkdir(parents=True)
        (tmp_path / name / "full.md").write_text(f"# {name}\n\n![x](data:image/png;base64,AAEC)\n")
        (tmp_path / name / "images" / "a.png").write_bytes(b"\0")
    found = readers.layouts(spark, str(tmp_path))
    assert sorted(r.folder.rsplit("/", 1)[1] for r in found.collect()) == ["one", "two"]
    texts, files = docops.unpacked(found, "folder", "text")
    assert files.count() == 1 and all(files.first()["name"] in r.text for r in texts.collect())


def test_cached_scans_follow_their_files(spark, tmp_path):
    import os

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("a")
    runs = []

    def scan():
        def build():
            runs.append(1)
            return readers.markdown(spark, str(tmp_path / "in"))

        return storage.cached(readers.files(spark, str(tmp_path / "in")), build, f"file://{tmp_path}/cache").collect()

    assert [r.text for r in scan()] == [r.text for r in scan()] == ["a"] and len(runs) == 1
    (tmp_path / "in" / "b.md").write_text("b")
    assert [r.text for r in scan()] == ["a", "b"] and len(runs) == 2
    os.utime(tmp_path / "in" / "a.md", (1, 1))
    scan()
    assert len(runs) == 3


def test_readers_see_a_whole_build(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    made = []

    def lazily():
        made.append(1)
        return spark.range(3)

    first = snapshot.Snapshot({"paper": spark.range(1), "author": lazily})
    assert not made and first["author"].count() == 3 and first["author"].count() == 3 and made == [1]
    first.write(root, "b1")
    spark.range(9).write.parquet(f"{root}/b2/paper")  # a build that is not ready
    assert snapshot.read(spark, root)["paper"].count() == 1
    snapshot.Snapshot({"paper": spark.range(2)}).write(root, "b2")
    assert snapshot.read(spark, root)["paper"].count() == 2


def test_a_shared_folder_is_asked_for_on_a_cluster():
    class Conf(dict):
        def get(self, key, other=None):
            return dict.get(self, key, other)

        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.master": "spark://somewhere:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)
    Session.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert storage.shared_dir(Session) == "hdfs://x/y"


def test_ranks_do_not_need_a_task_for_a_frequent_beginning(spark):
    from paperloom.operators import ranking

    df = spark.range(4000).selectExpr("id", "IF(id % 10 < 9, concat('https://', lpad(id, 5, '0')), NULL) AS t", "IF(id % 4 = 0, 'b', NULL) AS g")
    want = {r.id: (i,) for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.t is not None, r.t or "")), 1)}
    got = {r.id: r["rank"] for r in ranking.global_rank(df, "t").collect()}
    assert sorted(got.values()) == list(range(1, 4001)) and all(got[i] == want[i][0] for i in got if i % 10 < 9)
    within = {}
    for r in ranking.global_rank(df, "id", "rank", ["g"]).collect():
        within.setdefault(r.g, []).append((r["rank"], r.id))
    assert all([k for k, _ in sorted(v)] == list(range(1, len(v) + 1)) and [i for _, i in sorted(v)] == sorted(i for _, i in v) for v in within.values())
    hot = spark.range(3000).selectExpr("id", "IF(id % 10 < 9, 'same', concat('own', id)) AS base")
    names = [r["name"] for r in ranking.unique_names(hot, "base", "id").collect()]
    assert len(set(names)) == 3000 and "same" in names and "same_2699" in names
