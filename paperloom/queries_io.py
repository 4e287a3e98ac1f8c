"""Queries for sources and sinks: the documents are written as files of every kind to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.functions.textudf import title_key_col
from paperloom.operators import records
from paperloom.plans import export, snapshot, storage, workflow
from paperloom.queries import docs, query
from paperloom.queries_docs import ident
from paperloom.sources import readers, sinks

#: Documents in one file.
IN_FILE = 100


def folder(spark: SparkSession, label: str) -> str:
    return f"{storage.shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def in_files(df: DataFrame, line: Column, joined: str = "\n", head: Column | str = "", tail: Column | str = "") -> str:
    """One file for every IN_FILE documents, of their lines in order; returns the folder."""
    spark, path = df.sparkSession, folder(df.sparkSession, "files")
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    each = df.select(F.floor(F.col("doc_id") / IN_FILE).alias("file"), "doc_id", line.alias("line"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line"))), lambda x: x.line), joined)
    files = each.groupBy("file").agg(whole.alias("body")).select(F.concat(lit(head), "body", lit(tail)).alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(path)
    return path


# Bundles


def papers_json() -> Column:
    authors = F.array(F.concat(F.lit("Ann "), "lang"), F.lit("Bo"))
    return F.to_json(F.struct(F.col("text").alias("paper_title"), authors.alias("paper_authors"), F.concat(F.lit("a; b,"), "lang").alias("keywords"), F.sha2("text", 256).alias("source_hash"), F.lit("deep").alias("prompt_template"), "doc_id"))


@query("SELECT doc_id, 't1' AS template_tag, doc_id % 100 AS ordinal, text AS paper_title, sha256(text) AS source_hash, 'Ann ' || lang || '|Bo' AS authors, 'a|b|' || lang AS keywords FROM documents")
def bundles_strict(spark, d):
    path = in_files(docs(spark, d), papers_json(), ",\n", '{"template_tag": " t1 ", "papers": [\n', "\n]}")
    found = readers.records(readers.bundles(spark, path))
    return found.select(F.get_json_object("raw", "$.doc_id").cast("long").alias("doc_id"), "template_tag", F.col("ordinal").cast("long").alias("ordinal"), "paper_title", "source_hash", F.array_join("authors", "|").alias("authors"), F.array_join("keyword_list", "|").alias("keywords"))


@query("SELECT doc_id, 'deep' AS template_tag, text AS paper_title FROM documents")
def bundles_lenient(spark, d):
    """Bare lists, and a file that is none; the tag is what all records of a file name."""
    path = in_files(docs(spark, d), papers_json(), ",", "[", "]")
    spark.sql("SELECT '{\"broken' AS value").write.mode("append").text(path)
    found = readers.inferred_tag(readers.bundles(spark, path, strict=False), {"simple": ["paper_title"], "deep": ["module_a"]})
    return readers.records(found).select(F.get_json_object("raw", "$.doc_id").cast("long").alias("doc_id"), "template_tag", "paper_title")


@query("SELECT doc_id, CASE WHEN doc_id // 100 % 2 = 0 THEN 'simple' ELSE 'deep' END AS template_tag FROM documents")
def bundles_inferred(spark, d):
    """Tags from the schema that shares most keys with a file's records."""
    even = F.floor(F.col("doc_id") / IN_FILE) % 2 == 0
    line = F.when(even, F.to_json(F.struct("doc_id", F.lit("s").alias("summary")))).otherwise(F.to_json(F.struct("doc_id", F.lit("x").alias("module_a"), F.lit("y").alias("module_b"))))
    path = in_files(docs(spark, d), line, ",", '{"papers": [', "]}")
    found = readers.inferred_tag(readers.bundles(spark, path), {"simple": ["paper_title", "summary"], "deep": ["paper_title", "module_a", "module_b"]})
    return found.select(F.get_json_object("raw", "$.doc_id").cast("long").alias("doc_id"), "template_tag")


# Texts, listings, lists


@query("SELECT string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY doc_id // 100")
def markdown_scan(spark, d):
    return readers.markdown(spark, in_files(docs(spark, d), F.col("text")), glob="*.txt").select("text")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'café ' || doc_id END AS text FROM documents")
def text_decoded(spark, d):
    latin = F.concat(F.encode(F.lit("café "), "ISO-8859-1"), ident().cast("binary"))
    return docs(spark, d).select("doc_id", readers.decoded(F.when(F.col("doc_id") % 2 == 0, F.col("text").cast("binary")).otherwise(latin)).alias("text"))


@query("SELECT count(*) AS files, sum(size)::BIGINT AS size FROM (SELECT sum(strlen(text) + 1) AS size FROM documents GROUP BY doc_id // 100)")
def files_listed(spark, d):
    path = in_files(docs(spark, d), F.col("text"))
    local = path.replace("file://", "").replace("file:", "")
    return readers.roots_summary(readers.files(spark, path, "*.txt"), [local, "/nowhere"]).select("files", "size")


@query("SELECT doc_id, doc_id % 4 < 2 AS pdf FROM documents")
def pdf_like(spark, d):
    ends = F.element_at(F.array(*map(F.lit, [".PDF", ".pdf-0a1b2c3d", ".pdf-0a1b.md", ".txt"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, d).select("doc_id", S.is_pdf_like(F.concat("source", ends)).alias("pdf"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id WHEN doc_id % 3 = 1 THEN NULL ELSE source END AS title FROM documents")
def pdf_titles(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Microsoft Word - Title "), ident(), F.lit(".PDF "))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("File"), ident())).otherwise(F.concat(F.lit("untitled "), "source"))
    return docs(spark, d).select("doc_id", S.embedded_title(raw, F.concat(F.lit("file"), ident(), F.lit(".pdf"))).alias("title"))


@query("SELECT sha256(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS sha256 FROM documents GROUP BY doc_id // 100")
def hash_index(spark, d):
    return readers.hash_index(spark, in_files(docs(spark, d), F.col("text")), "*.txt").select("sha256")


@query("SELECT lower(source) || '_' || (doc_id % 100) AS base, lang, '/t/' || min(lpad(doc_id::VARCHAR, 9, '0')) || '.md' AS path FROM documents GROUP BY 1, 2")
def translations_listed(spark, d):
    name = F.concat(F.upper("source"), F.lit("_"), (F.col("doc_id") % 100).cast("string"), F.lit("."), F.upper("lang"), F.lit(".md"))
    listed = docs(spark, d).select(F.concat(F.lit("/t/"), F.lpad(ident(), 9, "0"), F.lit(".md")).alias("path"), name.alias("name"))
    return readers.translations(listed.unionByName(spark.sql("SELECT '/t/x' AS path, 'plain.md' AS name")))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN '/abs/' || doc_id ELSE '/base/rel/' || doc_id END AS path FROM documents")
def path_list(spark, d):
    line = F.concat(F.lit("  "), F.when(F.col("doc_id") % 2 == 0, "/abs/").otherwise("rel/"), ident(), F.lit("\t\n   "))
    return readers.path_list(spark, in_files(docs(spark, d), line), "/base/")


@query("SELECT '/p/' || source AS path, count(DISTINCT (doc_id % 7, lang)) AS targets FROM documents GROUP BY source")
def retry_report(spark, d):
    line = F.to_json(F.struct(F.concat(F.lit("/p/"), "source").alias("path"), (F.col("doc_id") % 7).alias("line"), F.col("lang").alias("field"), F.lit(0).alias("item")))
    found = readers.retry_targets(spark, in_files(docs(spark, d), line, ",", "[", "]"))
    each = found.select("path", F.explode("targets").alias("t")).distinct()
    return each.groupBy("path").agg(F.count(F.lit(1)).alias("targets"))


@query("""SELECT doc_id, 'article' AS type, 'title of ' || lang || ' ' || doc_id AS title_key, CASE WHEN doc_id % 2 = 0 THEN (1990 + doc_id % 30) END AS year, 'Ann ' || lang || '|Bo' AS authors FROM documents""")
def bibtex_scan(spark, d):
    year = F.when(F.col("doc_id") % 2 == 0, (F.lit(1990) + F.col("doc_id") % 30).cast("string")).otherwise("in press")
    line = F.concat(F.lit("@Article{k"), ident(), F.lit(",\n  title = {Title {of} "), "lang", F.lit(" "), ident(), F.lit('},\n year = "'), year, F.lit('",\n author = {Ann '), "lang", F.lit(" and Bo}\n}\n@comment{none}"))
    found = readers.bibtex(spark, in_files(docs(spark, d), line))
    year = F.when(F.col("fields")["year"].rlike(r"^\d+$"), F.col("fields")["year"].try_cast("long"))
    return found.select(F.substr("key", F.lit(2)).cast("long").alias("doc_id"), "type", title_key_col(F.col("fields")["title"]).alias("title_key"), year.alias("year"), F.array_join(F.col("persons")["author"], "|").alias("authors"))


@query("""SELECT doc_id, '@article{k' || doc_id || E',\n  title = {' || lang || E'},\n  year = {2020}\n}' AS entry FROM documents""")
def bibtex_text(spark, d):
    fields = F.create_map(F.lit("year"), F.lit("2020"), F.lit("title"), F.col("lang"))
    return docs(spark, d).select("doc_id", readers.bibtex_text(F.concat(F.lit("k"), ident()), F.lit("article"), fields).alias("entry"))


@query("SELECT 'paper_title' AS name, 'string' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'paper_authors', 'array<string>', count(*) FROM documents")
def schema_gate(spark, d):
    """Records read by the type that a JSON schema asks for; a schema without the required fields is an error."""
    spec = '{"type": "object", "required": ["paper_title", "paper_authors"], "properties": {"paper_title": {"type": "string"}, "paper_authors": {"type": "array", "items": {"type": "string"}}}}'
    kind = readers.struct_of(readers.required_schema(spec))
    parsed = docs(spark, d).select(F.from_json(papers_json(), kind).alias("r")).where("size(r.paper_authors) = 2 AND r.paper_title IS NOT NULL")
    n = parsed.agg(F.count(F.lit(1)).alias("n"))
    shown = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("kind")) for f in kind.fields])
    return n.select(F.explode(shown).alias("f"), "n").select("f.name", "f.kind", "n")


# Sinks


@query("SELECT doc_id, lang, text FROM documents")
def json_there_and_back(spark, d):
    path = folder(spark, "json")
    sinks.write_json(docs(spark, d).select("doc_id", "lang", "text"), path)
    return spark.read.schema("doc_id long, lang string, text string").json(path)


@query("SELECT lang AS part, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang")
def split_by_value(spark, d):
    path = folder(spark, "split")
    sinks.write_split(docs(spark, d).select("text", F.col("lang").alias("part")), path)
    return spark.read.json(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query("SELECT DISTINCT source AS value FROM documents")
def lines_written(spark, d):
    path = folder(spark, "lines")
    sinks.write_lines(docs(spark, d).select("source"), path)
    return spark.read.text(path)


@query("SELECT sha256(text) AS sha256, min(strlen(text)) AS bytes FROM documents GROUP BY 1")
def blobs_added_once(spark, d):
    """Half of the contents, then all: what is there is not written again."""
    path = folder(spark, "blobs")
    for part in (docs(spark, d).where("doc_id % 2 = 0"), docs(spark, d)):
        sinks.write_new_blobs(sinks.blobs(part, F.col("text").cast("binary")), path)
    return spark.read.parquet(path).select("sha256", F.octet_length("content").cast("long").alias("bytes"))


@query("SELECT '/r/' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN '/out/' || doc_id ELSE NULL END AS \"to\", CASE WHEN doc_id % 3 = 0 THEN strlen(text) END AS bytes FROM documents WHERE doc_id % 3 = 0")
def files_copied(spark, d):
    listed = docs(spark, d).select(F.concat(F.lit("/r/"), ident()).alias("path"))
    known = docs(spark, d).where("doc_id % 3 = 0").select(F.concat(F.lit("/r/"), ident()).alias("path"), F.col("text").cast("binary").alias("content"))
    return sinks.copied(listed, ["/r"], "/out", known)[0].select("path", "to", F.octet_length("content").cast("long").alias("bytes"))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'copied' ELSE 'missing' END AS outcome, count(*) AS n FROM documents GROUP BY 1")
def copies_counted(spark, d):
    listed = docs(spark, d).select(F.concat(F.lit("/r/"), ident()).alias("path"))
    known = docs(spark, d).where("doc_id % 3 = 0").select(F.concat(F.lit("/r/"), ident()).alias("path"), F.col("text").cast("binary").alias("content"))
    return sinks.copied(listed.unionByName(listed), ["/r"], "/out", known)[1]


@query("SELECT 'summary/' || doc_id || '.json' AS path, '{\"paper_id\":\"' || doc_id || '\"}' AS json FROM documents")
def documents_written(spark, d):
    path = folder(spark, "static")
    made = docs(spark, d).select(F.concat(F.lit("summary/"), ident(), F.lit(".json")).alias("path"), F.to_json(F.struct(ident().alias("paper_id"))).alias("json"))
    export.write_documents(made, path)
    return spark.read.schema("path string, json string").json(path)


@query("""SELECT doc_id::VARCHAR AS paper_id, source AS title, '2020' AS year, lang AS venue, '10.1/' || doc_id AS doi, CASE WHEN doc_id % 2 = 0 THEN 'k' || doc_id END AS bibtex_key, doc_id AS paper_index FROM documents""")
def static_index(spark, d):
    paper = docs(spark, d).select(ident().alias("paper_id"), F.col("source").alias("title"), F.lit("2020").alias("year"), F.col("lang").alias("venue"), F.concat(F.lit("10.1/"), ident()).alias("doi"), F.col("doc_id").alias("paper_index"))
    keys = docs(spark, d).where("doc_id % 2 = 0").select(ident().alias("paper_id"), F.concat(F.lit("k"), ident()).alias("bibtex_key"))
    return export.index(paper, keys)


@query("""SELECT 'manifest/' || doc_id || '.json' AS path, 'pdf/' || source || '.pdf' AS pdf, 'Ann_2020_T_' || lang || '.pdf' AS zip, CASE WHEN doc_id % 2 = 0 THEN 'md_translate/zh/m' || doc_id || '.md' END AS zh,
  'Ann_2020_T_' || lang || '_' || doc_id AS folder, 'available' AS status FROM documents""")
def static_manifests(spark, d):
    paper = docs(spark, d).select(ident().alias("paper_id"), F.concat(F.lit("T "), "lang").alias("title"), F.lit("2020").alias("year"), F.col("source").alias("pdf_content_hash"), F.lit("").alias("source_md_content_hash"))
    people = docs(spark, d).select(ident().alias("paper_id"), F.explode(F.array(F.lit("Bo"), F.lit("Ann"))).alias("value"))
    langs = docs(spark, d).where("doc_id % 2 = 0").select(ident().alias("paper_id"), F.lit("zh").alias("lang"), F.concat(F.lit("m"), ident()).alias("md_content_hash"))
    sums = docs(spark, d).select(ident().alias("paper_id"), F.lit("simple").alias("template_tag"))
    one = lambda status: docs(spark, d).select(ident().alias("paper_id"), F.lit("i.png").alias("path"), F.lit("s").alias("sha256"), F.lit("png").alias("ext"), F.lit(status).alias("status"))
    made = export.manifests(paper, people, langs, sums, one("missing").unionByName(one("available")))
    at = lambda p: F.get_json_object("json", p)
    return made.select("path", at("$.assets.pdf.static_path").alias("pdf"), at("$.assets.pdf.zip_path").alias("zip"), at("$.assets.translated_md[0].static_path").alias("zh"), at("$.folder_name").alias("folder"), at("$.images[0].status").alias("status"))


@query("SELECT doc_id, '/s/summary/' || doc_id || '/a%20b%2F' || lang || '.json?v=b1' AS url FROM documents")
def template_urls(spark, d):
    tag = F.replace(F.url_encode(F.concat(F.lit("a b/"), "lang")), F.lit("+"), F.lit("%20"))
    return docs(spark, d).select("doc_id", S.asset_url("/s", "summary", F.concat_ws("/", ident(), tag), "json", "b1").alias("url"))


# Snapshots as files


def small_snapshot(spark, d, keep: str) -> snapshot.Snapshot:
    paper = docs(spark, d).where(keep).select(ident().alias("paper_id"), "lang", F.sha2("text", 256).alias("source_hash"))
    return snapshot.Snapshot({"paper": paper, "snapshot_meta": spark.sql("SELECT 'snapshot_build_id' AS key, 'b' AS value")})


@query("SELECT doc_id::VARCHAR AS paper_id, lang, sha256(text) AS source_hash FROM documents")
def snapshot_written(spark, d):
    """Two builds in one place: readers see the newer, whole; the older stays as it was."""
    root = folder(spark, "snapshot")
    small_snapshot(spark, d, "doc_id % 2 = 0").write(root, "b1")
    small_snapshot(spark, d, "true").write(root, "b2")
    return snapshot.read(spark, root)["paper"]


@query("SELECT doc_id::VARCHAR AS paper_id, lang, NULL::VARCHAR AS doi FROM documents")
def snapshot_of_any_age(spark, d):
    """Columns that an old build lacks are null; a table that it lacks is empty."""
    root = folder(spark, "snapshot")
    path = small_snapshot(spark, d, "true").write(root, "b1")
    columns = {"paper_id": "string", "lang": "string", "doi": "string"}
    return readers.previous(spark, f"{path}/paper", columns).unionByName(readers.previous(spark, f"{path}/paper_alias", columns))


@query("SELECT doc_id, CASE WHEN lang IN ('de', 'fr') THEN 'file_' || lang || CASE WHEN r = 1 THEN '' ELSE '_' || lpad(doc_id::VARCHAR, 9, '0') END ELSE 'T_' || source || CASE WHEN s = 1 THEN '' ELSE '_' || lpad(doc_id::VARCHAR, 9, '0') END END AS name FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, row_number() OVER (PARTITION BY source, lang NOT IN ('de', 'fr') ORDER BY doc_id) AS s FROM documents)")
def unpack_names(spark, d):
    paper = docs(spark, d).select(F.lpad(ident(), 9, "0").alias("paper_id"), F.concat(F.lit("T: "), "source").alias("title"), F.col("lang").alias("pdf_content_hash"))
    pdfs = spark.sql("SELECT 'de' AS sha256, '/p/file_de.pdf' AS path UNION ALL SELECT 'fr', '/p/file_fr.pdf-0a1b2c3d4.md'")
    return snapshot.unpack_names(paper, pdfs).select(F.col("paper_id").cast("long").alias("doc_id"), "name")


@query("""SELECT (SELECT count(*) FROM documents WHERE doc_id % 2 = 1) AS mismatches, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 1 ORDER BY doc_id LIMIT 10)) AS samples""")
def doi_mismatches(spark, d):
    raw = F.concat(F.lit("@article{k, doi = {10.1/"), (F.col("doc_id") - F.col("doc_id") % 2).cast("string"), F.lit("}}"))
    found = snapshot.doi_mismatches(docs(spark, d), "doc_id", F.concat(F.lit("https://doi.org/10.1/"), ident()), raw)
    return found.select("mismatches", F.array_join("samples", ",").alias("samples"))


@query("""SELECT 'total' AS outcome, count(*) AS n FROM documents UNION ALL SELECT 'missing_pdf', count(*) FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT CASE lang WHEN 'de' THEN 'text_no_hash' WHEN 'fr' THEN 'text_file_missing' ELSE 'text_succeeded' END, count(*) FROM documents GROUP BY 1 UNION ALL SELECT 'text_failed', count(*) FROM documents WHERE lang IN ('de', 'fr')
  UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN 'translation_file_missing' ELSE 'translation_succeeded' END, count(*) FROM documents GROUP BY 1 UNION ALL SELECT 'translation_failed', count(*) FROM documents WHERE doc_id % 2 = 0""")
def unpack_outcomes(spark, d):
    paper = docs(spark, d).select(ident().alias("paper_id"), F.when(F.col("lang") != "de", F.col("lang")).alias("source_md_content_hash"), F.when(F.col("doc_id") % 5 != 0, "p").alias("pdf_content_hash"))
    trans = docs(spark, d).select(ident().alias("paper_id"), F.lit("zh").alias("lang"), F.when(F.col("doc_id") % 2 == 0, "gone").otherwise("here").alias("md_content_hash"))
    return snapshot.unpack_outcomes(paper, spark.sql("SELECT explode(array('en', 'es', 'here')) AS hash"), trans)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS made FROM documents")
def scan_cached(spark, d):
    """What was made of files is read again while these are what they were, and made anew for others."""
    store = folder(spark, "cache")
    listed = lambda keep: docs(spark, d).where(keep).select(F.concat(F.lit("/f/"), ident()).alias("path"), F.col("n_chars").alias("size"), F.lit("2024-01-01").cast("timestamp").alias("modified"))
    made = lambda keep, mark: lambda: docs(spark, d).where(keep).select("doc_id", F.lit(mark).alias("made"))
    even, odd = "doc_id % 2 = 0", "doc_id % 2 = 1"
    storage.cached(listed(even), made(even, "old"), store)
    return storage.cached(listed(even), made(even, "new"), store).unionByName(storage.cached(listed(odd), made(odd, "new"), store))


# Provenance, workflow


@query("""SELECT doc_id, '/d/' || doc_id || '.md' AS source_path, sha256(text) AS source_hash, 'p' AS provider, '2024-05-06T07:08:09Z' AS extracted_at, length(text) > 1000 AS source_truncated, CASE WHEN length(text) > 1000 THEN length(text) END AS original_chars FROM documents""")
def provenance(spark, d):
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    marked = records.with_provenance(docs(spark, d), F.concat(F.lit("/d/"), ident(), F.lit(".md")), F.col("text"), "p", "m", at, F.lit("simple"), F.lit("en"), 1000)
    return marked.select("doc_id", "source_path", "source_hash", "provider", "extracted_at", "source_truncated", F.col("truncation.original_chars").cast("long").alias("original_chars"))


@query("""SELECT doc_id, 3 AS line, strlen('{') + 1 + strlen('"id": ' || doc_id || ',') + 1 + strlen('"lang": "') + strlen(lang || ' x') AS "offset" FROM documents""")
def json_places(spark, d):
    raw = F.concat(F.lit('{\n"id": '), ident(), F.lit(',\n"lang": "'), "lang", F.lit(' x",\n"end": 1}'))
    found = docs(spark, d).select("doc_id", S.json_place(raw, F.concat("lang", F.lit(" x"))).alias("p"))
    return found.select("doc_id", "p.line", F.col("p.offset").cast("long").alias("offset"))


@query("""SELECT stage, n FROM (SELECT 'one' AS stage, count_if(doc_id % 2 = 1) AS n FROM documents UNION ALL SELECT 'two', count_if(doc_id % 2 = 1) FROM documents)""")
def workflow_reused(spark, d):
    """Documents whose stages are known from an earlier run are not asked for again."""
    stages = [workflow.Stage("one", ("a",)), workflow.Stage("two", ("b",))]
    first = workflow.run_stages(docs(spark, d).where("doc_id % 2 = 0"), "doc_id", "text", stages, workflow.echo)
    again = workflow.run_stages(docs(spark, d), "doc_id", "text", stages, workflow.echo, state=first.state)
    return spark.createDataFrame(list(again.asked.items()), "stage string, n long")


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE 'last' END AS last, CASE WHEN lang = 'de' THEN 'no object' END AS error FROM documents""")
def workflow_dependencies(spark, d):
    """Two first stages, one that needs both; it is not asked where one of them failed."""
    stages = [workflow.Stage("left", ("a",), ()), workflow.Stage("right", ("b",), ()), workflow.Stage("last", ("c",), ("left", "right"))]
    reply = lambda r: "no" if r["stage"] == "left" and r["text"] == "de" else workflow.echo(r)
    run = workflow.run_stages(docs(spark, d).select("doc_id", "lang"), "doc_id", "lang", stages, reply)
    last = run.state.where("stage = 'last'").select("doc_id", F.col("stage").alias("last"))
    return docs(spark, d).select("doc_id").join(last, "doc_id", "left").join(run.errors.select("doc_id", "error"), "doc_id", "left")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 1")
def documents_to_do(spark, d):
    """Inputs without an output, and of them those that a list of failures names."""
    todo = workflow.changed(docs(spark, d), docs(spark, d).where("doc_id % 3 = 0").select("doc_id"), ["doc_id"])
    return todo.join(docs(spark, d).where("doc_id % 3 < 2").select("doc_id"), "doc_id", "left_semi").select("doc_id")


@query("SELECT count(*) AS items, 'a,b,lang' AS fields FROM documents")
def merge_summary(spark, d):
    fields = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("lang"))).otherwise(F.array(F.lit("b")))
    return records.merge_summary(docs(spark, d), fields).select("items", F.array_join("fields", ",").alias("fields"))
