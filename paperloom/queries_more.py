"""Further queries: linkage against files and history, texts with built-in marks, exports, workflow and stream.

The driver's tables hold no files, links or marks, so each query builds its input from columns, as its SQL does.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.functions import textudf as U
from paperloom.operators import docops, linkage, ranking, records
from paperloom.plans import export, snapshot, storage, workflow
from paperloom.queries import docs, query, title
from paperloom.session import read_table
from paperloom.sources import sinks
from paperloom.streaming import incremental


@query("""SELECT doc_id AS ident, CASE WHEN doc_id % 2 = 0 THEN 'P' || doc_id ELSE 'B' || (doc_id % 50) END AS paper_id, 'doi:10.1/' || doc_id AS paper_key, 'doi' AS key_type,
  CASE WHEN doc_id % 2 = 0 THEN 'key_conflict:bib:k' || (doc_id % 50) || ' maps B' || (doc_id % 50) || ' vs P' || doc_id ELSE '' END AS conflict FROM documents""")
def identity_inherited(spark, d):
    text = F.col("doc_id").cast("string")
    k = (F.col("doc_id") % 50).cast("string")
    none = F.lit(None).cast("string")
    one = lambda n, kind, key: F.struct(F.lit(n).alias("strength"), F.lit(kind).alias("key_type"), key.alias("paper_key"), none.alias("fingerprint"))
    base = docs(spark, d).select("doc_id", F.array(one(4, "doi", F.concat(F.lit("doi:10.1/"), text)), one(2, "bib", F.concat(F.lit("bib:k"), k))).alias("c"))
    by_doi = docs(spark, d).where("doc_id % 2 = 0").select(F.concat(F.lit("doi:10.1/"), text).alias("paper_key"), F.concat(F.lit("P"), text).alias("paper_id"), none.alias("meta_fingerprint"))
    by_bib = spark.range(50).select(F.concat(F.lit("bib:k"), F.col("id").cast("string")).alias("paper_key"), F.concat(F.lit("B"), F.col("id").cast("string")).alias("paper_id"), none.alias("meta_fingerprint"))
    found = linkage.identities(base, "doc_id", F.col("c"), by_doi.unionByName(by_bib))
    return found.withColumn("conflict", F.array_join("conflicts", ";")).drop("conflicts")


@query("SELECT doc_id AS ident, substr(sha256('v1|arxiv:2301.' || lpad(doc_id::VARCHAR, 6, '0')), 1, 32) AS paper_id FROM documents")
def identity_new(spark, d):
    keys = S.key_candidates(F.lit(None).cast("string"), F.concat(F.lit("arXiv:2301."), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("v2")), F.lit("key"), F.lit("{}"))
    aliases = spark.sql("SELECT '' AS paper_key, '' AS paper_id, '' AS meta_fingerprint WHERE false")
    return linkage.identities(docs(spark, d).select("doc_id", keys.alias("c")), "doc_id", F.col("c"), aliases).select("ident", "paper_id")


def files(spark, d):
    name = F.concat("lang", F.lit(" - 2020 - "), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return docs(spark, d).select(F.concat(F.lit("/p/"), name).alias("path"), name.alias("name"), "doc_id")


@query("""SELECT source || ' ' || doc_id AS title, lang AS author, '2020' AS publication_date, sha1('/p/' || lang || ' - 2020 - ' || source || '_' || doc_id || '.pdf') AS source_hash FROM documents WHERE doc_id % 3 <> 0""")
def stub_records(spark, d):
    f = files(spark, d)
    taken = f.where("doc_id % 3 = 0").select(F.col("path").alias("target"))
    return records.stubs(f.select("path", "name"), taken).select("title", F.col("authors")[0].alias("author"), "publication_date", "source_hash")


@query("""SELECT doc_id AS ident, '/f/' || doc_id || 'x.pdf' AS target, 'filename' AS match_type, 1.0::DOUBLE AS score FROM documents WHERE doc_id % 2 = 0""")
def files_by_name(spark, d):
    text = F.concat(F.col("doc_id").cast("string"), F.lit("x"))
    listed = docs(spark, d).where("doc_id % 2 = 0").select(F.concat(F.lit("/f/"), text, F.lit(".pdf")).alias("path"), F.concat(text, F.lit(".PDF")).alias("name"))
    name = F.when(F.col("doc_id") % 4 == 0, F.concat(text, F.lit(".pdf-0123abcd9.md"))).otherwise(F.concat(text, F.lit(".md")))
    return records.by_name(docs(spark, d), "doc_id", records.pdf_guesses(name), listed)


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'b/' || doc_id WHEN doc_id % 3 = 1 THEN doc_id::VARCHAR ELSE doc_id::VARCHAR END AS path FROM documents""")
def relative_paths(spark, d):
    text = F.col("doc_id").cast("string")
    path = F.concat(F.element_at(F.array(F.lit("/a/b/"), F.lit("/a/c/"), F.lit("/z/")), (F.col("doc_id") % 3 + 1).cast("int")), text)
    return docs(spark, d).select("doc_id", records.relative_path(path, ["/a", "/a/c"]).alias("path"))


@query("""SELECT 'deep' AS tag, 'lang' AS field, count(*) AS n FROM documents WHERE doc_id % 2 = 0 AND lang <> 'en' UNION ALL SELECT 'deep', 'source', count(*) FROM documents WHERE doc_id % 2 = 0 AND source <> 'src0'""")
def template_differences(spark, d):
    base = docs(spark, d).select("doc_id", "lang", "source")
    other = base.where("doc_id % 2 = 0").select("doc_id", F.lit("en").alias("lang"), F.lit("src0").alias("source"))
    matches = other.select(F.col("doc_id").alias("ident"), F.col("doc_id").alias("target"))
    return records.templates_merged(base, [("deep", other, matches)], "doc_id", ["lang", "source"])[2]


@query("""SELECT source AS reference, arg_max(doc_id, (CASE WHEN quality IS NULL THEN 1 ELSE 2 END, -doc_id)) AS kept FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def reference_best_target(spark, d):
    base = docs(spark, d).join(read_table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.lit("x").alias("t"), F.when(F.col("quality").isNotNull(), "q").alias("q"), "source")
    matches = base.select(F.col("doc_id").alias("ident"), F.col("source").alias("target"), F.lit(1.0).alias("score"))
    kept = records.best_for_reference(matches, base, "doc_id", {"t": "string", "q": "string"})
    return kept.select(F.col("source").alias("reference"), F.col("doc_id").alias("kept"))


@query("""SELECT source AS key, arg_max(lang, (doc_id % 5, -doc_id)) AS type, arg_max(doc_id, (doc_id % 5, -doc_id)) AS ordinal FROM documents GROUP BY source""")
def bibtex_duplicates(spark, d):
    fields = F.map_from_entries(F.transform(F.slice(F.sequence(F.lit(1), F.lit(5)), F.lit(1), (F.col("doc_id") % 5).cast("int")), lambda i: F.struct(F.concat(F.lit("f"), i.cast("string")).alias("k"), F.lit("v").alias("v"))))
    entries = docs(spark, d).select(F.col("source").alias("key"), F.col("lang").alias("type"), fields.alias("fields"), F.create_map().cast("map<string,array<string>>").alias("persons"), F.col("doc_id").alias("ordinal"))
    return sinks.bibtex_merged(entries).select("key", "type", "ordinal")


@query("""SELECT doc_id, 'img/' || source || '.png' AS path, CASE WHEN source IN ('src1', 'src2') THEN 'available' ELSE 'missing' END AS status FROM documents UNION ALL SELECT doc_id, 'https://x.org/a.png', 'available' FROM documents""")
def image_inventory(spark, d):
    raw = F.concat(F.lit("![a](img/"), "source", F.lit(".png) ![b](https://x.org/a.png) ![c](img/"), "source", F.lit(".png)"))
    known = spark.sql("SELECT 'img/src1.png' AS path UNION ALL SELECT 'img/src2.png'")
    return docops.image_inventory(docs(spark, d).select("doc_id", raw.alias("t")), "doc_id", "t", known)


@query("""SELECT doc_id, CASE WHEN lang IN ('de', 'fr') THEN '![x](data:image/png;base64,' || base64(encode(lang)) || ') ' || text ELSE '![x](' || lang || '.png) ' || text END AS text FROM documents""")
def images_embedded(spark, d):
    base = docs(spark, d).select("doc_id", F.concat(F.lit("![x]("), "lang", F.lit(".png) "), "text").alias("text"))
    images = spark.sql("SELECT 'de.png' AS path, 'image/png' AS mime, CAST('de' AS BINARY) AS content UNION ALL SELECT 'fr.png', 'image/png', CAST('fr' AS BINARY)")
    return docops.embedded(base, "doc_id", "text", images).select("doc_id", "text")


@query("""SELECT doc_id, '![x](images/' || substr(sha256(lang), 1, 12) || '.jpg) ' || text AS text FROM documents""")
def images_unpacked(spark, d):
    raw = F.concat(F.lit("![x](data:image/jpeg;base64,"), F.base64(F.col("lang").cast("binary")), F.lit(") "), "text")
    return docops.unpacked(docs(spark, d).select("doc_id", raw.alias("text")), "doc_id", "text")[0].select("doc_id", "text")


@query("""SELECT doc_id, 'a b ' || lang AS meta_title, 'deep net 2 ' || lang AS title_key, 'a ' || lang || ' & b' AS shown, 'head word code ' || source AS plain FROM documents""")
def text_normal_forms(spark, d):
    return docs(spark, d).select(
        "doc_id",
        U.meta_title_col(F.concat(F.lit("Ａ—B: "), F.upper("lang"), F.lit("!"))).alias("meta_title"),
        U.title_key_col(F.concat(F.lit(r"Deep {Net}2 \textbf{"), "lang", F.lit("}"))).alias("title_key"),
        U.display_title_col(F.concat(F.lit("a <b>"), "lang", F.lit("</b>  &amp; b"))).alias("shown"),
        U.plain_text_col(F.concat(F.lit("# head\n\nword `code` "), "source", F.lit("\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"))).alias("plain"),
    )


@query("""SELECT doc_id, 'x [[[' || lang || ']]] y ' || source AS snippet FROM documents""")
def search_snippet(spark, d):
    shaped = docs(spark, d).select("doc_id", F.concat(F.lit("x "), "lang", F.lit(" y "), "source").alias("t"))
    return shaped.select("doc_id", U.snippet_col(F.col("t"), ["de", "en", "es", "fr"]).alias("snippet"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'placeholders_mismatch' WHEN 1 THEN 'empty_output' WHEN 2 THEN 'missing_target_script ratio=1.00' END AS why FROM documents""")
def translation_gate(spark, d):
    source = F.concat("text", F.lit(" These are some words of "), "source", F.lit(" to translate __PH_CODE_000001__"))
    target = F.when(F.col("doc_id") % 4 == 0, "x").when(F.col("doc_id") % 4 == 2, source).when(F.col("doc_id") % 4 == 3, "一些文字 __PH_CODE_000001__")
    plain = F.when(F.col("doc_id") % 4 == 1, F.lit("Only a few words here")).otherwise(source)
    return docs(spark, d).select("doc_id", docops.failure_col(plain, target, F.lit("zh")).alias("why"))


@query("""SELECT doc_id, '{"a":"two:a:' || length(text) || '","b":"two:b:' || length(text) || '"}' AS record FROM documents""")
def workflow_merged(spark, d):
    stages = [workflow.Stage("one", ("a",)), workflow.Stage("two", ("a", "b"))]
    return workflow.run_stages(docs(spark, d), "doc_id", "text", stages, workflow.echo).merged


@query("""SELECT 'summary/' || doc_id || '/' || lang || '.json' AS path, '{"paper_id":"' || doc_id || '","paper_title":"' || source || '","year":"2020","venue":"v","template_tag":"' || lang || '","summary":"s"}' AS json FROM documents
  UNION ALL SELECT 'summary/' || doc_id || '.json', '{"paper_id":"' || doc_id || '","paper_title":"' || source || '","year":"2020","venue":"v","template_tag":"' || lang || '","summary":"s","available_templates":["' || lang || '"]}' FROM documents""")
def export_summaries(spark, d):
    text = F.col("doc_id").cast("string")
    paper = docs(spark, d).select(text.alias("paper_id"), F.col("source").alias("title"), F.lit("2020").alias("year"), F.lit("v").alias("venue"), F.col("lang").alias("preferred_summary_template"))
    sums = docs(spark, d).select(text.alias("paper_id"), F.col("lang").alias("template_tag"), F.lit("s").alias("text"))
    return export.summary_documents(paper, sums)


@query("""SELECT doc_id AS paper_id, CASE WHEN quality IS NULL THEN 'lang' ELSE 'deep' END AS template_tag, CASE WHEN quality IS NULL THEN lang ELSE 'd' || quality END AS text FROM documents LEFT JOIN labels USING (doc_id)""")
def unpack_lenient(spark, d):
    lab = read_table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"), F.lit("deep").alias("template_tag"), F.concat(F.lit("d"), F.col("quality").cast("string")).alias("text"))
    own = docs(spark, d).select(F.col("doc_id").alias("paper_id"), F.lit("lang").alias("template_tag"), F.col("lang").alias("text"))
    paper = docs(spark, d).select(F.col("doc_id").alias("paper_id"), F.lit("lang").alias("preferred_summary_template"))
    return snapshot.unpack_summaries(paper, own.unionByName(lab), "deep", False)


@query("""SELECT doc_id AS paper_id, '10.1/' || doc_id AS doi, CASE WHEN lang = 'de' THEN 'unknown' ELSE lang END AS year, 'unknown' AS month FROM documents""")
def migrate_legacy(spark, d):
    legacy = docs(spark, d).select(F.col("doc_id").cast("string").alias("paper_id"), F.concat(F.lit("doi:10.1/"), F.col("doc_id").cast("string")).alias("doi"), F.when(F.col("lang") == "de", "").otherwise(F.col("lang")).alias("year"))
    return snapshot.migrate(legacy).select(F.col("paper_id").cast("long").alias("paper_id"), "doi", "year", "month")


@query("""SELECT min(doc_id) AS paper_id, CASE WHEN lang IN ('de', 'fr') THEN '/m/' || lang ELSE lang || '.md' END AS path FROM documents GROUP BY lang""")
def coverage_paths(spark, d):
    known = spark.sql("SELECT 'de' AS hash, '/m/de' AS path UNION ALL SELECT 'fr', '/m/fr'")
    return snapshot.missing_paths(docs(spark, d).select(F.col("doc_id").alias("paper_id"), "lang"), "lang", known).select("paper_id", "path")


@query("""SELECT 'A' AS side, sha1(text) AS source_hash, 'matched' AS match_status, '1.0000' AS match_score, '' AS lang FROM documents UNION ALL SELECT 'B', sha1(text), 'matched', '1.0000', '' FROM documents UNION ALL SELECT 'MATCH', sha1(text), 'matched_pair', '1.0000', '' FROM documents""")
def compare_with_itself(spark, d):
    a = docs(spark, d).select(F.col("doc_id").alias("ident"), F.sha1(F.col("text").cast("binary")).alias("source_hash"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("source_path"))
    same = a.select("ident", F.col("ident").alias("target"), F.lit("hash").alias("match_type"), F.lit(1.0).alias("score"))
    return sinks.compare_rows(linkage.compare(a, a, same)).select("side", "source_hash", "match_status", "match_score", "lang")


@query("SELECT event_id, event_type, user_id FROM events")
def stream_append_once(spark, d):
    """The events as a stream, appended batch by batch; a second run over the same files adds nothing."""
    base = f"{storage.shared_dir(spark)}/stream-{id(spark)}-{abs(hash(d))}-{spark.sql('SELECT uuid()').first()[0]}"
    schema = read_table(spark, d, "events").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    for _ in range(2):
        rows = incremental.new_rows(spark, f"{d}/events.parquet*", schema, "event_id", "ts", "60 days")
        incremental.maintain(rows, f"{base}/table", f"{base}/checkpoint", "event_id", event_time="ts", late="60 days").awaitTermination()
    return spark.read.parquet(f"{base}/table").select("event_id", "event_type", "user_id")


@query("""SELECT doc_id, lower(split_part(text, chr(10), 1)) AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents""")
def ranks_within(spark, d):
    return ranking.global_rank(docs(spark, d).select("doc_id", "lang", F.lower(title()).alias("t")), "doc_id", "rank", ["lang"]).drop("lang")
