"""Queries for scalar functions, filters, orders, joins by similarity, and prompts."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.functions import textudf as U
from paperloom.operators import docops, dsl, facets, linkage, ranking, records
from paperloom.plans import generation, workflow
from paperloom.queries import docs, query
from paperloom.queries_docs import ident, one_other
from paperloom.session import read_table

# Scalars


@query("SELECT doc_id, lang AS key, 'smith' AS two, 'lee' AS three FROM documents")
def author_keys(spark, d):
    name = F.concat(F.lit("Van "), F.upper("lang"), F.lit(", Ann et al."))
    return docs(spark, d).select("doc_id", S.author_key(name).alias("key"), S.author_key(F.lit("J. Smith et al")).alias("two"), S.author_key(F.lit("Bo-Lee")).alias("three"))


@query("SELECT doc_id, 'some title of ' || lang || ' and ' || doc_id AS title_key, 'sometitleof' || lang || 'and' || doc_id AS compact, CASE WHEN doc_id % 2 = 0 THEN 'nets ' || lang ELSE 'nets' END AS bare FROM documents")
def title_forms(spark, d):
    raw = F.concat(F.lit("  {Some} Title:  of "), F.upper("lang"), F.lit(" -- and "), ident())
    numbered = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("12 3 nets "), "lang")).otherwise("7 nets")
    key = U.title_key_col(raw)
    return docs(spark, d).select("doc_id", key.alias("title_key"), S.compact(key).alias("compact"), S.unnumbered(numbered).alias("bare"))


@query("SELECT doc_id, 'Journal of ' || lang AS shown, CASE doc_id % 3 WHEN 0 THEN 'J ' || lang WHEN 1 THEN 'B ' || source ELSE 'V' END AS venue, lower(source) || '_deep_' || lang AS tag FROM documents")
def venue_forms(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["Article", "inproceedings", "misc"])), (F.col("doc_id") % 3 + 1).cast("int"))
    venue = S.venue_of(kind, F.concat(F.lit("J "), "lang"), F.concat(F.lit("B "), "source"), F.lit("V"))
    return docs(spark, d).select("doc_id", S.display_venue(F.concat(F.lit(" {{Journal}}  of "), "lang", F.lit(" "))).alias("shown"), venue.alias("venue"), S.template_tag(F.concat(F.upper("source"), F.lit(" Deep! "), "lang", F.lit("__"))).alias("tag"))


@query(r"SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || E'\n[truncated: ' || (length(text) - 200) || ' more chars]' ELSE text END AS text FROM documents")
def cut_with_note(spark, d):
    return docs(spark, d).select("doc_id", S.cut_with_note(F.col("text"), 200).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '10.1000/' || lower(source) || doc_id END AS doi FROM documents")
def doi_in_bibtex(spark, d):
    raw = F.concat(F.lit("@article{k,\n title = {T},\n "), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("DOI = {https://doi.org/10.1000/"), F.upper("source"), ident(), F.lit(".}"))).otherwise("note = {n}"), F.lit("\n}"))
    return docs(spark, d).select("doc_id", S.doi_in_bibtex(raw).alias("doi"))


@query("SELECT doc_id, '[[[' || lang || source || ']]] ' || text AS text FROM documents")
def markers_merged(spark, d):
    return docs(spark, d).select("doc_id", S.markers_merged(F.concat(F.lit("[[["), "lang", F.lit("]]][[["), "source", F.lit("]]] "), "text")).alias("text"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(text, '*', ''), '_', ' '), '#', ''), '|', ''), '\s+', ' ', 'g')) || ' code ' || lang || ' link' AS plain FROM documents""")
def markdown_plain(spark, d):
    bare = F.replace(F.replace(F.replace(F.replace("text", F.lit("*"), F.lit("")), F.lit("_"), F.lit(" ")), F.lit("#"), F.lit("")), F.lit("|"), F.lit(""))
    raw = F.concat(bare, F.lit("\n\n`code` **"), "lang", F.lit("** [link](http://x.y)\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n<table><tr><td>x</td></tr></table>"))
    return docs(spark, d).select("doc_id", U.plain_text_col(raw).alias("plain"))


@query("SELECT doc_id, doc_id % 3 = 0 AS inside FROM documents")
def titles_overlap(spark, d):
    long = F.concat(F.lit("a long title of some words "), ident())
    return docs(spark, d).select("doc_id", S.overlaps(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("of some words "), ident())).when(F.col("doc_id") % 3 == 1, F.lit("words")).otherwise(F.lit("some other words here")), long).alias("inside"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1990 + doc_id % 30 WHEN 1 THEN 2001 END AS year, doc_id % 2 = 0 AS is_year, doc_id % 13 BETWEEN 1 AND 12 AS is_month FROM documents")
def publication_years(spark, d):
    bib = F.when(F.col("doc_id") % 3 == 0, (F.lit(1990) + F.col("doc_id") % 30).cast("string")).otherwise("in press")
    date = F.when(F.col("doc_id") % 3 == 1, "May 2001")
    y = F.when(F.col("doc_id") % 2 == 0, "2020").otherwise("20201")
    m = F.when(F.col("doc_id") % 13 == 0, "ab").otherwise(F.lpad((F.col("doc_id") % 13).cast("string"), 2, "0"))
    return docs(spark, d).select("doc_id", S.publication_year(bib, date).cast("long").alias("year"), S.is_year(y).alias("is_year"), S.is_month(m).alias("is_month"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'deep,simple,alpha' ELSE 'simple,zeta' END AS ordered, 't' || doc_id AS first_tag, 2::BIGINT AS n_tags FROM documents")
def templates_in_order(spark, d):
    have = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("alpha"), F.lit("simple"), F.lit("deep"))).otherwise(F.array(F.lit("zeta"), F.lit("simple")))
    listed = S.in_order(have, F.array(F.lit("deep"), F.lit("simple")))
    reply = F.concat(F.lit('Tags: ["t'), ident(), F.lit('", " b "]'))
    tags = U.per_text("array<string>")(generation.tags_in)(reply)
    return docs(spark, d).select("doc_id", F.array_join(listed, ",").alias("ordered"), tags[0].alias("first_tag"), F.size(tags).cast("long").alias("n_tags"))


@query("""SELECT doc_id, '/s/pdf/' || source || '.pdf' AS pdf, '/s/md/' || lang || '.md' AS md, doc_id % 2 = 0 AS has_pdf, false AS has_none FROM documents""")
def asset_maps(spark, d):
    urls = F.map_from_arrays(F.array(F.lit("pdf"), F.lit("md")), F.array(S.asset_url("/s", "pdf", F.col("source"), "pdf"), S.asset_url("/s/", "md", F.col("lang"), "md")))
    has = ~S.blank(F.when(F.col("doc_id") % 2 == 0, "x"))
    return docs(spark, d).select("doc_id", urls["pdf"].alias("pdf"), urls["md"].alias("md"), has.alias("has_pdf"), (~S.blank(F.lit("  "))).alias("has_none"))


def spec(stage: workflow.Stage) -> str:
    return json.dumps({"fields": list(stage.fields), "name": stage.name, "prompt": stage.prompt, "schema": {}, "template": "simple"}, sort_keys=True, ensure_ascii=False)


@query(f"""SELECT 'one' AS stage, sha256('{spec(workflow.Stage("one", ("a",), None, "p"))}') AS hash UNION ALL SELECT 'zwei', sha256('{spec(workflow.Stage("zwei", ("b", "é")))}')""")
def prompt_hashes(spark, d):
    stages = [workflow.Stage("one", ("a",), None, "p"), workflow.Stage("zwei", ("b", "é"))]
    return spark.createDataFrame([(s.name, workflow.prompt_hash(s, "simple")) for s in stages], "stage string, hash string")


@query(r"""SELECT doc_id, w AS word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[\p{L}\p{N}]+')) AS w FROM documents) GROUP BY ALL""")
def search_words(spark, d):
    each = docs(spark, d).select("doc_id", F.explode(U.search_tokens_col("text")).alias("word"))
    return each.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


# Filters, orders, pages


def library(spark, d):
    return docs(spark, d).withColumn("templates", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Deep"), F.lit("simple"))).otherwise(F.array(F.lit("simple"))))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND source <> 'src1'")
def filtered_templates(spark, d):
    wanted = dsl.parse_filters("tmpl:deep,other pdf:yes nonsense x:y")
    return dsl.filtered(library(spark, d), wanted, {"pdf": F.col("source") != "src1"}, F.col("templates")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang LIKE '%e%' AND contains(lower(text), 'the')")
def filtered_keyword(spark, d):
    words = docs(spark, d).select("doc_id", F.explode(F.array(F.upper("lang"), F.lit("zz"))).alias("value"))
    return dsl.structured(docs(spark, d), "doc_id", {"keyword": words}, {"keyword": "E"}, (F.col("text"), "THE")).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id = 7")
def lookup_by_key(spark, d):
    return docs(spark, d).where(F.col("doc_id") == 7).select("doc_id", "lang")


def shaped(spark, d):
    year = F.when(F.col("doc_id") % 7 == 0, "unknown").otherwise((F.lit(1990) + F.col("doc_id") % 30).cast("string"))
    return docs(spark, d).select("doc_id", year.alias("year"), F.col("text").alias("title"), F.col("source").alias("venue"))


SHAPED = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE (1990 + doc_id % 30)::VARCHAR END AS year, text AS title, source AS venue FROM documents)"


@query(f"SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN year = 'unknown' THEN 1 ELSE 0 END, try_cast(year AS INTEGER), lower(title), doc_id) AS position FROM {SHAPED}")
def order_year_asc(spark, d):
    return ranking.sorted_rank(shaped(spark, d), [*dsl.search_sort("year_asc", F.col("title"), F.col("venue"), F.col("year")), F.col("doc_id")], "position").select("doc_id", "position")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY lower(title) DESC, doc_id) AS position FROM {SHAPED}")
def order_title_desc(spark, d):
    return ranking.sorted_rank(shaped(spark, d), [*dsl.search_sort("title_desc", F.col("title"), F.col("venue"), F.col("year")), F.col("doc_id")], "position").select("doc_id", "position")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY lower(venue), lower(title), doc_id) AS position FROM {SHAPED}")
def order_venue_asc(spark, d):
    return ranking.sorted_rank(shaped(spark, d), [*dsl.search_sort("venue_asc", F.col("title"), F.col("venue"), F.col("year")), F.col("doc_id")], "position").select("doc_id", "position")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY year DESC, title, doc_id) AS position FROM {SHAPED}")
def order_year_text(spark, d):
    """Years as text, so that unknown ones come first."""
    return ranking.sorted_rank(shaped(spark, d), [F.desc("year"), F.col("title"), F.col("doc_id")], "position").select("doc_id", "position")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY coalesce(try_cast(year AS INTEGER), 0) DESC, doc_id) AS newest, row_number() OVER (ORDER BY coalesce(try_cast(year AS INTEGER), 0), doc_id) AS oldest FROM {SHAPED}")
def order_records(spark, d):
    """Records by year, missing ones as 0, in both directions."""
    year = S.leading_int(F.col("year"))
    one = ranking.sorted_rank(shaped(spark, d).select("doc_id", "year"), [year.desc(), F.col("doc_id")], "newest")
    return ranking.sorted_rank(one, [year.asc(), F.col("doc_id")], "oldest").select("doc_id", "newest", "oldest")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY (coalesce(try_cast(year AS INTEGER), 0) = 0), coalesce(try_cast(year AS INTEGER), 0) DESC, doc_id DESC) AS position FROM {SHAPED}")
def order_library_year(spark, d):
    lib = dsl.Library(F.col("title"), F.array(F.lit("")), F.array(F.lit("")), F.col("venue"), F.col("year"), F.lit("1"))
    return ranking.sorted_rank(shaped(spark, d), dsl.library_sort("year", "desc", lib, F.col("doc_id")), "position").select("doc_id", "position")


@query("SELECT value, paper_count, row_number() OVER (ORDER BY paper_count DESC, lower(value)) AS position FROM (SELECT source AS value, count(*) AS paper_count FROM documents GROUP BY 1)")
def order_counts(spark, d):
    counted = docs(spark, d).groupBy(F.col("source").alias("value")).agg(F.count(F.lit(1)).alias("paper_count"))
    return ranking.sorted_rank(counted, [F.desc("paper_count"), F.lower("value")], "position")


@query("SELECT value, n FROM (SELECT source || '_' || lang AS value, count(*) AS n FROM documents GROUP BY 1) ORDER BY n DESC, value LIMIT 5 OFFSET 5")
def page_of_values(spark, d):
    """The second page of five: a page is the feature."""
    counted = docs(spark, d).groupBy(F.concat_ws("_", "source", "lang").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return facets.page(counted.orderBy(F.desc("n"), "value"), 2, 5)


@query("SELECT DISTINCT source || '/' || lang AS path FROM documents")
def paths_distinct(spark, d):
    return docs(spark, d).select(F.concat_ws("/", "source", "lang").alias("path")).distinct().orderBy("path")


# Counts


@query("""SELECT doc_id, 1::BIGINT AS code, 2::BIGINT AS links, 1::BIGINT AS math FROM documents""")
def placeholder_kinds(spark, d):
    bare = F.replace(F.replace("text", F.lit("$"), F.lit("")), F.lit("|"), F.lit(""))
    raw = docs(spark, d).select("doc_id", F.concat(bare, F.lit("\n\n`c` [a](b) [c]("), "lang", F.lit(") $x_1$ `c`")).alias("t"))
    n = lambda kind: F.size(F.filter(F.map_keys("frozen"), lambda k: k.startswith(f"__PH_{kind}_"))).cast("long")
    return docops.protected(raw, "t").select("doc_id", n("CODE").alias("code"), n("LINK").alias("links"), n("MATH").alias("math"))


@query("""SELECT 'total' AS name, count(*) AS n FROM documents WHERE lang <> 'en' UNION ALL SELECT 'with pdf', count_if(doc_id % 2 = 0) FROM documents WHERE lang <> 'en' UNION ALL SELECT source, count(*) FROM documents WHERE lang <> 'en' GROUP BY source""")
def counts_of_a_set(spark, d):
    """Presence and templates over a set of ids."""
    ids = docs(spark, d).where("lang != 'en'").select("doc_id")
    own = docs(spark, d).join(ids, "doc_id", "left_semi")
    flags = F.array_compact(F.array(F.lit("total"), F.when(F.col("doc_id") % 2 == 0, "with pdf"), F.col("source")))
    return own.select(F.explode(flags).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# Joins by similarity


def shelf(spark, d, at: int = 12):
    """(doc_id, t: a title of which no other is like, near: the same with one other character)."""
    t = F.concat(F.substring(F.sha2(ident(), 256), 1, 20), F.lit(" paper on "), "lang", F.lit(" and more"))
    return docs(spark, d).select("doc_id", t.alias("t"), one_other(t, F.lit(at)).alias("near"), "source", "lang")


LENGTH = "length('01234567890123456789 paper on ' || lang || ' and more')"


@query(f"SELECT doc_id AS ident, doc_id AS target, 'title_fuzzy' AS match_type, round(1 - 1.0 / {LENGTH}, 6)::DOUBLE AS score FROM documents")
def similar_in_block(spark, d):
    """Each title finds the one that is like it among those of its block."""
    base = shelf(spark, d, 25)
    posts = linkage.targets(base, "doc_id", "doc_id", F.col("t"))
    asked = linkage.queries(base, "doc_id", F.col("near"))
    found = linkage.block_stage(asked, posts, "prefix", S.prefix_key(F.col("title_key")), "title_prefix")
    return found.withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id AS ident, doc_id AS target, CASE doc_id % 3 WHEN 0 THEN 'title' ELSE 'title_fuzzy' END AS match_type, round(CASE doc_id % 3 WHEN 0 THEN 1.0 ELSE 1 - 1.0 / {LENGTH} END, 6)::DOUBLE AS score FROM documents")
def resolve_cascade_fuzzy(spark, d):
    """Equal titles, ones that are alike in the prefix block, and ones whose block only author and year give."""
    base = shelf(spark, d, 25).withColumn("year", (F.col("doc_id") % 9000 + 1000).cast("string"))
    other = one_other(F.col("t"), F.lit(3))
    title = F.when(F.col("doc_id") % 3 == 0, F.col("t")).when(F.col("doc_id") % 3 == 1, F.col("near")).otherwise(other)
    posts = linkage.targets(base, "doc_id", "doc_id", F.col("t"), F.col("year"), F.lit("lee"))
    found = linkage.resolve(linkage.queries(base, "doc_id", title, F.col("year"), F.lit("lee")), posts)
    return found.withColumn("score", F.round("score", 6))


@query(f"""SELECT doc_id AS ident, doc_id AS target, CASE WHEN doc_id % 2 = 0 THEN 'title' ELSE 'author_year_relaxed' END AS match_type, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM documents""")
def resolve_relaxed(spark, d):
    base = shelf(spark, d).withColumn("author", F.concat(F.lit("a"), ident()))
    posts = linkage.targets(base, "doc_id", "doc_id", F.col("t"), F.lit("2020"), F.col("author"))
    asked = linkage.queries(base, "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("t")).otherwise("§§§"), F.lit("2020"), F.col("author"))
    return records.relaxed(asked, posts)


@query(f"SELECT doc_id AS ident, 'k' || doc_id AS entry, round(1 - 1.0 / {LENGTH}, 6)::DOUBLE AS score FROM documents")
def bibliography_best(spark, d):
    """The entry most like each paper, of those that begin alike."""
    base = shelf(spark, d, 25)
    entries = base.select(F.concat(F.lit("k"), ident()).alias("k"), "doc_id", "t")
    found = linkage.bibliography_match(base, "doc_id", F.col("near"), entries, "k", "doc_id", F.col("t"))
    return found.withColumn("score", F.round("score", 6))


@query("""SELECT doc_id AS group_of, CASE WHEN doc_id % 10 < 5 THEN doc_id // 10 * 10 + doc_id % 10 % 2 ELSE doc_id END AS group_id FROM documents""")
def merge_similar_titles(spark, d):
    """Of every ten records, five are two papers: by equal hashes (even) or by titles that are alike (odd)."""
    n = F.col("doc_id")
    tens = F.floor(n / 10).cast("string")
    t = F.concat(F.substring(F.sha2(tens, 256), 1, 30), F.lit(" a title that goes on and on and on"))
    title = F.when((n % 10 < 5) & (n % 2 == 1), F.when(n % 10 == 1, t).otherwise(one_other(t, (F.lit(40) + n % 10).cast("int")))).otherwise(F.substring(F.sha2(ident(), 256), 1, 40))
    base = docs(spark, d).select("doc_id", title.alias("t"), F.when((n % 10 < 5) & (n % 2 == 0), F.concat(F.lit("h"), tens)).alias("h"))
    found = linkage.merge_groups(base, "doc_id", "doc_id", F.col("h"), F.lit(None).cast("string"), F.col("t"))
    return found.select(F.col("ident").alias("group_of"), "group_id")


@query("""SELECT doc_id AS ident, '/f/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE ' x.pdf' END AS target, CASE WHEN doc_id % 2 = 0 THEN 'filename' ELSE 'title' END AS match_type FROM documents""")
def source_files(spark, d):
    """A record's file: the one it names, or one whose name is its title."""
    t = F.substring(F.sha2(ident(), 256), 1, 24)
    even = F.col("doc_id") % 2 == 0
    recs = docs(spark, d).select("doc_id", F.concat(F.lit("title "), t).alias("title"), F.array().cast("array<string>").alias("authors"), F.lit("2020").alias("year"), F.when(even, F.concat(F.lit("/old/"), ident(), F.lit(".md"))).alias("source_path"))
    name = F.when(even, F.concat(ident(), F.lit(".md"))).otherwise(F.concat(F.lit("Lee - 2020 - title "), t, F.lit(".pdf")))
    path = F.concat(F.lit("/f/"), ident(), F.when(even, ".md").otherwise(" x.pdf"))
    return records.matched_files(recs, "doc_id", docs(spark, d).select(path.alias("path"), name.alias("name"))).select("ident", "target", "match_type")


@query("SELECT doc_id, lang AS lang, '/t/' || source || '.' || lang || '.md' AS path FROM documents")
def files_with_translations(spark, d):
    from paperloom.sources import readers

    listed = docs(spark, d).select(F.concat(F.lit("/t/"), "source", F.lit("."), "lang", F.lit(".md")).alias("path"), F.concat("source", F.lit("."), "lang", F.lit(".md")).alias("name"))
    found = readers.translations(listed)
    return docs(spark, d).select("doc_id", F.lower("source").alias("base"), "lang").join(found, ["base", "lang"]).select("doc_id", "lang", "path")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'other ' || lang END AS title, 'v' AS venue FROM documents")
def fields_of_templates(spark, d):
    """One record of each paper, every field from the first template that has it."""
    first = docs(spark, d).select("doc_id", F.lit(0).alias("o"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title"), F.lit(None).cast("string").alias("venue"))
    second = docs(spark, d).select("doc_id", F.lit(1).alias("o"), F.concat(F.lit("other "), "lang").alias("title"), F.lit("v").alias("venue"))
    return linkage.merged_fields(first.unionByName(second), "doc_id", "o", ["title", "venue"])


@query("""SELECT 'title' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'compact', count(*) FROM documents UNION ALL SELECT 'prefix', count(*) FROM documents UNION ALL SELECT 'year', count(*) FROM documents UNION ALL SELECT 'author_year', count(*) FROM documents""")
def linkage_postings(spark, d):
    """The keys of two shelves in one index."""
    one = shelf(spark, d)
    posts = lambda df: linkage.targets(df, "doc_id", "doc_id", F.col("t"), F.lit("2020"), F.lit("lee"))
    both = posts(one.where("doc_id % 2 = 0")).unionByName(posts(one.where("doc_id % 2 = 1")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Prompts


@query(r"""SELECT doc_id, E'Schema:\n{}\n\nEarlier results:\nnone\n\nDocument:\n' || text AS prompt FROM documents""")
def prompts(spark, d):
    template = generation.Registry()["simple"]
    made = U.per_text("string")(lambda t: generation.messages(template, t)[1]["content"])
    return docs(spark, d).select("doc_id", made("text").alias("prompt"))


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE length(text) END AS chars, CASE WHEN lang = 'de' THEN 'no object' END AS error FROM documents""")
def checked_replies(spark, d):
    """Replies that are tried again until they hold what is asked, or given up."""

    def ask(text: str) -> str:
        lang, _, body = text.partition("|")
        replies = iter(["not yet", '{"a"', "no" if lang == "de" else json.dumps({"chars": len(body)})])
        found, error = generation.checked_call(lambda m, k: next(replies), [], lambda o: None if "chars" in o else "chars missing", sleep=lambda s: None)
        return json.dumps({"chars": (found or {}).get("chars"), "error": error})

    asked: Column = U.per_text("string")(ask)(F.concat_ws("|", "lang", "text"))
    parsed = docs(spark, d).select("doc_id", F.from_json(asked, "chars long, error string").alias("r"))
    return parsed.select("doc_id", "r.chars", "r.error")


@query("SELECT 'simple' AS name, 0 AS stages UNION ALL SELECT 'simple_phi', 0 UNION ALL SELECT 'deep_read', 15 UNION ALL SELECT 'deep_read_phi', 6 UNION ALL SELECT 'eight_questions', 2 UNION ALL SELECT 'eight_questions_phi', 2 UNION ALL SELECT 'three_pass', 0")
def template_registry(spark, d):
    known = generation.Registry()
    return spark.createDataFrame([(n, len(known[n].stages)) for n in known.names()], "name string, stages int")
