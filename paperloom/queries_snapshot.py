"""Queries for the relations of a snapshot that is built, built again over an earlier one, and updated, from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans import snapshot
from paperloom.queries import docs, papers, query
from paperloom.queries_docs import ident

AT = "2024-01-01T00:00:00Z"


def numbered(spark: SparkSession, d: str, doi: bool = True, arxiv: bool = False) -> DataFrame:
    """The documents as records, each with a DOI, an arXiv number, or both, of its own."""
    text = F.col("ordinal").cast("string")
    none = F.lit(None).cast("string")
    number = F.concat(F.lit("2301."), F.lpad(text, 7, "0"))
    return papers(spark, d).withColumns({"doi": F.concat(F.lit("https://doi.org/10.1/"), text) if doi else none, "arxiv": number if arxiv else none})


PAPER_ID = "substr(sha256('v1|doi:10.1/' || doc_id), 1, 32)"
PAIRS = f"""pairs AS (SELECT DISTINCT paper_id, facet_type, value FROM (
  SELECT {PAPER_ID} AS paper_id, unnest(['author', 'keyword', 'institution', 'year', 'month', 'venue', 'output_language', 'provider', 'model', 'prompt_template', 'summary_template', 'translation_lang']) AS facet_type,
    unnest(['author ' || lang, lang, lower(source), (1990 + doc_id % 30)::VARCHAR, '03', lower(source), 'en', 'stub', 'm1', 'simple', 'simple', lang]) AS value FROM documents
  UNION ALL SELECT {PAPER_ID}, 'tag', 'q' || quality FROM documents JOIN labels USING (doc_id)))"""


@query(f"""SELECT {PAPER_ID} AS paper_id, '10.1/' || doc_id AS doi, split_part(text, chr(10), 1) AS title, (1990 + doc_id % 30)::VARCHAR AS year, '03' AS month, source AS venue, 'simple' AS preferred_summary_template,
  CASE WHEN length(p) > 320 THEN regexp_replace(substr(p, 1, 319), '\\s+$', '') || '…' ELSE p END AS summary_preview, sha1(text) AS source_hash, row_number() OVER (ORDER BY {PAPER_ID}) AS paper_index
  FROM (SELECT *, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS p FROM documents)""")
def snapshot_papers(spark, d):
    built = snapshot.build(numbered(spark, d), "b1", AT)
    return built["paper"].select("paper_id", "doi", "title", "year", "month", "venue", "preferred_summary_template", "summary_preview", "source_hash", "paper_index")


@query(f"WITH {PAIRS} SELECT row_number() OVER (ORDER BY facet_type, value) AS node_id, facet_type, value, count(*) AS paper_count FROM pairs GROUP BY facet_type, value")
def snapshot_nodes(spark, d):
    return snapshot.build(numbered(spark, d), "b1", AT)["facet_node"]


@query(f"WITH {PAIRS} SELECT paper_id, facet_type, value FROM pairs")
def snapshot_facets(spark, d):
    built = snapshot.build(numbered(spark, d), "b1", AT)
    return built["paper_facet"].join(built["facet_node"], "node_id").select("paper_id", "facet_type", "value")


@query(f"""WITH {PAIRS} SELECT a.facet_type AS type_a, a.value AS value_a, b.facet_type AS type_b, b.value AS value_b, count(*) AS paper_count
  FROM pairs a JOIN pairs b ON a.paper_id = b.paper_id AND (a.facet_type, a.value) < (b.facet_type, b.value) GROUP BY ALL""")
def snapshot_edges(spark, d):
    built = snapshot.build(numbered(spark, d), "b1", AT)
    a, b = (built["facet_node"].select(F.col("node_id").alias(f"node_id_{s}"), F.col("facet_type").alias(f"type_{s}"), F.col("value").alias(f"value_{s}")) for s in "ab")
    return built["facet_edge"].join(a, "node_id_a").join(b, "node_id_b").select("type_a", "value_a", "type_b", "value_b", "paper_count")


@query(f"WITH {PAIRS} SELECT paper_id, value FROM pairs WHERE facet_type = 'author' UNION ALL SELECT paper_id, value FROM pairs WHERE facet_type = 'tag'")
def snapshot_bridges(spark, d):
    built = snapshot.build(numbered(spark, d), "b1", AT)
    one = lambda n: built[f"paper_{n}"].join(built[n], f"{n}_id").select("paper_id", "value")
    return one("author").unionByName(one("tag"))


@query(f"SELECT {PAPER_ID} AS paper_id, lang, sha1(text) AS md_content_hash, 'simple' AS template_tag FROM documents")
def snapshot_translations(spark, d):
    built = snapshot.build(numbered(spark, d), "b1", AT)
    return built["paper_translation"].join(built["paper_summary"], "paper_id")


@query(f"SELECT 'doi:10.1/' || doc_id AS paper_key, {PAPER_ID} AS paper_id, 'doi' AS paper_key_type FROM documents UNION ALL SELECT 'arxiv:2301.' || lpad(doc_id::VARCHAR, 7, '0'), {PAPER_ID}, 'arxiv' FROM documents")
def snapshot_aliases(spark, d):
    built = snapshot.build(numbered(spark, d, arxiv=True), "b1", AT)
    return built["paper_key_alias"].where("paper_key_type != 'meta'").select("paper_key", "paper_id", "paper_key_type")


@query(f"SELECT {PAPER_ID} AS paper_id, '10.1/' || doc_id AS doi, 'arxiv' AS paper_key_type, split_part(text, chr(10), 1) AS title FROM documents")
def snapshot_inherited(spark, d):
    """A second build whose records have lost their DOIs: they keep their identity by their arXiv numbers, and get the DOIs
    back."""
    first = snapshot.build(numbered(spark, d, arxiv=True), "b1", AT)
    again = snapshot.build(numbered(spark, d, doi=False, arxiv=True), "b2", AT, first["paper_key_alias"], first["paper"])
    return again["paper"].select("paper_id", "doi", "paper_key_type", "title")


@query(f"""WITH {PAIRS}, n AS (SELECT facet_type, value, count(*) AS paper_count FROM pairs GROUP BY ALL)
  SELECT 'papers' AS name, count(*) AS n FROM documents UNION ALL SELECT facet_type || ':' || value, paper_count FROM n""")
def snapshot_updated(spark, d):
    """Half of the documents, and an update with all: the counts are those of all, each paper once."""
    whole = numbered(spark, d)
    old = snapshot.build(whole.where("ordinal % 2 = 0"), "b1", AT)
    new = snapshot.update(old, whole, "b2", AT)
    counts = new["facet_node"].select(F.concat_ws(":", "facet_type", "value").alias("name"), F.col("paper_count").alias("n"))
    return new["paper"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("papers").alias("name"), "n").unionByName(counts)


@query(f"SELECT doc_id::VARCHAR AS paper_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS md_content_hash FROM documents")
def snapshot_supplemented(spark, d):
    """Rows that a bridge lacks are added; those it has stay as they are."""
    row = lambda mark: docs(spark, d).select(ident().alias("paper_id"), "lang", F.lit(mark).alias("md_content_hash"), "doc_id")
    have = row("old").where("doc_id % 2 = 0").drop("doc_id")
    return snapshot.supplement(have, row("new").drop("doc_id"), ["paper_id", "lang"])
