"""Snapshots: one set of relations derived from the papers, rebuilt, updated, supplemented and migrated as wholes.

``papers`` is one row per record: paper_key candidates come from doi, arxiv, bib_key and metadata; list columns are
string arrays; ``ordinal`` says which record came first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.operators import facets
from paperloom.operators.linkage import identities
from paperloom.operators.ranking import first_per, global_rank
from paperloom.plans.storage import exists, keep

# Fixed values.
PAPER_COLUMNS = {
    "paper_id": "string", "paper_key": "string", "paper_key_type": "string", "doi": "string", "title": "string", "year": "string",
    "month": "string", "publication_date": "string", "venue": "string", "preferred_summary_template": "string", "summary_preview": "string",
    "paper_index": "long", "source_hash": "string", "output_language": "string", "provider": "string", "model": "string",
    "prompt_template": "string", "extracted_at": "string", "pdf_content_hash": "string", "source_md_content_hash": "string",
}
ALIAS_COLUMNS = {"paper_key": "string", "paper_id": "string", "paper_key_type": "string", "meta_fingerprint": "string"}
DIMENSIONS = {"author": "authors", "keyword": "keywords", "institution": "institutions", "tag": "tags"}
SINGLE_FACETS = ("year", "month", "venue", "output_language", "provider", "model", "prompt_template")


@dataclass
class Snapshot:
    """Relations by name; one may be given as what makes it, which is called when the relation is first asked for."""

    relations: dict[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        found = self.relations[name]
        if not isinstance(found, DataFrame):
            found = self.relations[name] = found()
        return found

    def write(self, root: str, build_id: str) -> str:
        """Every relation under a folder of its own build, and last a pointer beside the earlier ones, never over them: readers
        take the newest, so they see a whole build or the one before it."""
        for name in self.relations:
            self[name].write.mode("overwrite").parquet(f"{root}/{build_id}/{name}")
        spark = self[next(iter(self.relations))].sparkSession
        pointer = spark.range(1).select(F.lit(build_id).alias("build_id"), F.unix_micros(F.current_timestamp()).alias("at"))
        pointer.coalesce(1).write.mode("append").json(f"{root}/builds")
        return f"{root}/{build_id}"


def read(spark: SparkSession, root: str) -> Snapshot:
    build_id = spark.read.schema("build_id string, at long").json(f"{root}/builds").agg(F.max_by("build_id", "at")).first()[0]
    names = ["paper", "paper_summary", "paper_translation", "paper_bibtex", "paper_key_alias", "paper_facet", "facet_node", "facet_edge", "year_count", "month_count", "snapshot_meta", *[f"paper_{d}" for d in DIMENSIONS], *DIMENSIONS]
    return Snapshot({n: spark.read.parquet(f"{root}/{build_id}/{n}") for n in names if exists(spark, f"{root}/{build_id}/{n}")})


def with_keys(papers: DataFrame) -> DataFrame:
    """Adds fingerprint and candidates (strength, key_type, paper_key, fingerprint)."""
    from paperloom.functions.textudf import meta_name_col, meta_title_col

    people = S.meta_names("authors")
    year = F.coalesce(S.year_of(F.col("bib_year")), S.year_of(F.col("publication_date")), F.lit("unknown"))
    venue = meta_name_col(F.coalesce("bib_venue", "venue", F.lit("")))
    marked = papers.withColumn("fingerprint", S.fingerprint_json(people, meta_title_col(F.coalesce("title", F.lit(""))), venue, year))
    found = S.key_candidates(F.col("doi"), F.col("arxiv"), F.col("bib_key"), F.col("fingerprint"))
    return marked.withColumn("candidates", F.transform(found, lambda c: F.struct(c.strength.alias("strength"), c.key_type.alias("key_type"), c.paper_key.alias("paper_key"), F.when(c.key_type == "meta", F.col("fingerprint")).alias("fingerprint"))))


def build(papers: DataFrame, build_id: str, built_at: str, old_aliases: DataFrame | None = None, old_papers: DataFrame | None = None, similar: float = 0.8, shared: float = 0.5) -> Snapshot:
    """All relations.  Identity and missing DOI or BibTeX come from the previous build; of records with one identity the last
    stands everywhere, and edges and counts are derived from it."""
    spark = papers.sparkSession
    keyed = keep(with_keys(papers), "keyed")
    aliases = old_aliases if old_aliases is not None else spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in ALIAS_COLUMNS.items()))
    named = identities(keyed, "ordinal", F.col("candidates"), aliases, similar, shared)
    whole = keyed.join(named.select(F.col("ident").alias("ordinal"), "paper_id", F.col("paper_key").alias("key"), F.col("key_type").alias("kind")), "ordinal")
    last = first_per(whole, ["paper_id"], [-F.col("ordinal")])
    if old_papers is not None:
        before = old_papers.select("paper_id", F.col("doi").alias("old_doi"), *[F.col(c).alias(f"old_{c}") for c in ("bibtex_raw", "bibtex_key", "entry_type") if c in old_papers.columns])
        last = last.join(before, "paper_id", "left")
        last = last.withColumn("doi", F.coalesce(S.canonical_doi(F.col("doi")), S.canonical_doi(F.col("old_doi"))))
        for c in ("bibtex_raw", "bibtex_key", "entry_type"):
            if f"old_{c}" in last.columns:
                last = last.withColumn(c, F.coalesce(c, f"old_{c}"))
    base = keep(last, "papers")
    return Snapshot(relations(base, whole, build_id, built_at))


def relations(base: DataFrame, whole: DataFrame, build_id: str, built_at: str) -> dict[str, DataFrame | Callable[[], DataFrame]]:
    spark = base.sparkSession
    some = lambda c, other="unknown": F.coalesce(S.or_null(S.strip(F.col(c))), F.lit(other))
    date = F.coalesce("publication_date", F.lit(""))
    year, month = F.coalesce(S.year_of(F.col("bib_year")), S.year_of(date), F.lit("unknown")), F.coalesce(S.month_token(F.col("bib_month")), S.month_of(date), F.lit("unknown"))
    summaries = F.col("summaries")  # template tag -> text
    pick = S.preferred_template(F.map_keys(summaries), F.col("prompt_template"))
    paper = base.select(
        "paper_id", F.col("key").alias("paper_key"), F.col("kind").alias("paper_key_type"), S.canonical_doi(F.col("doi")).alias("doi"), "title", year.alias("year"), month.alias("month"),
        date.alias("publication_date"), S.display_venue(F.coalesce("venue", F.lit(""))).alias("venue"), pick.alias("preferred_summary_template"),
        S.shortened(S.untagged(F.coalesce(F.try_element_at(summaries, pick), F.lit(""))), 320).alias("summary_preview"),
        "source_hash", "output_language", "provider", "model", "prompt_template", "extracted_at", "pdf_content_hash", "source_md_content_hash",
    )
    paper = keep(global_rank(paper, "paper_id", "paper_index").select(*PAPER_COLUMNS), "paper")
    out = {"paper": paper}
    out["paper_summary"] = base.select("paper_id", F.explode(F.map_keys(summaries)).alias("t")).select("paper_id", S.template_tag(F.col("t")).alias("template_tag")).distinct()
    out["paper_translation"] = base.select("paper_id", F.explode("translations").alias("lang", "md_content_hash"))
    out["paper_bibtex"] = base.where("bibtex_raw IS NOT NULL").select("paper_id", "bibtex_raw", "bibtex_key", F.lower("entry_type").alias("entry_type"))
    out["paper_key_alias"] = first_per(whole.select("paper_id", F.col("ordinal"), F.explode("candidates").alias("c")).select("c.paper_key", "paper_id", F.col("c.key_type").alias("paper_key_type"), F.col("c.fingerprint").alias("meta_fingerprint"), "ordinal"), ["paper_key"], [-F.col("ordinal")]).drop("ordinal")

    @cache
    def pairs() -> DataFrame:
        lists = base.select("paper_id", *DIMENSIONS.values(), F.map_keys(summaries).alias("templates"), F.map_keys("translations").alias("langs"))
        values = {d: F.col(c) for d, c in DIMENSIONS.items()} | {f: F.col(f) for f in SINGLE_FACETS} | {"summary_template": F.col("templates"), "translation_lang": F.col("langs")}
        return keep(facets.incidence(lists.join(paper.select("paper_id", *SINGLE_FACETS), "paper_id"), "paper_id", values), "pairs")

    out |= facet_relations(pairs)
    for c in ("year", "month"):
        out[f"{c}_count"] = paper.groupBy(c).agg(F.count(F.lit(1)).alias("paper_count"))
    out["snapshot_meta"] = spark.createDataFrame([("snapshot_build_id", build_id), ("built_at", built_at)], "key string, value string")
    return out


def facet_relations(pairs: Callable[[], DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """Nodes, edges and bridges that hang on the (paper_id, facet_type, value) pairs.  Each is made when it is asked for; the
    pairs and nodes they share are made once."""

    @cache
    def nodes() -> DataFrame:
        return keep(facets.nodes(pairs(), "paper_id"), "nodes")

    def papers_of_nodes() -> DataFrame:
        return pairs().join(nodes().select("node_id", "facet_type", "value"), ["facet_type", "value"]).select("paper_id", "node_id")

    def edges() -> DataFrame:
        a, b = (nodes().select(F.col("node_id").alias(f"node_id_{s}"), F.col("facet_type").alias(f"type_{s}"), F.col("value").alias(f"value_{s}")) for s in "ab")
        links = facets.edges(pairs(), "paper_id").join(a, ["type_a", "value_a"]).join(b, ["type_b", "value_b"])
        return links.select("node_id_a", "node_id_b", "paper_count")

    def own(d: str) -> DataFrame:
        return nodes().where(F.col("facet_type") == d)

    def values(d: str) -> Callable[[], DataFrame]:
        return lambda: own(d).select(F.col("node_id").alias(f"{d}_id"), "value", "paper_count")

    def bridge(d: str) -> Callable[[], DataFrame]:
        return lambda: pairs().where(F.col("facet_type") == d).join(own(d).select("node_id", "value"), "value").select("paper_id", F.col("node_id").alias(f"{d}_id"))

    out: dict[str, Callable[[], DataFrame]] = {"facet_node": nodes, "paper_facet": papers_of_nodes, "facet_edge": edges}
    return out | {d: values(d) for d in DIMENSIONS} | {f"paper_{d}": bridge(d) for d in DIMENSIONS}


def update(old: Snapshot, papers: DataFrame, build_id: str, built_at: str) -> Snapshot:
    """Appends the papers whose identity is new; those already there stay as they are; derived relations are derived again
    from the long tables, without reading the old records."""
    fresh = build(papers, build_id, built_at, old["paper_key_alias"], None)
    new_ids = keep(fresh["paper"].select("paper_id").join(old["paper"].select("paper_id"), "paper_id", "left_anti"), "new")
    out = {}
    for name in ("paper", "paper_summary", "paper_translation", "paper_bibtex"):
        added = fresh[name].join(new_ids, "paper_id", "left_semi")
        out[name] = old[name].unionByName(added, allowMissingColumns=True)
    out["paper"] = keep(global_rank(out["paper"].drop("paper_index"), "paper_id", "paper_index").select(*PAPER_COLUMNS), "paper")
    fresh_alias = fresh["paper_key_alias"].join(old["paper_key_alias"].select("paper_key"), "paper_key", "left_anti")
    out["paper_key_alias"] = old["paper_key_alias"].unionByName(fresh_alias)
    def values(s: Snapshot) -> DataFrame:
        return s["paper_facet"].join(s["facet_node"].select("node_id", "facet_type", "value"), "node_id").select("paper_id", "facet_type", "value")

    pairs = cache(lambda: keep(values(old).unionByName(values(fresh).join(new_ids, "paper_id", "left_semi")).distinct(), "pairs"))
    out |= facet_relations(pairs)
    for c in ("year", "month"):
        out[f"{c}_count"] = out["paper"].groupBy(c).agg(F.count(F.lit(1)).alias("paper_count"))
    out["snapshot_meta"] = fresh["snapshot_meta"]
    return Snapshot(out)


def supplement(relation: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``found`` that a bridge lacks, appended; what is there is not touched."""
    new = found.join(relation.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return relation.unionByName(new.select(*relation.columns))


def migrate(paper: DataFrame) -> DataFrame:
    """A paper table of any age in today's columns; DOIs in canonical form, empty years and months ``unknown``."""
    have = [F.col(c).cast(t) if c in paper.columns else F.lit(None).cast(t).alias(c) for c, t in PAPER_COLUMNS.items()]
    whole = paper.select(*have)
    known = lambda c: F.coalesce(S.or_null(F.col(c)), F.lit("unknown"))
    return whole.withColumns({"doi": S.canonical_doi(F.col("doi")), "year": known("year"), "month": known("month")})


# Coverage


def coverage(paper: DataFrame) -> DataFrame:
    """One row: papers, and those without a source text or a PDF (null or empty)."""
    absent = lambda c: F.coalesce(F.count_if(F.coalesce(F.col(c), F.lit("")) == ""), F.lit(0))
    return paper.agg(F.count(F.lit(1)).alias("total"), absent("source_md_content_hash").alias("no_source"), absent("pdf_content_hash").alias("no_pdf"))


def coverage_by(paper: DataFrame, bridge: DataFrame, value: str, key: str = "paper_id") -> DataFrame:
    """(value, has, missing, ratio) for each value of a bridge."""
    total = paper.count()
    has = bridge.groupBy(value).agg(F.count_distinct(key).alias("has"))
    return has.select(value, "has", (F.lit(total) - F.col("has")).alias("missing"), F.round(F.col("has") / F.lit(total), 4).alias("ratio"))


def missing(paper: DataFrame, bridge: DataFrame, condition: Column, key: str = "paper_id") -> DataFrame:
    """Papers that the bridge has no row for under a condition."""
    return paper.join(bridge.where(condition).select(key), key, "left_anti")


def missing_paths(papers: DataFrame, md_hash: str, known: DataFrame) -> DataFrame:
    """(paper_id, path): where a paper's text is, else the name it would have; each path once, in order."""
    paths = papers.join(known, papers[md_hash] == known["hash"], "left")
    return paths.select("paper_id", F.coalesce("path", F.concat(F.col(md_hash), F.lit(".md"))).alias("path")).where("path IS NOT NULL").groupBy("path").agg(F.min("paper_id").alias("paper_id"))


# Unpacking


def unpack_names(paper: DataFrame, pdfs: DataFrame) -> DataFrame:
    """(paper_id, name): the name of the paper's PDF if there is one, else its title, made unique: base, base_id, base_id_n."""
    from paperloom.operators.ranking import unique_names

    base = paper.join(pdfs.select(F.col("sha256").alias("pdf_content_hash"), S.file_base(F.element_at(F.split("path", "/"), -1)).alias("pdf_name")), "pdf_content_hash", "left")
    named = base.withColumn("base", F.coalesce("pdf_name", S.or_null(S.safe_name(F.col("title"), 80)), F.col("paper_id")))
    at = F.min("paper_id").over(Window.partitionBy("base"))
    two = named.withColumn("base", F.when(F.col("paper_id") == at, F.col("base")).otherwise(F.concat_ws("_", "base", "paper_id")))
    return unique_names(two, "base", "paper_id").select("paper_id", "name")


def unpack_summaries(paper: DataFrame, summaries: DataFrame, template: str, strict: bool) -> DataFrame:
    """(paper_id, template_tag, text): the asked template's summary; unless ``strict``, the preferred one where it lacks."""
    asked = summaries.where(F.col("template_tag") == template).select("paper_id", F.col("template_tag").alias("t1"), F.col("text").alias("x1"))
    if strict:
        return paper.select("paper_id").join(asked, "paper_id").select("paper_id", F.col("t1").alias("template_tag"), F.col("x1").alias("text"))
    other = summaries.select("paper_id", F.col("template_tag").alias("preferred_summary_template"), F.col("text").alias("x2"))
    both = paper.select("paper_id", "preferred_summary_template").join(asked, "paper_id", "left").join(other, ["paper_id", "preferred_summary_template"], "left")
    return both.select("paper_id", F.coalesce("t1", F.when(F.col("x2").isNotNull(), F.col("preferred_summary_template"))).alias("template_tag"), F.coalesce("x1", "x2").alias("text")).where("text IS NOT NULL")


def doi_mismatches(papers: DataFrame, ident: str, doi: Column, raw_bibtex: Column, samples: int = 10) -> DataFrame:
    """One row: how many papers have a DOI other than that of their BibTeX entry, and the first ``samples`` of them."""
    own, other = S.canonical_doi(doi), S.doi_in_bibtex(raw_bibtex)
    unlike = keep(papers.where(own != other).select(F.col(ident).alias("ident")), "mismatches")
    first = unlike.orderBy("ident").limit(samples)
    counted = unlike.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(None).cast(unlike.schema["ident"].dataType).alias("ident"))
    both = counted.unionByName(first.select(F.lit(0).cast("long").alias("n"), "ident"))
    return both.agg(F.max("n").alias("mismatches"), F.sort_array(F.collect_list("ident")).alias("samples"))


def unpack_outcomes(paper: DataFrame, texts: DataFrame, translations: DataFrame) -> DataFrame:
    """(outcome, n): what unpacking comes to.  ``paper``: paper_id, source_md_content_hash, pdf_content_hash; ``translations``:
    paper_id, lang, md_content_hash; ``texts``: the hashes that there are.  Outcomes that occur in no paper are not listed."""
    known = texts.select(F.col("hash").alias("h"), F.lit(True).alias("there")).distinct()

    def outcomes(df: DataFrame, hashed: str, none: Column, kind: str) -> DataFrame:
        found = df.join(known, F.col(hashed) == F.col("h"), "left")
        lost = F.when(none, f"{kind}_no_hash").when(F.col("there").isNull(), f"{kind}_file_missing")
        return found.select(F.explode(F.array_compact(F.array(F.coalesce(lost, F.lit(f"{kind}_succeeded")), F.when(lost.isNotNull(), f"{kind}_failed")))).alias("outcome"))

    own = outcomes(paper, "source_md_content_hash", S.blank(F.col("source_md_content_hash")), "text")
    other = outcomes(translations, "md_content_hash", S.blank(F.col("md_content_hash")) | S.blank(F.col("lang")), "translation")
    lacking = paper.where(S.blank(F.col("pdf_content_hash"))).select(F.lit("missing_pdf").alias("outcome"))
    return own.unionByName(other).unionByName(lacking).unionByName(paper.select(F.lit("total").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
