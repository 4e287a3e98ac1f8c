"""The library's service: search, browsing and statistics over a snapshot, as DataFrames and plain values.

Every call checks its arguments, builds one plan and reads back one page; nothing is looked up row by row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.scalars import asset_url, facet_value, in_order
from paperloom.functions.textudf import snippet_col
from paperloom.operators import facets, search
from paperloom.operators.dsl import search_sort, structured
from paperloom.plans.snapshot import Snapshot

# Limits of the service.
MOST_QUERY, MOST_PAGE, DEEPEST, MOST_TOOL_ROWS = 500, 100, 10_000, 100


class NotFound(LookupError):
    pass


@dataclass
class Page:
    total: int
    page: int
    page_size: int
    items: list[dict]

    @property
    def has_more(self) -> bool:
        return bool(self.items) and self.page * self.page_size < self.total


def checked_query(text: str | None) -> str:
    text = (text or "").strip()
    if len(text) > MOST_QUERY:
        raise ValueError("query too long")
    return text


def checked_id(ident: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.:-]{1,128}", ident or ""):
        raise ValueError("bad paper id")
    return ident


def clamped(limit: int) -> int:
    return min(max(1, limit), MOST_TOOL_ROWS)


class Library:
    """``texts``: (paper_id, source, translated) to search beside titles, summaries and metadata; none searches only those."""

    def __init__(self, snapshot: Snapshot, static_base: str = "", texts: DataFrame | None = None):
        self.snapshot, self.base = snapshot, static_base
        self.spark = snapshot["paper"].sparkSession
        meta = {r.key: r.value for r in snapshot["snapshot_meta"].collect()}
        self.build_id = meta.get("snapshot_build_id")
        paper = snapshot["paper"]
        if "doi" not in paper.columns:
            paper = paper.withColumn("doi", F.lit(None).cast("string"))
        self.papers = paper
        pairs = snapshot["paper_facet"].join(snapshot["facet_node"].select("node_id", "facet_type", "value"), "node_id")
        self.pairs = pairs.select("paper_id", "facet_type", "value")
        self.texts = texts
        self._index: tuple[DataFrame, DataFrame] | None = None

    # Full text

    @property
    def index(self) -> tuple[DataFrame, DataFrame]:
        """Postings in order of term, and tokens by paper: made once and kept in the shared folder, so that no query reads
        the texts again."""
        if self._index is None:
            from paperloom.plans.storage import keep

            meta = self.lists().select("paper_id", F.concat_ws(" ", F.flatten(F.array("authors", "keywords", "institutions", "tags"))).alias("m"))
            wide = self.papers.select("paper_id", "title", F.col("summary_preview").alias("summary"), "venue", "year", "doi").join(meta, "paper_id", "left")
            wide = wide.join(self.texts, "paper_id", "left") if self.texts is not None else wide.withColumns({"source": F.lit(""), "translated": F.lit("")})
            columns = {c: F.col(c) for c in ("title", "summary", "source", "translated")} | {"metadata": F.concat_ws(" ", "m", "venue", "year", "doi")}
            posts = keep(search.by_term(search.postings(wide, "paper_id", columns), "paper_id"), "postings")
            self._index = posts, keep(search.lengths(posts, "paper_id"), "lengths")
        return self._index

    def search(self, text: str = "", sort: str = "", page: int = 1, page_size: int = 20) -> Page:
        text = checked_query(text)
        sort = sort or ("relevance" if text else "year_desc")
        rows = self.papers
        query = search.parse(text)
        if text:
            posts, sizes = self.index
            rows = rows.join(search.ranked(posts, "paper_id", query, sizes=sizes), "paper_id")
        elif sort == "relevance":
            raise ValueError("relevance needs a query")
        order = ["score"] if sort == "relevance" else search_sort(sort, F.col("title"), F.col("venue"), F.col("year"))
        snippet = snippet_col("summary_preview", query.terms) if text else F.lit(None).cast("string")
        return self._page(rows.withColumn("snippet", snippet), [*order, F.col("paper_id")], page, page_size, ["snippet", *(["score"] if text else [])])

    # Browsing

    def lists(self) -> DataFrame:
        """(paper_id, authors, keywords, institutions, tags, languages): gathered once for all rows of a page."""
        kinds = {"author": "authors", "keyword": "keywords", "institution": "institutions", "tag": "tags", "translation_lang": "languages"}
        grouped = self.pairs.where(F.col("facet_type").isin(*kinds)).groupBy("paper_id")
        return grouped.agg(*[F.sort_array(F.collect_set(F.when(F.col("facet_type") == k, F.col("value")))).alias(n) for k, n in kinds.items()])

    def _page(self, rows: DataFrame, order: list[Column | str], page: int, size: int, extra: list[str] | None = None) -> Page:
        wanted = facets.page(rows.orderBy(*order), page, size, MOST_PAGE, DEEPEST)
        names = ["paper_id", "title", "year", "venue", "doi", "summary_preview", "paper_index", "preferred_summary_template", *(extra or [])]
        found = wanted.select(*names, *self._assets()).collect()
        ids = [r.paper_id for r in found]
        lists = {r.paper_id: r.asDict() for r in self.lists().where(F.col("paper_id").isin(ids)).collect()} if ids else {}
        none = dict.fromkeys(("authors", "keywords", "institutions", "tags", "languages"), [])
        return Page(rows.count(), page, size, [{**none, **lists.get(r.paper_id, {}), **r.asDict()} for r in found])

    def _assets(self) -> list[Column]:
        url = lambda folder, c, ext: asset_url(self.base, folder, F.col(c), ext, self.build_id)
        has = lambda c: (F.coalesce(F.col(c), F.lit("")) != "").alias
        return [url("pdf", "pdf_content_hash", "pdf").alias("pdf_url"), url("md", "source_md_content_hash", "md").alias("source_url"), has("pdf_content_hash")("has_pdf"), has("source_md_content_hash")("has_source")]

    def paper(self, ident: str) -> dict:
        row = self.papers.where(F.col("paper_id") == checked_id(ident)).select("*", *self._assets()).first()
        if row is None:
            raise NotFound(ident)
        lists = self.lists().where(F.col("paper_id") == ident).first()
        tags = self.snapshot["paper_summary"].where(F.col("paper_id") == ident).groupBy().agg(F.sort_array(F.collect_set("template_tag")).alias("t"))
        ordered = tags.select(in_order(F.col("t"), F.array(F.lit(row.preferred_summary_template))).alias("t")).first().t
        langs = {r.lang: r.md_content_hash for r in self.snapshot["paper_translation"].where(F.col("paper_id") == ident).collect()}
        base = f"{self.base.rstrip('/')}"
        urls = {t: f"{base}/summary/{ident}/{t}.json?v={self.build_id}" for t in ordered}
        return {**row.asDict(), **(lists.asDict() if lists else {}), "templates": ordered, "summary_urls": urls, "translated_urls": {k: f"{base}/md_translate/{k}/{v}.md?v={self.build_id}" for k, v in langs.items()}}

    def bibtex(self, ident: str) -> dict:
        if "paper_bibtex" not in self.snapshot.relations:
            raise NotFound(ident)
        row = self.snapshot["paper_bibtex"].where(F.col("paper_id") == checked_id(ident)).first()
        if row is None:
            raise NotFound(ident)
        return row.asDict()

    def facet(self, name: str, page: int = 1, page_size: int = 20) -> Page:
        ordered = facets.listing(self.snapshot["facet_node"], name)
        found = facets.page(ordered, page, page_size, MOST_PAGE, DEEPEST).collect()
        return Page(ordered.count(), page, page_size, [r.asDict() for r in found])

    def facet_papers(self, name: str, value: str, page: int = 1, page_size: int = 20) -> Page:
        rows = facets.documents_with(self.pairs, "paper_id", name, value, self.papers)
        return self._page(rows, [*search_sort("year_desc", F.col("title"), F.col("venue"), F.col("year")), F.col("paper_id")], page, page_size)

    def facet_stats(self, name: str, value: str, most: int = 20) -> dict:
        kind = facets.facet_type(name)
        same = (F.col("facet_type") == kind) & (F.col("value") == facet_value(F.lit(value)))
        total = self.pairs.where(same).select("paper_id").distinct().count()
        found = facets.related_by_type(self.pairs, "paper_id", name, value, most).collect()
        return {"total": total, "related": {r.facet_type: [v.asDict() for v in r["values"]] for r in found}}

    def stats(self) -> dict:
        tops = {"year": 50, "month": 12, **dict.fromkeys(("author", "keyword", "institution", "tag", "venue"), 20)}
        out: dict[str, list] = {k: [] for k in tops}
        for r in facets.dashboard(self.pairs, tops, "paper_id").orderBy("facet_type", "rank").collect():
            out[r.facet_type].append({"value": r.value, "paper_count": r.paper_count})
        return {"total": self.papers.count(), **out}

    # Tools

    def keyword_search(self, keyword: str, limit: int = 10) -> list[dict]:
        return self.filter(keyword=keyword, limit=limit)

    def filter(self, author: str | None = None, venue: str | None = None, year: str | None = None, keyword: str | None = None, tag: str | None = None, limit: int = 10) -> list[dict]:
        """Papers under all given conditions; years in descending order of text, so that unknown ones come first."""
        wanted = {k: checked_query(v) for k, v in (("author", author), ("keyword", keyword), ("tag", tag)) if v}
        bridges = {k: self.pairs.where(F.col("facet_type") == k).select("paper_id", "value") for k in wanted}
        rows = structured(self.papers, "paper_id", bridges, wanted, (F.col("venue"), venue) if venue else None, (F.col("year"), year) if year else None)
        found = rows.orderBy(F.desc("year"), "title", "paper_id").limit(clamped(limit)).select("paper_id", "title", "year", "venue", "doi")
        return [r.asDict() for r in found.collect()]

    def top_facets(self, name: str, limit: int = 20) -> list[dict]:
        own = self.snapshot["facet_node"].where(F.col("facet_type") == facets.facet_type(name))
        return [r.asDict() for r in own.orderBy(F.desc("paper_count"), "value").limit(clamped(limit)).select("value", "paper_count").collect()]
