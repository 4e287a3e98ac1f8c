"""Command line: snapshots, search, comparison, statistics, splits and repairs over files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import docops, facets, linkage
from paperloom.plans import snapshot
from paperloom.session import local_session
from paperloom.sources import readers, sinks


def papers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of bundle files in the shape that snapshots are built from."""
    from paperloom.functions.scalars import or_null, strip
    from paperloom.operators.ranking import global_rank

    found = readers.records(readers.bundles(spark, paths))
    none = lambda t="string": F.lit(None).cast(t)
    fields = F.transform_keys(F.col("bibtex.fields"), lambda k, v: F.lower(k))
    summary = F.coalesce(or_null(strip(F.col("summary"))), F.col("abstract"), F.lit(""))
    tag = F.coalesce("template_tag", "prompt_template", F.lit("default"))
    shaped = found.select(
        F.concat_ws("#", "path", F.lpad(F.col("ordinal").cast("string"), 9, "0")).alias("name"), F.col("paper_title").alias("title"), "authors", F.coalesce("publication_date", F.lit("")).alias("publication_date"),
        F.col("publication_venue").alias("venue"), F.coalesce("doi", fields["doi"]).alias("doi"), F.coalesce(fields["arxiv"], fields["eprint"]).alias("arxiv"), F.col("bibtex.key").alias("bib_key"), fields["year"].alias("bib_year"), fields["month"].alias("bib_month"),
        F.coalesce(fields["journal"], fields["booktitle"]).alias("bib_venue"), F.col("bibtex.raw_entry").alias("bibtex_raw"), F.col("bibtex.key").alias("bibtex_key"), F.col("bibtex.type").alias("entry_type"),
        F.col("keyword_list").alias("keywords"), F.array().cast("array<string>").alias("institutions"), F.coalesce("ai_generated_tags", F.array().cast("array<string>")).alias("tags"), F.create_map(tag, summary).alias("summaries"),
        none("map<string,string>").alias("translations"), "source_hash", "output_language", "provider", "model", "prompt_template", "extracted_at", none().alias("pdf_content_hash"), none().alias("source_md_content_hash"),
    )
    return global_rank(shaped, "name", "ordinal").drop("name")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="paperloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple) -> None:
        p = commands.add_parser(name)
        for flags, options in arguments:
            p.add_argument(*flags, **options)

    inputs, root, out = (("inputs",), {"nargs": "+"}), (("--root",), {"required": True}), (("--out",), {"required": True})
    command("build", inputs, root, (("--build-id",), {"required": True}), (("--built-at",), {"default": ""}), (("--previous",), {}))
    command("update", inputs, root, (("--build-id",), {"required": True}), (("--built-at",), {"default": ""}))
    command("search", (("query",), {}), root, (("--sort",), {"default": ""}), (("--page",), {"type": int, "default": 1}))
    command("stats", root)
    command("coverage", root)
    command("statistics", inputs, (("--top",), {"type": int, "default": 20}))
    command("compare", (("a",), {}), (("b",), {}), out)
    command("split", inputs, out, (("--by",), {"choices": ["year", "alphabetical", "count", "tag"], "default": "year"}), (("--size",), {"type": int, "default": 100}))
    command("fix", inputs, out, (("--level",), {"default": "moderate"}))
    args = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()

    if args.command == "build":
        old = snapshot.read(spark, args.previous) if args.previous else None
        snapshot.build(papers(spark, args.inputs), args.build_id, args.built_at, old["paper_key_alias"] if old else None).write(args.root, args.build_id)
    elif args.command == "update":
        snapshot.update(snapshot.read(spark, args.root), papers(spark, args.inputs), args.build_id, args.built_at).write(args.root, args.build_id)
    elif args.command in ("search", "stats"):
        from paperloom.api import Library

        library = Library(snapshot.read(spark, args.root))
        print(json.dumps(vars(library.search(args.query, args.sort, args.page)) if args.command == "search" else library.stats(), ensure_ascii=False, indent=2))
    elif args.command == "coverage":
        snapshot.coverage(snapshot.read(spark, args.root)["paper"]).show()
    elif args.command == "statistics":
        whole = papers(spark, args.inputs)
        total = whole.count()
        for kind, c in (("tag", "tags"), ("keyword", "keywords"), ("author", "authors")):
            print(kind)
            facets.statistics(facets.labels_counted(whole, kind, F.col(c)), total, args.top).show(args.top, False)
    elif args.command == "compare":
        a, b = (papers(spark, [p]).select(F.col("ordinal").alias("ident"), "source_hash", F.lower("title").alias("title"), F.lit(None).cast("string").alias("source_path")) for p in (args.a, args.b))
        best = b.groupBy("title").agg(F.min("ident").alias("target"))
        by_title = a.join(best, "title").select("ident", "target", F.lit("title").alias("match_type"), F.lit(1.0).alias("score"))
        compared = linkage.compare(a, b, linkage.first_hits(linkage.hash_stage(a, b), by_title))
        sinks.write_compare_csv(compared, args.out)
        linkage.compare_summary(compared).orderBy("measure", "name").show(50, False)
    elif args.command == "split":
        from paperloom.functions.scalars import year_of

        whole = papers(spark, args.inputs)
        if args.by == "tag":
            sinks.write_split(sinks.by_tag(whole, F.col("tags")), args.out, "tag")
        else:
            keyed = whole.withColumn("year", year_of(F.col("publication_date")))
            sinks.write_split(sinks.split(keyed, args.by, "title" if args.by == "alphabetical" else "year", "ordinal", args.size), args.out)
    elif args.command == "fix":
        texts = readers.markdown(spark, args.inputs)
        texts.select("path", docops.fixed_col(args.level)("text").alias("text")).write.mode("overwrite").json(args.out)


if __name__ == "__main__":
    main()
