"""Records against files, references and templates: guesses, stubs, best targets, merges, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.functions.textudf import title_key_col
from paperloom.operators.linkage import queries, resolve, targets
from paperloom.operators.ranking import first_per

# Endings that a PDF's name may have beyond its text's.
ENDINGS = ("_++", "_+", "++", "2")


def pdf_guesses(name: Column) -> Column:
    """Lower-case names under which a text's PDF may be filed, likeliest first."""
    low = F.lower(name)
    hashed = S.matched(low, r"^(.+\.pdf)(?:-[0-9a-f\-]{8,})?(?:\.md)?$", 1)
    inside = S.matched(low, r"^(.*\.pdf)-", 1)
    base = S.matched(low, r"^(.*)\.md$", 1)
    varied = [F.concat(base, F.lit(".pdf")), *[F.concat(base, F.lit(e + t)) for e in ENDINGS for t in ("", ".pdf")]]
    return F.when(hashed.isNotNull(), F.array(hashed)).when(inside.isNotNull(), F.array(inside)).when(base.isNotNull(), F.array(*varied)).otherwise(F.array().cast("array<string>"))


def by_name(records: DataFrame, ident: str, guesses: Column, files: DataFrame) -> DataFrame:
    """(ident, target, match_type, score): the file (path, name) under the first guess that any file has."""
    each = records.select(F.col(ident).alias("ident"), F.posexplode(guesses).alias("i", "name"))
    first = files.groupBy(F.lower("name").alias("name")).agg(F.min("path").alias("target"))
    hits = first_per(each.join(first, "name"), ["ident"], [F.col("i")])
    return hits.select("ident", "target", F.lit("filename").alias("match_type"), F.lit(1.0).alias("score"))


def file_targets(files: DataFrame) -> DataFrame:
    """Postings of files by the titles, years and authors in their names."""
    named = files.withColumn("ord", F.xxhash64("path")).withColumn("key", title_key_col(S.file_title(F.col("name")))).withColumn("year", S.file_year(F.col("name"))).withColumn("author", S.author_key(S.file_author(F.col("name"))))
    ranked = named.select("path", "key", "year", "author", F.col("path").alias("o"))
    return targets(ranked, "path", "o", F.col("key"), F.col("year"), F.col("author"))


def matched_files(records: DataFrame, ident: str, files: DataFrame) -> DataFrame:
    """(ident, target, match_type, score) of each record's file: by name, else by the whole title cascade.  ``records`` has
    title, authors, year and source_path."""
    name = F.element_at(F.split(F.coalesce("source_path", F.lit("")), "/"), -1)
    named = by_name(records, ident, F.concat(F.array(F.lower(name)), pdf_guesses(name)), files)
    rest = records.join(named.select(F.col("ident").alias(ident)), ident, "left_anti")
    keyed = rest.withColumn("key", title_key_col(F.coalesce("title", F.lit("")))).withColumn("first", S.author_key(F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit(""))))
    return named.unionByName(resolve(queries(keyed, ident, F.col("key"), F.col("year"), F.col("first")), file_targets(files)))


def stubs(files: DataFrame, matches: DataFrame, kind: str = "pdf_only") -> DataFrame:
    """Records for the files that none claims: title, year and author from the name."""
    left = files.join(matches.select(F.col("target").alias("path")), "path", "left_anti")
    author = S.file_author(F.col("name"))
    title = F.coalesce(S.or_null(S.file_title(F.col("name"))), F.col("name"))
    people = F.when(author.isNotNull(), F.array(author)).otherwise(F.array().cast("array<string>"))
    return left.select(title.alias("title"), people.alias("authors"), F.coalesce(S.file_year(F.col("name")), F.lit("")).alias("publication_date"), F.sha1(F.col("path").cast("binary")).alias("source_hash"), F.col("path").alias("source_path"), F.lit(True).alias(kind))


def detail(columns: dict[str, str]) -> Column:
    """Struct (filled, length): how much a record says; ``columns`` maps names to kinds."""
    filled, length = F.lit(0), F.lit(0)
    for c, kind in columns.items():
        text = F.to_json(F.col(c)) if kind in ("array", "map", "struct") else F.trim(F.col(c).cast("string"))
        has = ~S.empty_value(F.col(c), kind)
        filled = filled + has.cast("int")
        length = length + F.when(has, F.length(text)).otherwise(0)
    return F.struct(filled.alias("filled"), length.alias("length"))


def best_for_reference(matches: DataFrame, records: DataFrame, ident: str, columns: dict[str, str]) -> DataFrame:
    """Records that are the best target of some reference: most detailed, then best match, then first."""
    scored = matches.join(records.withColumn("detail", detail(columns)), matches["ident"] == records[ident])
    best = first_per(scored.select(F.col("target").alias("reference"), F.col(ident).alias("kept"), "detail", F.col("score").alias("match")), ["reference"], [-F.col("detail.filled"), -F.col("detail.length"), -F.col("match"), F.col("kept")])
    return records.join(best.select(F.col("kept").alias(ident)), ident, "left_semi")


def relaxed(asked: DataFrame, posts: DataFrame) -> DataFrame:
    """The cascade, and for what it leaves the first target of the author and year, or of the year, with score 0."""
    exact = resolve(asked, posts)
    left = asked.join(exact, "ident", "left_anti").where(F.col("year").rlike(r"^\d+$"))
    keys = F.array(F.struct(F.lit(0).alias("i"), F.lit("author_year").alias("kind"), F.concat_ws(":", "year", "author").alias("key")), F.struct(F.lit(1).alias("i"), F.lit("year").alias("kind"), F.col("year").alias("key")))
    first = posts.where(F.col("kind").isin("author_year", "year")).groupBy("kind", "key").agg(F.min(F.struct("target_ord", "target")).alias("t"))
    hits = left.select("ident", F.explode(keys).alias("k")).select("ident", "k.*").join(first, ["kind", "key"])
    loose = first_per(hits.select("ident", "i", F.col("t.target").alias("target"), F.concat("kind", F.lit("_relaxed")).alias("match_type")), ["ident"], [F.col("i")])
    return exact.unionByName(loose.select("ident", "target", "match_type", F.lit(0.0).alias("score")))


def templates_merged(base: DataFrame, others: list[tuple[str, DataFrame, DataFrame]], ident: str, fields: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base with the fields of other templates where its own are null, records that attach nowhere, differences by tag and
    field).  ``others``: tag, records, matches (ident of the other, target: ident of the base)."""
    whole, skipped, diffs = base, None, None
    for tag, df, matches in others:
        attached = df.join(matches.select(F.col("ident").alias(ident), F.col("target").alias("__to")), ident)
        lone = df.join(matches.select(F.col("ident").alias(ident)), ident, "left_anti").select(F.lit(tag).alias("tag"), F.col(ident).cast("string").alias("ident"))
        skipped = lone if skipped is None else skipped.unionByName(lone)
        one = first_per(attached.select("__to", ident, *fields), ["__to"], [F.col(ident)]).select(F.col("__to").alias(ident), *[F.col(f).alias(f"__{f}") for f in fields])
        joined = whole.join(one, ident, "left")
        unlike = F.array_compact(F.array(*[F.when(F.col(f) != F.col(f"__{f}"), F.lit(f)) for f in fields]))
        part = joined.select(F.lit(tag).alias("tag"), F.explode(unlike).alias("field"))
        diffs = part if diffs is None else diffs.unionByName(part)
        whole = joined.withColumns({f: F.coalesce(F.col(f), F.col(f"__{f}")) for f in fields}).select(*whole.columns)
    return whole, skipped, diffs.groupBy("tag", "field").agg(F.count(F.lit(1)).alias("n"))


def merge_summary(df: DataFrame, fields: Column) -> DataFrame:
    """One row: records, and the names of all fields that any has."""
    return df.agg(F.count(F.lit(1)).alias("items"), F.sort_array(F.array_distinct(F.flatten(F.collect_set(fields)))).alias("fields"))


def relative_path(path: Column, roots: list[str]) -> Column:
    """Relative to the deepest root that holds it, else the bare name."""
    out = F.element_at(F.split(path, "/"), -1)
    for r in sorted(roots, key=len):
        base = r.rstrip("/") + "/"
        out = F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(out)
    return out


def run_statistics(df: DataFrame, text: str, seconds: float) -> DataFrame:
    """One row: documents, characters, tokens as estimated, and both per minute and second."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    totals = df.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(n), F.lit(0)).alias("chars"), F.coalesce(F.sum(S.tokens_estimated(n)), F.lit(0)).alias("tokens"))
    return totals.select("*", F.round(F.col("documents") * 60 / F.lit(seconds), 2).alias("documents_per_minute"), F.round(F.col("tokens") / F.lit(seconds), 2).alias("tokens_per_second"))


def with_provenance(df: DataFrame, path: Column, text: Column, provider: str, model: str, at: Column, template: Column, language: Column, most: int = 0, how: str = "head") -> DataFrame:
    """Adds where a record comes from: source_path, source_hash, provider, model, prompt_template, output_language, extracted_at
    (ISO 8601), and, if the text was cut for the model, source_truncated and how (truncation)."""
    cut = S.truncated(F.coalesce(text, F.lit("")), most, how)
    told = F.when(cut.strategy.isNotNull(), F.struct(cut.strategy.alias("strategy"), cut.original_chars.alias("original_chars"), cut.kept_chars.alias("kept_chars")))
    return df.withColumns({
        "source_path": path,
        "source_hash": F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256),
        "provider": F.lit(provider),
        "model": F.lit(model),
        "prompt_template": template,
        "output_language": language,
        "extracted_at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "source_truncated": cut.strategy.isNotNull(),
        "truncation": told,
    })
