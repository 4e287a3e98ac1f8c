"""Files that a snapshot is served from: summaries, manifests, the index, texts with images by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.operators.ranking import first_per


def summary_documents(paper: DataFrame, summaries: DataFrame) -> DataFrame:
    """(path, json): ``summary/<id>.json`` with the preferred summary, and one file for each template.  ``summaries``:
    paper_id, template_tag, text."""
    base = paper.select("paper_id", F.col("title").alias("paper_title"), "year", "venue", "preferred_summary_template")
    tags = summaries.groupBy("paper_id").agg(F.array_sort(F.collect_set("template_tag")).alias("available_templates"))
    each = summaries.join(base, "paper_id").join(tags, "paper_id")
    fields = ["paper_id", "paper_title", "year", "venue", "template_tag", F.col("text").alias("summary")]
    one = each.select(F.concat(F.lit("summary/"), "paper_id", F.lit("/"), "template_tag", F.lit(".json")).alias("path"), F.to_json(F.struct(*fields)).alias("json"))
    best = each.where("template_tag = preferred_summary_template")
    return one.unionByName(best.select(F.concat(F.lit("summary/"), "paper_id", F.lit(".json")).alias("path"), F.to_json(F.struct(*fields, "available_templates")).alias("json")))


def manifests(paper: DataFrame, authors: DataFrame, translations: DataFrame, summaries: DataFrame, images: DataFrame) -> DataFrame:
    """(path, json) of each paper's files.  ``authors`` (paper_id, value), ``images`` (paper_id, path, sha256, ext, status):
    of an image listed twice, the available one."""
    first = authors.groupBy("paper_id").agg(F.min("value").alias("author"))
    langs = translations.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("lang", F.concat(F.lit("md_translate/"), "lang", F.lit("/"), "md_content_hash", F.lit(".md")).alias("static_path"), F.concat(F.lit("translated/"), "lang", F.lit(".md")).alias("zip_path"), F.col("md_content_hash").alias("sha256")))).alias("translated_md"))
    tags = summaries.groupBy("paper_id").agg(F.array_sort(F.collect_set(F.struct("template_tag", F.concat(F.lit("summary/"), "paper_id", F.lit("/"), "template_tag", F.lit(".json")).alias("static_path"), F.concat(F.lit("summaries/"), "template_tag", F.lit(".json")).alias("zip_path")))).alias("summary_templates"))
    once = first_per(images.where("coalesce(path, '') != ''"), ["paper_id", "path"], [F.when(F.col("status") == "available", 0).otherwise(1), F.coalesce("sha256", F.lit(""))])
    shown = once.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("static_path"), "sha256", "ext", "status"))).alias("images"))
    whole = paper.join(first, "paper_id", "left").join(langs, "paper_id", "left").join(tags, "paper_id", "left").join(shown, "paper_id", "left")
    author = F.coalesce("author", F.lit("unknown"))

    def asset(folder: str, hashed: str, ext: str, name: Column) -> Column:
        has = ~S.blank(F.col(hashed))
        return F.struct(F.when(has, F.concat(F.lit(f"{folder}/"), hashed, F.lit(f".{ext}"))).alias("static_path"), F.when(has, name).alias("zip_path"), F.col(hashed).alias("sha256"))

    pdf = F.concat(F.coalesce(S.or_null(S.safe_name(F.concat_ws("_", author, "year", "title"), 120)), F.col("paper_id")), F.lit(".pdf"))
    assets = F.struct(asset("pdf", "pdf_content_hash", "pdf", pdf).alias("pdf"), asset("md", "source_md_content_hash", "md", F.lit("source.md")).alias("source_md"), "translated_md", "summary_templates")
    body = F.struct("paper_id", S.folder_name(author, F.col("year"), F.col("title"), F.col("paper_id")).alias("folder_name"), assets.alias("assets"), "images")
    return whole.select(F.concat(F.lit("manifest/"), "paper_id", F.lit(".json")).alias("path"), F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def index(paper: DataFrame, bibtex: DataFrame) -> DataFrame:
    """A row per paper for the static index, with DOI and citation key where there is one."""
    keys = bibtex.select("paper_id", "bibtex_key")
    return paper.join(keys, "paper_id", "left").select("paper_id", "title", "year", "venue", "doi", "bibtex_key", "paper_index")


def write_documents(documents: DataFrame, path: str) -> None:
    """(path, json) rows as JSON lines, spread by path: a store that a server can look up, with no file per paper."""
    documents.repartitionByRange("path").sortWithinPartitions("path").write.mode("overwrite").json(path)


def images_by_content(df: DataFrame, key: str, text: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts whose local image links point at ``images/<sha256>.<ext>``, inventory: key, path, sha256, ext, status).
    ``files``: path, content."""
    links = F.filter(F.array_distinct(S.markdown_images(F.col(text))), lambda x: ~x.rlike("(?i)^(https?|data|mailto|file):|^[#/]"))
    each = df.select(key, F.explode(links).alias("link"))
    hashed = files.select(F.col("path").alias("link"), F.sha2("content", 256).alias("sha256"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"))
    found = each.join(hashed, "link", "left").withColumn("path", F.when(F.col("sha256").isNotNull(), F.concat(F.lit("images/"), "sha256", F.lit("."), "ext")))
    moves = found.where("path IS NOT NULL").groupBy(key).agg(F.collect_set(F.struct("link", "path")).alias("__m"))
    put = F.aggregate(F.coalesce("__m", F.array().cast("array<struct<link:string,path:string>>")), F.col(text), lambda a, m: F.replace(F.replace(a, F.concat(F.lit("]("), m.link, F.lit(")")), F.concat(F.lit("]("), m.path, F.lit(")"))), F.concat(F.lit("]("), m.link, F.lit(" ")), F.concat(F.lit("]("), m.path, F.lit(" "))))
    status = F.when(F.col("path").isNotNull(), "available").otherwise("missing")
    return df.join(moves, key, "left").withColumn(text, put).drop("__m"), found.select(key, F.coalesce("path", "link").alias("path"), "sha256", "ext", status.alias("status"))


def fields_fixed(df: DataFrame, fields: list[str], level: str = "moderate") -> tuple[DataFrame, DataFrame]:
    """(records whose Markdown fields are repaired, how many values of each field changed)."""
    from paperloom.operators.docops import fixed_col

    marked = df.withColumns({f"__{f}": fixed_col(level)(f) for f in fields})
    counts = marked.agg(*[F.count_if(~F.col(f).eqNullSafe(F.col(f"__{f}"))).alias(f) for f in fields])
    pairs = counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("changed")) for f in fields])).alias("x")).select("x.*")
    return marked.select(*[F.col(f"__{c}").alias(c) if c in fields else F.col(c) for c in df.columns]), pairs


def records_fixed(df: DataFrame, template: Column, level: str = "moderate") -> tuple[DataFrame, DataFrame]:
    """``fields_fixed`` for records of several templates: in each record the Markdown fields of its own template are repaired,
    those of the default where it names none; other fields stay as they are.  Fields that are no columns are passed over."""
    from paperloom.operators.docops import fixed_col
    from paperloom.plans.generation import STAGES, markdown_fields

    tag = F.coalesce(S.or_null(S.strip(template)), F.lit(""))
    wanted = F.create_map(*[x for name in STAGES for x in (F.lit(name), F.array(*map(F.lit, markdown_fields(name))))])
    mine = F.coalesce(F.try_element_at(wanted, tag), F.array(*map(F.lit, markdown_fields(""))))
    fields = [c for c in df.columns if any(c in markdown_fields(name) for name in ("", *STAGES))]
    done = {f: F.when(F.array_contains(mine, F.lit(f)), fixed_col(level)(F.col(f))).otherwise(F.col(f)) for f in fields}
    whole = df.select("*", *[v.alias(f"__{f}") for f, v in done.items()])
    counts = whole.agg(*[F.count_if(~F.col(f).eqNullSafe(F.col(f"__{f}"))).alias(f) for f in fields])
    listed = counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("changed")) for f in fields])).alias("x")).select("x.*")
    return whole.select(*[F.col(f"__{c}").alias(c) if c in fields else F.col(c) for c in df.columns]), listed
