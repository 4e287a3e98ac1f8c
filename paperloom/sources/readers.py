"""Sources: record bundles, Markdown, BibTeX, file listings, path lists, schemas."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.scalars import is_pdf_like, strip

#: The known keys of a record; all others stay readable in ``raw``.
RECORD = T.StructType([T.StructField(n, t) for n, t in (
    ("paper_title", T.StringType()), ("paper_authors", T.StringType()), ("publication_date", T.StringType()), ("publication_venue", T.StringType()),
    ("doi", T.StringType()), ("summary", T.StringType()), ("abstract", T.StringType()), ("keywords", T.StringType()), ("ai_generated_tags", T.ArrayType(T.StringType())),
    ("source_hash", T.StringType()), ("source_path", T.StringType()), ("prompt_template", T.StringType()), ("output_language", T.StringType()),
    ("provider", T.StringType()), ("model", T.StringType()), ("extracted_at", T.StringType()), ("paper_id", T.StringType()),
    ("bibtex", T.StructType([T.StructField("key", T.StringType()), T.StructField("type", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("raw_entry", T.StringType())])),
)])


def bundles(spark: SparkSession, paths: list[str] | str, strict: bool = True) -> DataFrame:
    """(path, template_tag, ordinal, raw): one row per record of ``{template_tag, papers: [...]}`` files.

    ``strict`` refuses bare arrays and unreadable files, as an error; otherwise bare arrays are records without a tag and
    unreadable files give nothing.  Files are read whole, since one is one JSON value; a file is a unit of parallelism.
    """
    files = spark.read.text(paths, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    envelope = F.from_json("value", "template_tag string, papers string")
    bare = F.from_json("value", "array<string>")
    is_list = F.ltrim("value").startswith("[")
    items = F.when(is_list, bare).otherwise(F.from_json(envelope.papers, "array<string>"))
    bad = items.isNull() | (is_list & F.lit(strict))
    checked = F.when(bad & F.lit(strict), F.raise_error(F.concat(F.lit("not a bundle: "), "path")).cast("array<string>")).otherwise(F.coalesce(items, F.array().cast("array<string>")))
    tag = F.when(~is_list, F.nullif(strip(envelope.template_tag), F.lit("")))
    return files.select("path", tag.alias("template_tag"), F.posexplode(checked).alias("ordinal", "raw"))


def records(found: DataFrame) -> DataFrame:
    """``bundles`` rows with the known keys as columns and authors, keywords and tags as arrays."""
    r = F.from_json("raw", RECORD)
    return found.select("*", r.alias("r")).select(*found.columns, "r.*").withColumns({"authors": coerced("paper_authors"), "keyword_list": coerced("keywords", ";,")})


def coerced(name: str, separators: str = ",") -> Column:
    """An array from a JSON array or a separated string, which may stand in the same column."""
    from paperloom.functions.scalars import listed

    c = F.col(name)
    items = F.filter(F.transform(F.from_json(c, "array<string>"), strip), lambda x: x != "")
    return F.when(F.ltrim(c).startswith("["), F.coalesce(items, listed(c, separators))).otherwise(listed(c, separators))


def inferred_tag(found: DataFrame, schemas: dict[str, list[str]]) -> DataFrame:
    """Tags for bundles without one: the one ``prompt_template`` all records name, else the schema that shares most keys
    with them (ties: ``simple``, else the first)."""
    keys = F.json_object_keys("raw")
    by_file = found.groupBy("path").agg(F.collect_set(F.get_json_object("raw", "$.prompt_template")).alias("named"), F.array_distinct(F.flatten(F.collect_list(keys))).alias("keys"))
    scored = [F.struct(F.size(F.array_intersect("keys", F.array(*map(F.lit, ks)))).alias("n"), F.lit(1 if name == "simple" else 0).alias("simple"), F.lit(-i).alias("i"), F.lit(name).alias("tag")) for i, (name, ks) in enumerate(schemas.items())]
    best = F.array_max(F.array(*scored)).tag
    tags = by_file.select("path", F.when(F.size("named") == 1, F.col("named")[0]).otherwise(best).alias("inferred"))
    return found.join(tags, "path").withColumn("template_tag", F.coalesce("template_tag", "inferred")).drop("inferred")


def markdown(spark: SparkSession, paths: list[str] | str, glob: str = "*.md", recursive: bool = True) -> DataFrame:
    """(path, text) of Markdown files, UTF-8 or else Latin-1, in order of path."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(paths)
    return raw.select("path", decoded(F.col("content")).alias("text")).dropDuplicates(["path"]).orderBy("path")


def decoded(content: Column) -> Column:
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def files(spark: SparkSession, paths: list[str] | str, glob: str = "*") -> DataFrame:
    """(path, name, size, modified) without reading contents."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(paths)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def pdf_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return files(spark, paths).where(is_pdf_like(F.col("name")))


def roots_summary(listed: DataFrame, roots: list[str]) -> DataFrame:
    """(root, files, size, modified): count, bytes and latest change under each root; a file counts under its deepest root."""
    deepest = F.lit(None).cast("string")
    for r in sorted(roots, key=len):
        deepest = F.when(F.regexp_replace("path", "^file:/*", "/").startswith(r.rstrip("/") + "/"), F.lit(r)).otherwise(deepest)
    return listed.withColumn("root", deepest).where("root IS NOT NULL").groupBy("root").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), F.max("modified").alias("modified"))


def translations(listed: DataFrame) -> DataFrame:
    """(base, lang, path) of ``base.lang.md`` files; the first path of a base and language."""
    p = r"^(.+)\.([^.]+)\.md$"
    named = listed.where(F.col("name").rlike("(?i)" + p)).select(F.lower(F.regexp_extract("name", "(?i)" + p, 1)).alias("base"), F.lower(F.regexp_extract("name", "(?i)" + p, 2)).alias("lang"), "path")
    return named.groupBy("base", "lang").agg(F.min("path").alias("path"))


def hash_index(spark: SparkSession, paths: list[str] | str, glob: str = "*.pdf") -> DataFrame:
    """(sha256, path): the first path of each content."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(paths)
    return raw.select(F.sha2("content", 256).alias("sha256"), "path").groupBy("sha256").agg(F.min("path").alias("path"))


def path_list(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """(path): trimmed, non-blank lines; relative ones under ``base``."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("p")).where("p != ''")
    return lines.select(F.when(F.col("p").startswith("/") | F.lit(not base), F.col("p")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), "p")).alias("path"))


def retry_targets(spark: SparkSession, path: str) -> DataFrame:
    """(path, targets): what a report says to try again, as a set of (line, field, item) per file."""
    report = spark.read.option("multiLine", "true").schema("path string, line int, field string, item int").json(path)
    return report.where("path IS NOT NULL").groupBy("path").agg(F.collect_set(F.struct("line", "field", "item")).alias("targets"))


def layouts(spark: SparkSession, root: str) -> DataFrame:
    """(folder, text) of scanned-layout folders, those that hold ``full.md``."""
    raw = spark.read.option("pathGlobFilter", "full.md").option("recursiveFileLookup", "true").text(root, wholetext=True)
    return raw.select(F.regexp_replace(F.col("_metadata.file_path"), "/full\\.md$", "").alias("folder"), F.col("value").alias("text"))


# BibTeX


def parse_bibtex(text: str) -> Iterator[dict]:
    """Entries of a BibTeX file: key, type, fields (lower-case names), persons by role, raw_entry.  Braces nest; values may
    be braced, quoted, bare, or joined by ``#``; comments, strings and preambles are passed over."""
    for m in re.finditer(r"@(\w+)\s*[{(]", text):
        kind, depth, i, quoted = m[1].lower(), 1, m.end(), False
        while i < len(text) and depth:
            ch = text[i]
            if ch == "\\":
                i += 1
            elif ch == '"' and depth == 1:
                quoted = not quoted
            elif not quoted or depth > 1:
                depth += (ch in "{(" and (ch == "{" or m[0][-1] == "(")) - (ch in "})" and (ch == "}" or m[0][-1] == "("))
            i += 1
        if kind in ("comment", "string", "preamble") or depth:
            continue
        key, _, body = text[m.end() : i - 1].partition(",")
        fields = dict(_fields(body))
        people = {role: [p.strip() for p in re.split(r"\s+and\s+", fields[role]) if p.strip()] for role in ("author", "editor") if role in fields}
        yield {"key": key.strip(), "type": kind, "fields": {k: v for k, v in fields.items() if k not in people}, "persons": people, "raw_entry": text[m.start() : i].strip()}


def _fields(body: str) -> Iterator[tuple[str, str]]:
    i = 0
    while m := re.compile(r"\s*,?\s*([\w.:-]+)\s*=\s*").match(body, i):
        i, parts = m.end(), []
        while i < len(body):
            if body[i] in '{"':
                opening, depth, j = body[i], 0, i
                while j < len(body):
                    depth += (body[j] == "{") - (body[j] == "}")
                    if j > i and ((opening == "{" and not depth) or (opening == '"' and body[j] == '"' and not depth)):
                        break
                    j += 1
                parts.append(body[i + 1 : j])
                i = j + 1
            else:
                bare = re.compile(r"[^,#\s]*").match(body, i)
                parts.append(bare[0])
                i = bare.end()
            more = re.compile(r"\s*#\s*").match(body, i)
            if not more:
                break
            i = more.end()
        yield m[1].lower(), " ".join("".join(parts).split())


def bibtex(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, ordinal, key, type, fields, persons, raw_entry) of BibTeX files."""
    schema = "path string, ordinal int, key string, type string, fields map<string,string>, persons map<string,array<string>>, raw_entry string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"path": p, "ordinal": i, **e} for p, t in zip(pdf["path"], pdf["value"]) for i, e in enumerate(parse_bibtex(t))]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "key", "type", "fields", "persons", "raw_entry"])

    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, schema)


def bibtex_text(key: Column, kind: Column, fields: Column) -> Column:
    """An entry as text, its fields by name."""
    lines = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(F.lit("  "), e.key, F.lit(" = {"), e.value, F.lit("}")))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


# Schemas


def required_schema(spec: str) -> dict:
    """A JSON schema for extraction: an object that requires a title and an array of authors, or an error."""
    schema = json.loads(spec)
    props = schema.get("properties", {})
    if schema.get("type") != "object" or not {"paper_title", "paper_authors"} <= set(schema.get("required", [])) or props.get("paper_authors", {}).get("type") != "array":
        raise ValueError("a schema is an object that requires paper_title and the array paper_authors")
    return schema


def struct_of(schema: dict) -> T.DataType:
    """Spark's type for a JSON schema."""
    kind = schema.get("type")
    kind = next((k for k in kind if k != "null"), "string") if isinstance(kind, list) else kind
    if kind == "object":
        props = schema.get("properties")
        return T.StructType([T.StructField(k, struct_of(v)) for k, v in props.items()]) if props else T.MapType(T.StringType(), T.StringType())
    if kind == "array":
        return T.ArrayType(struct_of(schema.get("items", {})))
    return {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}.get(kind, T.StringType())


def normalised_keys(data: Column, schema_keys: list[str], extras: bool = True) -> Column:
    """A map's keys as the schema spells them, matched without case and punctuation; the first of equal keys stays."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    spelled = F.create_map(*[F.lit(x) for k in schema_keys for x in (re.sub("[^a-z0-9]", "", k.lower()), k)])
    named = F.transform(F.map_entries(data), lambda e: F.struct(F.coalesce(spelled[plain(e.key)], e.key if extras else F.lit(None)).alias("key"), e.value.alias("value")))
    named = F.filter(named, lambda e: e.key.isNotNull())
    keys = F.array_distinct(F.transform(named, lambda e: e.key))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(named, lambda e: e.key == k)[0].value))


def previous(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A table of an earlier build, tolerant of its age: missing columns are null, a missing table is empty."""
    from paperloom.plans.storage import exists

    empty = ", ".join(f"{c} {t}" for c, t in columns.items())
    df = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], empty)
    return df.select(*[F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])

