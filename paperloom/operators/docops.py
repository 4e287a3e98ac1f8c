"""Document operators over DataFrames: Arrow-batched columns around the pure text functions, and joins that put repairs back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from paperloom.functions import markdown as M
from paperloom.functions import spans as S
from paperloom.functions import translation as T
from paperloom.functions.rendering import display_parts
from paperloom.functions.textudf import per_text

BLOCKS = "array<struct<kind:string,content:string>>"
SPANS = "array<struct<start:int,end:int,delimiter:string,content:string,line:int,context:string>>"
FROZEN = "struct<text:string,frozen:map<string,string>>"

blocks_col = per_text(BLOCKS)(lambda t: [{"kind": b.kind, "content": b.content} for b in M.parse_blocks(t)])
segments_col = per_text(BLOCKS)(lambda t: [{"kind": k, "content": c} for k, c in M.segments(t)])
math_spans_col = per_text(SPANS)(lambda t: [vars(s) for s in S.math_spans(t)])
diagram_spans_col = per_text(SPANS)(lambda t: [vars(s) for s in S.diagram_spans(t)])
formula_col = per_text("string")(S.cleaned_formula)
diagram_col = per_text("string")(S.cleaned_diagram)
formula_errors_col = per_text("array<string>")(S.formula_errors)
diagram_errors_col = per_text("array<string>")(S.diagram_errors)
references_col = per_text("string")(M.fix_references)
links_col = per_text("string")(M.fix_links)
links_apart_col = per_text("string")(lambda t: M.fix_links(t, apart=True))
paragraphs_col = per_text("string")(M.merge_paragraphs)
pseudocode_col = per_text("string")(M.wrap_pseudocode)
titles_col = per_text("string")(M.fix_titles)
own_fences_col = per_text("string")(M.fences_on_own_lines)
closed_fences_col = per_text("string")(M.without_open_fences)
legends_col = per_text("string")(M.legends_out_of_diagrams)
footnotes_col = per_text("string")(M.fix_footnotes)
images_apart_col = per_text("string")(M.images_apart)
math_apart_col = per_text("string")(M.math_apart)
tables_unwrapped_col = per_text("string")(M.tables_unwrapped)
placeholder_only_col = per_text("boolean")(lambda t: not T.has_letters(t))
#: The text under the empty key, and what is held back from it under the names that stand in it.
display_col = per_text("map<string,string>")(lambda t: {"": display_parts(t)[0], **display_parts(t)[1]})
identifier_col = per_text("boolean")(T.is_identifier)
person_col = per_text("boolean")(T.is_person)


def fixed_col(level: str = "moderate", apart: bool = False) -> Callable[[Column], Column]:
    return per_text("string")(lambda t: M.fix_markdown(t, level, apart))


def segments_of(most: int) -> Callable[[Column], Column]:
    return per_text(BLOCKS)(lambda t: [{"kind": k, "content": c} for k, c in M.segments(t, most)])


def protected(df: DataFrame, text: str, **options: bool) -> DataFrame:
    """Adds ``protected`` (the text with placeholders) and ``frozen`` (placeholder to raw text)."""
    schema = df.select("*", F.lit("").alias("protected"), F.create_map(F.lit(""), F.lit("")).alias("frozen")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [M.protect(t or "", **options) for t in pdf[text]]
            yield pdf.assign(protected=[d[0] for d in done], frozen=[{v: k for k, v in d[1].by_text.items()} for d in done])

    return df.mapInPandas(run, schema)


def restored(c: Column, frozen: Column) -> Column:
    """Placeholders back to their texts, last frozen first, without leaving the engine: the name's number is the order."""
    entries = F.reverse(F.array_sort(F.transform(F.map_entries(frozen), lambda e: F.struct(F.regexp_extract(e.key, r"(\d{6})__$", 1).alias("n"), e.key.alias("k"), e.value.alias("v")))))
    line = lambda a, e: F.when(e.v.endswith("\n"), F.replace(a, F.concat(e.k, F.lit("\n")), e.v)).otherwise(a)
    return F.aggregate(entries, c, lambda a, e: F.replace(line(a, e), e.k, e.v))


def exploded(df: DataFrame, key: str, array: Column) -> DataFrame:
    """(key, ord, fields of the elements)."""
    each = df.select(F.col(key), F.posexplode(array).alias("ord", "x"))
    return each.select(key, "ord", "x.*")


def reassembled(pieces: DataFrame, key: str, content: str = "content", order: str = "ord") -> DataFrame:
    """The pieces of each document joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, content)))
    return pieces.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[content]), "").alias("text"))


def spliced(df: DataFrame, key: str, text: str, repairs: DataFrame) -> DataFrame:
    """``repairs`` (key, start, end, value; positions from 0) put into the texts, from the end backwards."""
    listed = repairs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "value")), asc=False).alias("__r"))
    put = F.aggregate(F.coalesce("__r", F.array().cast("array<struct<start:int,end:int,value:string>>")), F.col(text), lambda a, r: F.concat(F.substr(a, F.lit(1), r["start"]), r["value"], F.substr(a, r["end"] + 1)))
    return df.join(listed, key, "left").withColumn(text, put).drop("__r")


def repaired(df: DataFrame, key: str, text: str, find: Column, errors: Callable[[Column], Column], clean: Callable[[Column], Column], ask: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts with repairs, report).  Each span is validated; the bad ones are cleaned and validated again; those still
    bad go to ``ask`` (rows of key, ord, content -> key, ord, value) if there is one, and are validated once more."""
    found = exploded(df, key, find).withColumn("errors", errors(F.col("content")))
    bad = found.where(F.size("errors") > 0).withColumn("value", clean(F.col("content"))).withColumn("left", errors(F.col("value")))
    good = bad.where(F.size("left") == 0).withColumn("how", F.lit("cleaned"))
    worse = bad.where(F.size("left") > 0)
    if ask is not None:
        answers = ask(worse.select(key, "ord", "content")).select(key, "ord", F.col("value").alias("answer"))
        again = worse.join(answers, [key, "ord"], "left").withColumn("left2", errors(F.coalesce("answer", "value")))
        fixed = again.where(F.col("answer").isNotNull() & (F.size("left2") == 0)).withColumn("value", F.col("answer")).withColumn("how", F.lit("repaired"))
        failed = again.where(F.col("answer").isNull() | (F.size("left2") > 0)).withColumn("how", F.lit("failed"))
        columns = [key, "ord", "line", "start", "end", "content", "value", "errors", "how"]
        done, report = good.select(columns).unionByName(fixed.select(columns)), failed.select(columns)
    else:
        columns = [key, "ord", "line", "start", "end", "content", "value", "errors", "how"]
        done, report = good.select(columns), worse.withColumn("how", F.lit("failed")).select(columns)
    inner = done.select(key, "start", "end", "value", "content")
    # a span's position includes its marks; the value replaces what is between them
    mark = ((F.col("end") - F.col("start") - F.length("content")) / 2).cast("int")
    moves = inner.select(key, (F.col("start") + mark).alias("start"), (F.col("end") - mark).alias("end"), "value")
    return spliced(df, key, text, moves), done.unionByName(report)


@F.pandas_udf(DoubleType())
def confidence_col(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else M.split_confidence(a, b) for a, b in zip(before, after)], index=before.index, dtype="float64")


@F.pandas_udf(StringType())
def failure_col(source: pd.Series, target: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else T.failure(s, t, g) for s, t, g in zip(source, target, lang)], index=source.index, dtype=object)


@F.pandas_udf(StringType())
def realigned_col(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or t is None else T.realigned(s, T.typos_fixed(t, set(T.PLACEHOLDER.findall(s)))) if t.strip() else t for s, t in zip(source, target)], index=source.index, dtype=object)


def translate(df: DataFrame, key: str, text: str, lang: str, call: Callable[[DataFrame], DataFrame], most: int = 4000, group: int = 8000, level: str = "moderate", rounds: int = 3, apart: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents with ``translated``, nodes that stayed untranslated).

    Fix, freeze, cut into nodes; ``call`` takes (key, ord, source) and returns (key, ord, target), and is asked again for
    what fails the check, ``rounds`` times in all; what still fails keeps its source.  Each round sees only the failed set.
    """
    from paperloom.plans.storage import keep

    ready = df.select(key, fixed_col(level, apart)(F.coalesce(F.col(text), F.lit(""))).alias("fixed"))
    frozen = keep(protected(ready, "fixed"))
    nodes = keep(exploded(frozen, key, segments_of(most)(F.col("protected"))))
    todo = nodes.where((F.col("kind") == "node") & ~placeholder_only_col("content")).select(key, "ord", F.col("content").alias("source"))
    done = None
    for _ in range(rounds):
        answers = call(todo).select(key, "ord", "target")
        checked = keep(todo.join(answers, [key, "ord"], "left").withColumn("target", realigned_col("source", "target")).withColumn("why", failure_col("source", "target", F.lit(lang))))
        good = checked.where("target IS NOT NULL AND why IS NULL").select(key, "ord", "target")
        done = good if done is None else done.unionByName(good)
        todo = checked.where("target IS NULL OR why IS NOT NULL").select(key, "ord", "source")
        if todo.isEmpty():
            break
    whole = nodes.join(done, [key, "ord"], "left").withColumn("content", F.coalesce("target", "content"))
    joined = frozen.join(reassembled(whole, key), key, "left")
    return joined.select(key, restored(F.coalesce("text", F.lit("")), F.col("frozen")).alias("translated")), todo


def grouped(nodes: DataFrame, key: str, most: int) -> DataFrame:
    """(key, group, text): each document's nodes (key, ord, content) in order, packed greedily into requests."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("ord")
        texts = M.group_nodes(list(zip(rows["ord"], rows["content"])), most)
        return pd.DataFrame({key: [rows[key].iloc[0]] * len(texts), "group": range(len(texts)), "text": texts})

    return nodes.groupBy(key).applyInPandas(run, f"{key} {dict(nodes.dtypes)[key]}, group int, text string")


def ungrouped(replies: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """Replies back to (key, ord, content); nodes that no reply holds keep their own text."""
    tags = F.regexp_extract_all("text", F.lit(r"(?s)<NODE_START_(\d{4,})>\n.*?\n</NODE_END_\1>"), F.lit(0))
    each = replies.select(key, F.explode(tags).alias("t"))
    found = each.select(key, F.regexp_extract("t", r"<NODE_START_(\d+)>", 1).cast("int").alias("ord"), F.regexp_extract("t", r"(?s)^<NODE_START_\d+>\n(.*)\n</NODE_END_\d+>$", 1).alias("reply"))
    return nodes.join(found, [key, "ord"], "left").select(key, "ord", F.coalesce("reply", "content").alias("content"))


def embedded(df: DataFrame, key: str, text: str, images: DataFrame) -> DataFrame:
    """Local image targets become data URLs where ``images`` (path, mime, content) has them."""
    from paperloom.functions.scalars import markdown_images

    each = df.select(key, F.explode(F.array_distinct(markdown_images(F.col(text)))).alias("path")).join(images, "path")
    urls = each.groupBy(key).agg(F.collect_list(F.struct("path", F.concat(F.lit("data:"), "mime", F.lit(";base64,"), F.base64("content")).alias("url"))).alias("__u"))
    put = F.aggregate(F.coalesce("__u", F.array().cast("array<struct<path:string,url:string>>")), F.col(text), lambda a, u: F.replace(F.replace(a, F.concat(F.lit("]("), u.path, F.lit(")")), F.concat(F.lit("]("), u.url, F.lit(")"))), F.concat(F.lit("]("), u.path, F.lit(" ")), F.concat(F.lit("]("), u.url, F.lit(" "))))
    return df.join(urls, key, "left").withColumn(text, put).drop("__u")


def unpacked(df: DataFrame, key: str, text: str, folder: str = "images") -> tuple[DataFrame, DataFrame]:
    """(texts whose data URLs are links to files named by content hash, (name, mime, content) once per content)."""
    from paperloom.functions.scalars import data_url, markdown_images

    links = F.filter(F.array_distinct(markdown_images(F.col(text))), lambda x: x.startswith("data:"))
    each = df.select(key, F.explode(links).alias("url")).withColumn("d", data_url(F.col("url"))).where("d.content IS NOT NULL")
    kind = F.regexp_replace(F.regexp_replace(F.regexp_extract("d.mime", r"/([A-Za-z0-9]+)", 1), "^jpeg$", "jpg"), "^svg$", "svg")
    named = each.withColumn("name", F.concat(F.lit(f"{folder}/"), F.substring(F.sha2("d.content", 256), 1, 12), F.lit("."), kind))
    moves = named.groupBy(key).agg(F.collect_set(F.struct("url", "name")).alias("__m"))
    put = F.aggregate(F.coalesce("__m", F.array().cast("array<struct<url:string,name:string>>")), F.col(text), lambda a, m: F.replace(a, m.url, m["name"]))
    files = named.groupBy("name").agg(F.first("d.mime").alias("mime"), F.first("d.content").alias("content"))
    return df.join(moves, key, "left").withColumn(text, put).drop("__m"), files


def image_inventory(df: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, path, status): each distinct image of a document once, ``available`` if ``known`` (path) has it or it is remote."""
    from paperloom.functions.scalars import markdown_images

    each = df.select(key, F.explode(F.array_distinct(markdown_images(F.col(text)))).alias("path"))
    have = known.select("path", F.lit(True).alias("__have")).distinct()
    remote = F.col("path").rlike("(?i)^(https?|data):")
    return each.join(have, "path", "left").select(key, "path", F.when(remote | F.col("__have"), "available").otherwise("missing").alias("status"))
