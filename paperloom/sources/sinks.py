"""Sinks: comparison CSV, path lists, splits by value, JSON documents, content-addressed files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.ranking import chunked, initial

# The columns of a comparison file.
COMPARE_COLUMNS = ("side", "source_hash", "title", "match_status", "match_type", "match_score", "source_path", "other_source_hash", "other_title", "other_source_path", "lang")


def compare_rows(compared: DataFrame) -> DataFrame:
    """A comparison as strings in file order of columns; scores with four decimals, nulls empty."""
    text = lambda c: F.format_string("%.4f", c) if c == "match_score" else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return compared.select(*[text(c).alias(c) for c in COMPARE_COLUMNS])


def write_compare_csv(compared: DataFrame, path: str) -> None:
    compare_rows(compared).write.option("header", True).mode("overwrite").csv(path)


def only_in_b(compared: DataFrame) -> DataFrame:
    return compared.where("side = 'B' AND match_status = 'only_in_B' AND coalesce(source_path, '') != ''").select(F.col("source_path").alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    """One line per row of the only column, each once, in order."""
    (c,) = df.columns
    df.select(F.col(c).cast("string")).distinct().orderBy(c).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def by_tag(df: DataFrame, tags: Column) -> DataFrame:
    """A row per tag of a record: what one file per tag holds."""
    return df.withColumn("tag", F.explode(F.array_distinct(tags)))


def split(df: DataFrame, how: str, column: str, order: str, size: int = 100) -> DataFrame:
    """Adds ``part``: the year, the title's first letter, or the number of the fixed-size chunk."""
    if how == "year":
        return df.withColumn("part", F.coalesce(F.col(column).cast("string"), F.lit("unknown")))
    if how == "alphabetical":
        return df.withColumn("part", initial(F.col(column)))
    if how == "count":
        return chunked(df, order, size, "part").withColumn("part", F.col("part").cast("string"))
    raise ValueError(f"unknown split {how}")


def write_split(df: DataFrame, path: str, part: str = "part") -> None:
    """A directory per value."""
    df.write.mode("overwrite").partitionBy(part).json(path)


def blobs(df: DataFrame, content: Column) -> DataFrame:
    """(sha256, content): each content once."""
    return df.select(F.sha2(content, 256).alias("sha256"), content.alias("content")).where("content IS NOT NULL").groupBy("sha256").agg(F.first("content").alias("content"))


def write_new_blobs(found: DataFrame, path: str) -> None:
    """Adds contents that the store lacks; what is there is not written again."""
    from paperloom.plans.storage import exists

    if exists(found.sparkSession, path):
        found = found.join(found.sparkSession.read.parquet(path).select("sha256"), "sha256", "left_anti")
    found.write.mode("append").parquet(path)


def bibtex_merged(entries: DataFrame) -> DataFrame:
    """One entry per key: most fields and persons, ties to the first."""
    from paperloom.operators.linkage import kept_best

    people = F.aggregate(F.map_values("persons"), F.lit(0), lambda a, p: a + F.size(p))
    return kept_best(entries, ["key"], F.size("fields") + F.size("persons") + people, "ordinal")


def rendered(df: DataFrame, template: str, columns: list[str]) -> Column:
    """A text for each row from a ``{name}`` template, in native code."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        parts.append(F.lit(head))
        name, _, rest = tail.partition("}") if brace else ("", "", "")
        if name in columns:
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
        elif name:
            raise ValueError(f"no column {name}")
    return F.concat(*parts)


def rendered_records(df: DataFrame, record: str, template: str, out: str = "markdown") -> DataFrame:
    """Adds each record (a JSON object in the column ``record``) as a text in a template with conditions and loops."""
    from paperloom.functions.rendering import rendered as write

    @F.pandas_udf("string")
    def texts(found: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else write(json.loads(x), template) for x in found], index=found.index, dtype=object)

    return df.withColumn(out, texts(F.col(record)))


def copied(listed: DataFrame, roots: list[str], target: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies: path, to, content; counts: outcome, n) of a list of paths: each under ``target`` at its place relative to the
    deepest root that holds it; ``known`` (path, content) is what there is.  Paths that it lacks are counted as missing."""
    from paperloom.operators.records import relative_path

    found = listed.select("path").distinct().join(known.select("path", "content"), "path", "left")
    to = F.concat(F.lit(target.rstrip("/") + "/"), relative_path(F.col("path"), roots))
    counts = found.groupBy(F.when(F.col("content").isNull(), "missing").otherwise("copied").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return found.where("content IS NOT NULL").select("path", to.alias("to"), "content"), counts
