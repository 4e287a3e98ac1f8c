"""Facets: values of documents by type, counts, co-occurrence, listings and related values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.scalars import blank, facet_value, is_month, is_year, leading_int
from paperloom.operators.ranking import global_rank

# Names that listings accept, by facet type.
FACET_TYPES = (
    "author", "keyword", "institution", "tag", "venue", "year", "month", "summary_template",
    "output_language", "provider", "model", "prompt_template", "translation_lang",
)
ALIASES = {"templates": "summary_template", "translations": "translation_lang"}


def facet_type(name: str) -> str:
    """Singular, plural or alias of a facet type; unknown names are an error."""
    low = name.strip().lower()
    found = ALIASES.get(low, low if low in FACET_TYPES else low.removesuffix("s"))
    if found not in FACET_TYPES:
        raise ValueError(f"unknown facet {name}")
    return found


def incidence(df: DataFrame, key: str, facets: dict[str, Column]) -> DataFrame:
    """(key, facet_type, value), distinct.  ``facets`` maps a type to a string or array column; values are normalised, and
    empty ones and ``unknown`` never become facets."""
    pairs = []
    for kind, c in facets.items():
        values = c if dict(df.select(c.alias("c")).dtypes)["c"].startswith("array") else F.array(c)
        pairs.append(F.transform(values, _typed(kind)))
    wide = df.select(F.col(key), F.explode(F.concat(*[F.coalesce(p, F.array().cast("array<struct<facet_type:string,value:string>>")) for p in pairs])).alias("f"))
    return wide.select(key, "f.*").where(~F.col("value").isin("", "unknown")).distinct()


def _typed(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("facet_type"), facet_value(v).alias("value"))


def nodes(pairs: DataFrame, key: str) -> DataFrame:
    """(node_id, facet_type, value, paper_count).  Ids are ranks within (type, value) order, the same on every run."""
    counted = pairs.groupBy("facet_type", "value").agg(F.count(F.lit(1)).alias("paper_count"))
    ranked = global_rank(counted, "value", "r", within=["facet_type"])
    sizes = counted.groupBy("facet_type").agg(F.count(F.lit(1)).alias("n"))  # a row per facet type: at most 13
    before = F.coalesce(F.sum("n").over(Window.orderBy("facet_type").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("facet_type").alias("t"), before.alias("before"))
    joined = ranked.join(F.broadcast(starts), F.col("facet_type") == F.col("t"))
    return joined.select((F.col("r") + F.col("before")).cast("long").alias("node_id"), "facet_type", "value", "paper_count")


def edges(pairs: DataFrame, key: str) -> DataFrame:
    """(type_a, value_a, type_b, value_b, paper_count) for each unordered pair of values of one document, a before b.
    A document has few values, so the self join stays within it: its size is the sum of their squares."""
    sets = pairs.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("facet_type", "value"))).alias("fs"))
    each = sets.select(F.posexplode("fs").alias("i", "a"), "fs")
    both = each.select("a", F.explode(F.slice("fs", F.col("i") + 2, F.greatest(F.size("fs") - F.col("i") - 1, F.lit(0)))).alias("b"))
    return both.groupBy(F.col("a.facet_type").alias("type_a"), F.col("a.value").alias("value_a"), F.col("b.facet_type").alias("type_b"), F.col("b.value").alias("value_b")).agg(F.count(F.lit(1)).alias("paper_count"))


def related(pairs: DataFrame, key: str, kind: str, value: str) -> DataFrame:
    """(facet_type, value, paper_count) of the values that share documents with one value.  Reads the documents of that
    value and their other values: no edge table is needed, and an unknown value gives an empty result."""
    low = facet_value(F.lit(value))
    mine = (F.col("facet_type") == facet_type(kind)) & (F.col("value") == low)
    with_it = pairs.where(mine).select(key)
    return pairs.where(~mine).join(with_it, key, "left_semi").groupBy("facet_type", "value").agg(F.count(F.lit(1)).alias("paper_count"))


def related_by_type(pairs: DataFrame, key: str, kind: str, value: str, most: int = 20) -> DataFrame:
    """(facet_type, values): the ``most`` most frequent related values of each type, count descending, then value."""
    order = Window.partitionBy("facet_type").orderBy(F.desc("paper_count"), "value")
    top = related(pairs, key, kind, value).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    listed = F.array_sort(F.collect_list(F.struct("rank", "value", "paper_count")))
    return top.groupBy("facet_type").agg(F.transform(listed, lambda x: F.struct(x.value.alias("value"), x.paper_count.alias("paper_count"))).alias("values"))


def listing(counted: DataFrame, kind: str) -> DataFrame:
    """Values of one type in display order: years newest first and numbers before others, months by number, others by count."""
    kind = facet_type(kind)
    own = counted.where(F.col("facet_type") == kind).select("value", "paper_count")
    if kind == "year":
        return own.orderBy(F.when(is_year(F.col("value")), 0).otherwise(1), leading_int(F.col("value")).desc(), "value")
    if kind == "month":
        return own.orderBy(F.when(is_month(F.col("value")), 0).otherwise(1), "value")
    return own.orderBy(F.desc("paper_count"), "value")


def page(ordered: DataFrame, number: int = 1, size: int = 20, most_size: int = 100, deepest: int = 10_000) -> DataFrame:
    """One page of an ordered result; sizes and depths beyond the limits are errors."""
    if number < 1 or not 1 <= size <= most_size or number * size > deepest:
        raise ValueError("page out of range")
    return ordered.offset((number - 1) * size).limit(size)


def documents_with(pairs: DataFrame, key: str, kind: str, value: str, docs: DataFrame) -> DataFrame:
    low = facet_value(F.lit(value))
    hits = pairs.where((F.col("facet_type") == facet_type(kind)) & (F.col("value") == low)).select(key)
    return docs.join(hits, key, "left_semi")


def with_orphans(dimension: DataFrame, pairs: DataFrame, on: str) -> DataFrame:
    """Counts for every value of a dimension table, 0 for those that no document has."""
    counted = pairs.groupBy(on).agg(F.count(F.lit(1)).alias("paper_count"))
    return dimension.join(counted, on, "left").withColumn("paper_count", F.coalesce("paper_count", F.lit(0)))


def labels_counted(df: DataFrame, kind: str, values: Column, stub: Column | None = None, absent: str = "Unknown") -> DataFrame:
    """Counts by value of an array column, ``absent`` for documents without any; stubs do not count."""
    rows = df if stub is None else df.where(~F.coalesce(stub, F.lit(False)))
    exploded = rows.select(F.explode_outer(values).alias("value"))
    shown = F.when(blank(F.col("value")), F.lit(absent)).otherwise(F.col("value"))
    return exploded.groupBy(shown.alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("facet_type"), "value", "n")


def dashboard(pairs: DataFrame, tops: dict[str, int], key: str) -> DataFrame:
    """(facet_type, value, paper_count, rank): the most frequent values of several types in one pass over the pairs."""
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in tops.items() for x in kv]), F.col("facet_type"))
    counted = pairs.where(F.col("facet_type").isin(*tops)).groupBy("facet_type", "value").agg(F.count(F.lit(1)).alias("paper_count"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("facet_type").orderBy(F.desc("paper_count"), "value")))
    return ranked.where(F.col("rank") <= limit)


def statistics(counted: DataFrame, total: Column | int, most: int = 20) -> DataFrame:
    """``counted`` (value, n) -> the ``most`` frequent with their percentage of ``total`` and a bar scaled to the largest."""
    from paperloom.functions.scalars import bar, share

    top = counted.orderBy(F.desc("n"), "value").limit(most)
    largest = F.max("n").over(Window.partitionBy())  # over at most ``most`` rows
    whole = total if isinstance(total, Column) else F.lit(total)
    return top.select("value", "n", share(F.col("n"), whole).alias("percent"), bar(F.col("n"), largest).alias("bar"))
