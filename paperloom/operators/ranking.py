"""Ranks, picks and names by window, none of which needs the whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.plans.storage import keep


def global_rank(df: DataFrame, order: str, out: str = "rank", within: Sequence[str] = ()) -> DataFrame:
    """Add ``out``: ranks from 1 in the order of one column, as ``row_number`` would give over the whole table or, with
    ``within``, over each group of equal values; null comes first.  Groups are runs of the table's order, so none needs a task
    of its own, however large it is: a row's rank in its group is its rank less those of the groups before."""
    ranked = sorted_rank(df, [F.col(c) for c in (*within, order)], out)
    if not within:
        return ranked
    names = [f"__group{i}" for i in range(len(within))]
    first = keep(ranked.groupBy(*within).agg(F.min(out).alias("__first")).toDF(*names, "__first"), "groups")
    same = F.lit(True)
    for c, n in zip(within, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return ranked.join(first, same).select(*df.columns, (F.col(out) - F.col("__first") + 1).alias(out))


def sorted_rank(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Add ``out``: ranks from 1 over the whole table in any sort order, of several keys and directions.

    Rows are range-partitioned by the order and sorted there; the sorted rows are kept with their partition and their place
    in it, and the numbers of rows in the partitions before are added.  No task holds more than a range; equal rows in the
    order are parted by a hash of the row, so a frequent value is no range of its own.
    """
    simple = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    order = [*order, F.xxhash64(*simple)]
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = keep(sorted_rows.withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    rank = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1
    return kept.join(F.broadcast(starts), part == F.col("__part")).select(*df.columns, rank.cast("long").alias(out))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``: picked by an aggregate that combines map-side, so a frequent key costs no
    more than a row per task.  The order must be total for the result to be the same on every run."""
    columns = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    picked = F.min_by(F.struct(*columns), ranked) if columns else F.lit(None)
    return df.groupBy(*keys).agg(picked.alias("__row")).select(*keys, *[F.col(f"__row.{c}") for c in columns])


def unique_names(df: DataFrame, base: str, order: str, out: str = "name", start: int = 0) -> DataFrame:
    """base, base_1, base_2, ... in ``order`` within each base, however many rows have it."""
    ranked = global_rank(df, order, "__at", [base])
    at = F.col("__at") - 1 + start
    return ranked.withColumn(out, F.when(at == 0, F.col(base)).otherwise(F.concat_ws("_", F.col(base), at.cast("string")))).drop("__at")


def hashed_names(df: DataFrame, base: str, order: str, source: str, out: str = "name") -> DataFrame:
    """The first of a base keeps it; the others get eight digits of their source's hash."""
    first = keep(df.groupBy(F.col(base).alias("__base")).agg(F.min(order).alias("__first")), "firsts")
    marked = df.join(first, F.col(base).eqNullSafe(F.col("__base"))).drop("__base")
    named = F.when(F.col(order) == F.col("__first"), F.col(base)).otherwise(F.concat_ws("_", F.col(base), F.substring(F.sha1(F.col(source).cast("binary")), 1, 8)))
    return marked.withColumn(out, named).drop("__first")


def chunked(df: DataFrame, order: str, size: int, out: str = "chunk") -> DataFrame:
    """Number of the fixed-size chunk, from 0, in the order of one column."""
    ranked = global_rank(df, order, "__rank")
    return ranked.withColumn(out, F.floor((F.col("__rank") - 1) / size).cast("long")).drop("__rank")


#: Letters that are several in upper case, but have one capital of their own: sharp s, and Greek with a subscript iota.
IOTA = [chr(i) for i in range(0x1F80, 0x2000) if len(chr(i).upper()) > 1 and len(chr(i).title()) == 1]
CAPITALS = {"ß": "ẞ"} | {x: x.title() for x in IOTA}


def lead(c: Column) -> Column:
    """Without the blanks in front."""
    return F.regexp_replace(c, r"^\p{Zs}+", "")


def initial(c: Column) -> Column:
    """Upper-case first letter of a title, one character always, ``#`` for none."""
    first = F.substring(lead(F.coalesce(c, F.lit(""))), 1, 1)
    capital = F.translate(first, "".join(CAPITALS), "".join(CAPITALS.values()))
    one = F.when(F.length(F.upper(capital)) == 1, F.upper(capital)).otherwise(capital)
    return F.when(first == "", "#").otherwise(one)


def slice_rows(df: DataFrame, order: str, start: int, end: int = -1) -> DataFrame:
    """Rows ``start`` up to, not including, ``end`` in order; an end of -1 is the end of the table."""
    ranked = global_rank(df, order, "__rank").where(F.col("__rank") > start)
    return (ranked if end == -1 else ranked.where(F.col("__rank") <= end)).drop("__rank")
