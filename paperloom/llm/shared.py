"""Folders that the driver and every executor see, and small helpers that the operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.  Where that is unset, a local session gets a temporary one,
    which goes with the process; on a cluster it is an error, as executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="paperloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as make it differ from all of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_texts(df: DataFrame, f: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` for rows that hold texts: batches of at most 8 MB (or what the session already says, if that is less),
    whatever the length of the texts, bound a worker's memory."""
    conf = df.sparkSession.conf
    if _mega(conf.get(BATCH_BYTES, "64m")) > 8:
        conf.set(BATCH_BYTES, "8m")
    return df.mapInArrow(f, schema)


def _mega(size: str) -> float:
    number, unit = re.fullmatch(r"(\d+)([kmg]?)b?", size.strip().lower()).groups()
    return int(number) / {"": 1 << 20, "k": 1 << 10, "m": 1, "g": 1 / (1 << 10)}[unit]


def base32_of_hex(hex_digest: Column, n_hex: int) -> Column:
    """RFC 4648 base32 (upper case, no padding) of a hex string whose length is a multiple of ten digits."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, i + 1, 10), 16, 32), 8, "0") for i in range(0, n_hex, 10)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


#: Bucket sizes of at most so many rows are broadcast; more are joined by key.
BROADCAST_ROWS = 65_536


def ranked(df: DataFrame, part: list[str], spread: list[str], order: list[str], out: str, buckets: int = 256, parts: int = 1) -> DataFrame:
    """Add ``out``: a gapless rank from 0 within ``part``, computed without one task per value of ``part``.

    Rows are dealt to ``buckets`` by a hash of ``spread``; the rank counts bucket by bucket and, in a bucket, by ``order``.
    ``parts`` bounds the values of ``part``: the table of bucket sizes has at most ``buckets * parts`` rows, and only if
    that is under BROADCAST_ROWS is it broadcast.  Rows that are equal in ``order`` are interchangeable.
    """
    b, n, before, at = (unused([*df.columns, out], f"__{out}_{x}") for x in ("bucket", "n", "before", "at"))
    keyed = df.withColumn(b, F.pmod(F.xxhash64(*spread), F.lit(buckets)))
    sizes = keyed.groupBy(*part, b).agg(F.count(F.lit(1)).alias(n))
    running = Window.partitionBy(*part).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(before, F.coalesce(F.sum(n).over(running), F.lit(0))).drop(n)
    within = Window.partitionBy(*part, b).orderBy(*order)
    numbered = keyed.withColumn(at, F.row_number().over(within) - F.lit(1))
    theirs = {c: unused([*numbered.columns, before], f"__{out}_of_{c}") for c in [*part, b]}
    renamed = starts.select(*[F.col(c).alias(t) for c, t in theirs.items()], before)
    same = F.lit(True)
    for c, t in theirs.items():
        same = same & F.col(c).eqNullSafe(F.col(t))
    joined = numbered.join(F.broadcast(renamed) if buckets * parts <= BROADCAST_ROWS else renamed, same, "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(at) + F.col(before)).cast("long").alias(out))
