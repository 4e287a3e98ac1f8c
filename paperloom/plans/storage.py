"""Where intermediate and final tables go: shared folders, versioned directories."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


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


def keep(df: DataFrame, label: str = "step") -> DataFrame:
    """Write as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything to read at a path."""
    try:
        spark.read.format("text").load(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def cached(listed: DataFrame, build: Callable[[], DataFrame], folder: str) -> DataFrame:
    """What ``build`` makes of the listed files (path, size, modified), read from ``folder`` if those are what they were when it
    was written there; a file that is new, gone, changed or touched makes it anew, beside what was."""
    spark = listed.sparkSession
    row = F.xxhash64("path", F.col("size").cast("long"), F.unix_micros(F.col("modified").cast("timestamp")))
    files, sum_, xor = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor(row), F.lit(0))).first()
    path = f"{folder.rstrip('/')}/{files}-{sum_}-{xor}".replace("--", "-m")
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
