"""Balanced label propagation: linked documents move to their neighbours' shards under capacity quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import keep, ranked


#: Rows of a large group that one task ranks together.
CELL_PART = 100_000


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, gid): gid is the digest of the text, the hub that links equal texts; null for null."""
    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"), F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"), F.sha2(text, 256).alias("gid"))


def _place(*columns: Column) -> Column:
    """A hash of the columns as a number from 0 up to 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def propagate(cells: DataFrame, quota: float, shards: int, rounds: int) -> DataFrame:
    """``cells`` (gid, start: first shard, n: documents), groups of two documents or more -> (gid, start, shard).

    What moves is a cell: the documents of one group that started in one shard, so the table has at most ``shards`` rows
    for a group of any size.  Each round, a group's leading shards are those where it has most documents, as many as it
    needs at ``quota`` documents each, equal ones in the order of a hash; its cells ask to move there, into the first until
    that would be full, and so on.  A shard that is asked for more than it has free accepts that share of the groups, by
    hash; the rest try again in the next round.  The rounds end when none asks to move, when two rounds have moved none, as
    what is asked for is full, or after ``rounds``, of which a few suffice: the free room shrinks with each.
    """
    cells, idle = keep(cells.select("gid", "start", "n", F.col("start").alias("shard"), F.lit(False).alias("moved")), "cells"), 0
    for k in range(rounds):
        load = {r[0]: r[1] for r in cells.groupBy("shard").agg(F.sum("n")).collect()}  # at most one row a shard
        held = cells.groupBy("gid", "shard").agg(F.sum("n").alias("here"))
        order = Window.partitionBy("gid").orderBy(F.desc("here"), F.xxhash64("gid", "shard"))
        places = held.withColumn("rank", F.row_number().over(order)).withColumn("total", F.sum("here").over(Window.partitionBy("gid")))
        wanted = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(quota))).cast("int")
        leaders = places.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("rank", "shard"))).alias("all"), F.first("total").alias("total"), F.first(wanted).alias("m"))
        leaders = leaders.select("gid", "total", F.slice(F.col("all").shard, F.lit(1), F.col("m")).alias("leading"))
        earlier = Window.partitionBy("gid").orderBy(F.xxhash64("gid", "start")).rowsBetween(Window.unboundedPreceding, -1)
        asked = cells.join(leaders, "gid").withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        turn = F.least(F.floor(F.col("before") / F.lit(quota)), F.size("leading") - 1) + 1
        asked = keep(asked.withColumn("to", F.element_at("leading", turn.cast("int"))).drop("leading", "before"), "asked")
        demand = {r[0]: r[1] for r in asked.where("to != shard").groupBy("to").agg(F.sum("n")).collect()}
        if not demand:
            break
        big = (F.col("total") > quota).cast("int")  # a large group moves cell by cell, others whole
        open_share = F.array(*[F.lit(min(1.0, max(0.0, quota - load.get(s, 0)) / demand[s]) if s in demand else 0.0) for s in range(shards)])
        accepted = _place(F.col("gid"), F.col("start") * big, F.lit(k)) < F.element_at(open_share, F.col("to") + 1)
        cells = keep(asked.select("gid", "start", "n", F.when(accepted, F.col("to")).otherwise(F.col("shard")).alias("shard"), (accepted & (F.col("to") != F.col("shard"))).alias("moved")), "cells")
        idle = idle + 1 if cells.where("moved").isEmpty() else 0
        if idle == 2:
            break
    return cells.select("gid", "start", "shard")


def shard(docs: DataFrame, shards: int = 40, rounds: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Law: the shards' row counts are at most one apart.  Documents with equal texts are linked, through their text's
    digest and not pair by pair, and share a shard as far as quotas allow; a group larger than a shard fills several.
    Documents without links fill what is left.  A null text has no link, size 16 and the checksum of nothing; a text of any
    length is one document, hashed whole.  Null or repeated ids are rows like any other, and rows that are equal in id and
    text are interchangeable; other columns are ignored, whatever their names; an empty table gives an empty result; fewer rows than
    shards leave shards empty.  Everything stays in DataFrame operations; what reaches the driver is a row for each shard.
    """
    start = F.pmod(F.xxhash64("doc_id", "gid"), F.lit(shards)).cast("int")
    base = keep(described(docs, id_col, text_col).withColumn("start", start), "sharding")
    total = base.count()
    most = [total // shards + (s < total % shards) for s in range(shards)]
    # counted by cell before anything is joined: a group of very many rows is at most ``shards`` rows from here on
    cells = keep(base.where("gid IS NOT NULL").groupBy("gid", "start").agg(F.count(F.lit(1)).alias("n")), "cells")
    groups = cells.groupBy("gid").agg(F.sum("n").alias("members")).where("members > 1")
    linked = keep(cells.join(groups, "gid"), "linked")
    homes = propagate(linked, max(1.0, total / shards), shards, rounds)
    # a group is ranked as one run, but a large one cell by cell, and a large cell in parts, so that no task ranks very many rows
    large = F.col("members") > max(64, total // shards // 16)
    parts = F.when(large, F.ceil(F.col("n") / CELL_PART)).otherwise(1).cast("int")
    homes = keep(homes.join(linked, ["gid", "start"]).select("gid", "start", "shard", F.when(large, F.col("start")).otherwise(-1).alias("cell"), parts.alias("parts")), "homes")
    run = F.xxhash64("gid", "cell", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).alias("run")
    settled = base.join(homes, ["gid", "start"]).select("doc_id", "size", "text_crc32", "gid", "start", "shard", run)
    settled = keep(ranked(settled, ["shard"], ["run"], ["run", "gid", "doc_id", "text_crc32"], "slot", max(256, total // shards // 1_000_000), shards), "settled")
    quota = F.array(*map(F.lit, most))
    fits = F.col("slot") < F.element_at(quota, F.col("shard") + 1)
    kept = {r[0]: r[1] for r in settled.where(fits).groupBy("shard").count().collect()}
    free, starts = 0, []
    for s in range(shards):
        starts.append(free)
        free += most[s] - kept.get(s, 0)
    # documents of one group that found no room stay neighbours in the rank, in runs of 64, so they mostly move together
    moved = settled.where(~fits).select(*base.columns, F.xxhash64("gid", F.floor(F.col("slot") / 64)).alias("run"))
    alone = base.join(homes, ["gid", "start"], "left_anti").select(*base.columns, F.xxhash64("doc_id", "gid").alias("run"))
    loose = ranked(moved.unionByName(alone), [], ["run"], ["run", "gid", "doc_id", "text_crc32"], "r", max(1024, total // 1_000_000)).drop("run")
    # shards that take none share their start with the next one; the last of equal starts is the one with room
    lot = F.size(F.filter(F.array(*map(F.lit, starts)), lambda x: x <= F.col("r"))) - 1
    dealt = loose.withColumn("shard", lot.cast("int"))
    at = F.element_at(F.array(*[F.lit(kept.get(s, 0) - starts[s]) for s in range(shards)]), F.col("shard") + 1)
    columns = ["doc_id", "size", "text_crc32", "gid", "shard", "slot"]
    both = settled.where(fits).select(columns).unionByName(dealt.withColumn("slot", (F.col("r") + at).cast("long")).select(columns))
    return both.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
