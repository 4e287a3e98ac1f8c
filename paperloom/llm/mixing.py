"""Pfair mixing: blocks of each source get windows from its target weight; earliest deadline first interleaves them."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import accumulate, islice
from math import ceil, floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from paperloom.llm.shared import BROADCAST_ROWS, new_folder, ranked, unused

#: Slots of the schedule that the driver holds at a time; a longer one is written piece by piece.
MOST_SLOTS = 1 << 20
#: Window ends this near to a whole slot are that slot: they are sums of doubles.
NEAR = 1e-6


def target_weights(counts: dict, power: float = 0.5, grain: int = 1000) -> dict:
    """Integer weights in proportion to a power of the source sizes, one at least, about ``grain`` together: for display,
    as ``mix`` holds to the weights that they are rounded from."""
    raw = exact_weights(counts, power)
    return {k: max(1, round(grain * v / sum(raw.values()))) for k, v in raw.items()}


def exact_weights(counts: dict, power: float = 0.5, given: dict | None = None) -> dict:
    """Each source's weight: a power of its size or, for those that ``given`` names, their part of its sum, the others
    together being as much again as their powers' part of all powers."""
    raw = {k: float(n) ** power for k, n in counts.items()}
    whole = sum(raw.values())
    share = {k: v / whole for k, v in raw.items()}
    if given:
        most = sum(given.values())
        share |= {k: given[k] / most for k in counts if k in given}
    return share


class Fluid:
    """The ideal mixture: sources flow at rates in proportion to their weights until they are empty, one slot's worth a
    slot.  Source i has had ``weight * v`` at virtual time v, and all of its blocks from v = blocks / weight on."""

    def __init__(self, blocks: list[int], weights: list[float]):
        self.blocks, self.weights = blocks, weights
        ends = sorted((n / w, w, i) for i, (n, w) in enumerate(zip(blocks, weights)) if n)
        self.v, self.t = [0.0], [0.0]
        # rates from the last end backwards, so that small weights are not lost in differences
        self.rate = list(accumulate(w for _, w, _ in reversed(ends)))[::-1]
        for (v, _, _), rate in zip(ends, self.rate):
            self.t.append(self.t[-1] + (v - self.v[-1]) * rate)
            self.v.append(v)
        self.phase = [0] * len(blocks)

    def when(self, i: int, had: int) -> float:
        """The slot at which source i has had so many blocks; asked for in rising order."""
        if had == 0:
            return 0.0
        v, k = had / self.weights[i], self.phase[i]
        while k + 1 < len(self.rate) and self.v[k + 1] < v:
            k += 1
        self.phase[i] = k
        if k == 0:  # as a quotient, which is whole where the share is
            return had * self.rate[0] / self.weights[i]
        return self.t[k] + (v - self.v[k]) * self.rate[k]


def slots(blocks: list[int], weights: list[float]) -> Iterator[int]:
    """The source in each slot, for all blocks.

    Block j of a source may start at the slot in which the ideal mixture has passed j of its blocks, and must end by that in
    which it passes j + 1; of the blocks that may start, the earliest deadline goes first, ties to the first source.  The
    ideal mixture fills every slot, so all deadlines are met: every source has, after any number of slots, less than one block
    more or less than in the ideal mixture.  Memory is in proportion to the sources, time to the slots.
    """
    fluid = Fluid(blocks, weights)
    waiting: list[tuple[int, int, int]] = []  # release, deadline, source
    ready: list[tuple[int, int]] = []
    done = [0] * len(blocks)
    ends = [0.0] * len(blocks)

    def next_block(i: int) -> None:
        if done[i] < blocks[i]:
            start, ends[i] = ends[i], fluid.when(i, done[i] + 1)
            heappush(waiting, (floor(start + NEAR), ceil(ends[i] - NEAR), i))

    for i in range(len(blocks)):
        next_block(i)
    for t in range(sum(blocks)):
        while waiting and (waiting[0][0] <= t or not ready):
            _, deadline, i = heappop(waiting)
            heappush(ready, (deadline, i))
        _, i = heappop(ready)
        yield i
        done[i] += 1
        next_block(i)


def period(spark: SparkSession, weights: list[int]) -> list[int]:
    """The source in each slot of one period, whose length is the sum of the (integer) weights."""
    return list(slots(weights, weights))


def schedule(spark: SparkSession, blocks: list[int], weights: list[float]) -> Iterator[tuple]:
    """(source number, first block, blocks, weight, period, first slot, places in the period) for every source and every
    run of MOST_SLOTS slots; a run is one period, in which the source's weight is the number of its blocks there."""
    found, at, done = slots(blocks, weights), 0, [0] * len(blocks)
    while run := list(islice(found, MOST_SLOTS)):
        places: dict[int, list[int]] = {}
        for place, i in enumerate(run):
            places.setdefault(i, []).append(place)
        for i in sorted(places):
            yield i, done[i], len(places[i]), len(places[i]), len(run), at, places[i]
            done[i] += len(places[i])
        at += len(run)


def mix(docs: DataFrame, weights: dict | None = None, block: int = 32, power: float = 0.5, id_col: str = "doc_id", source_col: str = "source", most_sources: int = 1 << 20) -> DataFrame:
    """Every row of ``docs``, with all its columns, and mix_block (of its source), mix_slot (when that block comes),
    mix_place (in the block).  Sorting by slot and place gives the mixture; no row is dropped or repeated.

    ``weights`` gives target weights (any positive numbers) by source; sources it does not name, and all if it is None, get
    ``power`` of their size.  The order of documents within a source is by a hash of the id.  At every slot each source has
    had less than one block more or less than its target, which is its exact share, unrounded, of the slots; when a source
    runs out, the others' shares are renewed from there on.  Blocks of equal deadlines come in the order of their sources'
    names, documents of equal hashes in that of their ids.  Null sources are one source; null or repeated ids are rows like
    any other; columns that have those three names already are replaced, any others are kept, whatever their names; an empty
    table gives an empty result.  The driver holds a row a source, about half a kilobyte; over ``most_sources`` of them are
    an error.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_block", "mix_slot", "mix_place")
    counts = {r[0]: r[1] for r in docs.groupBy(source_col).agg(F.count(F.lit(1))).limit(most_sources + 1).collect()}
    if len(counts) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    names = sorted(counts, key=lambda x: (x is not None, x))
    aims = exact_weights(counts, power, weights)
    blocks = [-(-counts[k] // block) for k in names]
    plan = _table(spark, names, schedule(spark, blocks, [aims[k] for k in names]), docs.schema[source_col].dataType, sum(blocks))
    # about 20,000 documents of the largest source meet in one bucket, whatever its size
    buckets = max(1, min(256, BROADCAST_ROWS // max(1, len(names))), max(counts.values(), default=0) // 20_000)
    rank, of, at, slot = (unused(docs.columns, f"__{x}") for x in ("rank", "source", "block", "slot"))
    ordered = ranked(docs, [source_col], [id_col], [F.xxhash64(id_col, F.lit("mix")), F.col(id_col)], rank, buckets, len(names))
    placed = ordered.withColumn("mix_block", F.floor(F.col(rank) / block).cast("long")).withColumn("mix_place", (F.col(rank) % block).cast("int"))
    theirs = plan.select(F.col("source").alias(of), F.col("block").alias(at), F.col("slot").alias(slot))
    theirs = F.broadcast(theirs) if sum(blocks) <= BROADCAST_ROWS else theirs
    joined = placed.join(theirs, F.col(source_col).eqNullSafe(F.col(of)) & (F.col("mix_block") == F.col(at)))
    return joined.withColumn("mix_slot", F.col(slot)).select(*[F.col(f"`{c}`") for c in docs.columns], "mix_block", "mix_slot", "mix_place")


def _table(spark: SparkSession, names: list, rows: Iterator[tuple], kind, total: int) -> DataFrame:
    """The schedule as a table of source, block and slot.  The driver holds MOST_SLOTS slots of it at a time."""
    fields = StructType([StructField("__source", kind), StructField("__first", LongType()), StructField("__at", LongType()), StructField("__places", ArrayType(IntegerType()))])

    def frame(part: list[tuple]) -> DataFrame:
        return spark.createDataFrame([(names[r[0]], r[1], r[5], r[6]) for r in part], fields, verifySchema=False)

    if total <= MOST_SLOTS:
        runs = frame(list(rows))
    else:
        path, part = new_folder(spark, "mix-schedule"), []
        for r in rows:
            if part and part[-1][5] != r[5]:
                frame(part).write.mode("append").parquet(path)
                part = []
            part.append(r)
        frame(part).write.mode("append").parquet(path)
        runs = spark.read.parquet(path)
    each = runs.select(F.col("__source").alias("source"), "__first", "__at", F.posexplode("__places").alias("__k", "__place"))
    return each.select("source", (F.col("__first") + F.col("__k")).alias("block"), (F.col("__at") + F.col("__place")).alias("slot"))


def in_mixed_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of ``mix``'s rows in order of slot and place, in as many ordered partitions as their number asks
    for.  Slots and places are never null and no two rows share both, so the order is whole; an empty table stays empty."""
    ordered = mixed.repartitionByRange("mix_slot").sortWithinPartitions("mix_slot", "mix_place")
    return ordered.select(*[F.col(f"`{c}`") for c in columns])
