"""Embedding near-copies: cross-polytope hashing after fast Hadamard rotations, several probes, verified pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.components import components
from paperloom.llm.shared import keep

#: Rows of one bucket that are compared as one block; larger buckets are compared block by block, in different tasks.
BLOCK = 2048
#: Rows of a block that are multiplied at a time: bounds a task's memory.
TILE = 512
#: Vectors that may meet in a bucket by chance: beyond that, comparing them costs more than the keys of one more hash.
BY_CHANCE = 128
#: What a pair at the least cosine may be missed with, in simulation.
MISSED = 2e-4


@dataclass(frozen=True)
class Hashing:
    """``tables`` independent keys lists; a key joins ``hashes`` cross-polytope hashes, and each vector is written under its
    ``probes`` likeliest keys."""

    hashes: int = 2
    probes: int = 4
    tables: int = 6
    seed: int = 7


def hashing_for(rows: int, dims: int, least: float = 0.9, seed: int = 7) -> Hashing:
    """Hashing for so many distinct vectors.  A key joins as many hashes as it takes for at most BY_CHANCE vectors to meet in a
    bucket by chance; probes double with each hash; and there are as many tables as leave a simulated pair at
    cosine ``least`` without a common key in MISSED of all cases.  So buckets stay small at any size, and the recall the same.
    Where a single table finds few pairs (few dimensions, low cosines), a hash less is joined."""
    size = 1 << max(1, (max(dims, 1) - 1).bit_length())
    hashes = 2
    while hashes < 6 and rows * 2**hashes / (2 * size) ** hashes > BY_CHANCE:
        hashes += 1
    while True:
        one = Hashing(hashes, 2**hashes, 1, seed)
        share = min(max(shared(one, dims, least), 0.01), 0.99)
        tables = max(2, ceil(log(MISSED) / log(1 - share)))
        if tables <= 16 or hashes == 1:
            return Hashing(hashes, 2**hashes, min(tables, 64), seed)
        hashes -= 1


@cache
def shared(how: Hashing, dims: int, least: float, pairs: int = 4000) -> float:
    """Share of random pairs at cosine ``least`` that have a key in common."""
    rng = np.random.default_rng(how.seed + 1)
    a, b = rng.normal(size=(2, pairs, max(dims, 1)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if dims > 1:
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        b = least * a + np.sqrt(1 - least**2) * b
    else:
        b = a
    hit = 0
    for at in range(0, pairs, 500):
        x, y = bucket_keys(a[at : at + 500], how), bucket_keys(b[at : at + 500], how)
        hit += int((x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).sum())
    return hit / pairs


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def bucket_keys(unit: np.ndarray, how: Hashing) -> np.ndarray:
    """(rows, tables * probes) keys of unit vectors, padded with zeros to a power of two of dimensions."""
    n, d = unit.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, size))
    x[:, :d] = unit
    rng, top = np.random.default_rng(how.seed), min(4, size)
    out = []
    for table in range(how.tables):
        keys, loss = np.full((n, 1), table, dtype=np.int64), np.zeros((n, 1))
        for _ in range(how.hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :top]
            value = np.take_along_axis(y, near, axis=1)
            vertex = 2 * near + (value < 0)
            keys = (keys[:, :, None] * (2 * size) + vertex[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + (np.abs(value[:, :1]) - np.abs(value))[:, None, :] ** 2).reshape(n, -1)
        best = np.argsort(loss, axis=1, kind="stable")[:, : how.probes]
        out.append(np.take_along_axis(keys, best, axis=1))
    return np.concatenate(out, axis=1)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, vec, digest): float64 bytes and their digest, both null for vectors that link with nothing."""
    for batch in batches:
        vecs, digests = [], []
        for v in batch.column(1):
            values = v.values
            x = None if values is None or values.null_count or not len(values) else values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
            if x is None or not np.isfinite(x).all() or not x.any():
                vecs.append(None)
                digests.append(None)
            else:
                vecs.append(x.tobytes())
                digests.append(hashlib.blake2b(vecs[-1], digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vecs, pa.binary()), pa.array(digests, pa.binary())], ["vec_id", "vec", "digest"])


def unit_rows(vecs: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision; shorter ones count as padded with zeros."""
    rows = [np.frombuffer(v, dtype="<f8") for v in vecs]
    x = np.zeros((len(rows), max(map(len, rows), default=1)))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r / np.abs(r).max()  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a binary column as a matrix of doubles, shorter ones padded with zeros; without a copy of each row where
    all are of one length."""
    at = np.frombuffer(column.buffers()[1], dtype="<i4")[column.offset : column.offset + len(column) + 1]
    width, data = int(np.diff(at).max()) // 8, column.buffers()[2]
    if (np.diff(at) == 8 * width).all():
        return np.frombuffer(data, dtype="<f8", offset=int(at[0]), count=width * len(column)).reshape(len(column), width)
    out = np.zeros((len(column), width))
    for i, x in enumerate(column.to_pylist()):
        out[i, : len(x) // 8] = np.frombuffer(x, dtype="<f8")
    return out


def _keyer(how: Hashing) -> Callable:
    """Rows (cid, copies, vec) -> (cid, copies, unit, keys), the unit vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                unit = unit_rows(part.column(2).to_pylist())
                packed = pa.array([row.tobytes() for row in unit], pa.binary())
                keys = pa.array(list(bucket_keys(unit, how)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed, keys], ["cid", "copies", "unit", "keys"])

    return run


def _joiner(least: float) -> Callable:
    """Rows (key, a, b, cid, copies, unit, keys, block), sorted by key, a, b -> (cid, links, root) per row of each block pair.

    A pair may meet in several buckets; it counts only in the least key that both have, so nothing needs removing later.
    """

    def near_pairs(unit: np.ndarray, block: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for at in range(0, len(unit), TILE):
            near = unit[at : at + TILE] @ unit[at:].T >= least
            i, j = np.nonzero(near)
            keep = j > i
            if apart:
                keep &= block[at + i] != block[at + j]
            found.append((at + i[keep], at + j[keep]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def compare(key: int, apart: bool, cid: np.ndarray, copies: np.ndarray, unit: np.ndarray, keys: np.ndarray, block: np.ndarray) -> tuple:
        i, j = near_pairs(unit, block, apart)
        links, root = np.zeros(len(cid), dtype=np.int64), np.arange(len(cid))
        for at in range(0, len(i), 4096):
            p, q = i[at : at + 4096], j[at : at + 4096]
            both = (keys[p][:, :, None] == keys[q][:, None, :]).any(axis=2)
            first = np.where(both, keys[p], np.iinfo(np.int64).max).min(axis=1) == key
            np.add.at(links, p[first], copies[q[first]])
            np.add.at(links, q[first], copies[p[first]])
        while len(i):
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        some = np.flatnonzero((links > 0) | (root != np.arange(len(cid))))
        return cid[some], links[some], cid[root[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def groups(rows: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest
            key, a, b, cid, copies, block = (rows.column(c).to_numpy() for c in ("key", "a", "b", "cid", "copies", "block"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            edges = [0, *cuts.tolist()] + ([rows.num_rows] if last else [])
            unit, keys = matrix(rows.column("unit")), rows.column("keys").flatten().to_numpy().reshape(rows.num_rows, -1)
            found = [compare(key[s], a[s] != b[s], cid[s:e], copies[s:e], unit[s:e], keys[s:e], block[s:e]) for s, e in zip(edges, edges[1:]) if e - s > 1]
            rest = [] if last else [rows.slice(edges[-1])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["cid", "links", "root"])

        for batch in batches:
            if batch.num_rows:
                yield from groups(pa.concat_batches([*rest, batch]), last=False)
        if rest and rest[0].num_rows:
            yield from groups(rest[0], last=True)

    return run


def near_embeddings(df: DataFrame, least: float = 0.9, how: Hashing | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links (other rows at cosine ``least`` or more), component_id, kept, copies.

    Equal vectors are one class, compared once and counted as often as they occur.  Null, empty, zero or non-finite
    vectors, or ones with a null component, link with nothing: n_links 0, own component, kept.  Shorter vectors count as
    padded with zeros; vectors of any length are read whole.  Repeated ids are rows like any other; a null id is never a
    component_id unless its component has no other; other columns are ignored; an empty table gives an empty result.  No
    pair is written out: the tasks that verify a bucket return a row per vector, and a bucket of any size is compared whole,
    in blocks.  ``how`` is the hashing; None takes ``hashing_for`` the number of distinct vectors.  A pair at cosine ``least``
    is found with a probability of about 1 - MISSED, in any number of dimensions; one that is nearer, more surely.
    """
    rows = keep(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")).mapInArrow(_read, "vec_id long, vec binary, digest binary"), "vectors")
    named = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    # a class without any id gets a negative number of its own
    classes = keep(named.withColumn("cid", F.coalesce("first_id", F.lit(-2) - F.shiftrightunsigned(F.xxhash64("digest"), 1))), "classes")
    if how is None:
        found, dims = classes.agg(F.count(F.lit(1)), F.max(F.octet_length("vec") / 8)).first()
        how = hashing_for(found, int(dims or 1), least)
    keyed = keep(classes.select("cid", "copies", "vec").mapInArrow(_keyer(how), "cid long, copies long, unit binary, keys array<long>"), "keyed")
    buckets = keyed.select("cid", F.explode("keys").alias("key"))
    # the aggregate is written first: the join reads plain exchanges, so a bucket of very many rows can be split
    sizes = keep(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    live = buckets.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    live = live.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    paired = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sided = paired.select("key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "cid")
    full = sided.join(keyed, "cid").select("key", "a", "b", "block", "cid", "copies", "unit", "keys")
    verified = full.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_joiner(least), "cid long, links long, root long")
    found = keep(verified, "verified")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.where("cid != root").select(F.col("cid").alias("u"), F.col("root").alias("v")))
    whole = classes.drop("vec").join(links, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
    whole = keep(whole.select("digest", "first_id", "copies", F.coalesce("root", "cid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "linked")
    # each aggregate or class table is written before it is joined: a giant component, or a vector of very many rows, can be split
    least_id = keep(whole.groupBy("root").agg(F.min("first_id").alias("component_id")), "least-ids")
    of_class = keep(whole.join(least_id, "root").select(F.col("digest").alias("class_digest"), "component_id", "copies", "n_links"), "of-class")
    joined = rows.drop("vec").join(of_class, F.col("digest") == F.col("class_digest"), "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
