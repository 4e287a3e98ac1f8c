"""SimHash fingerprints, linked by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.components import components
from paperloom.llm.golay import fuzzy_keys
from paperloom.llm.shared import keep, map_texts, unused

#: A-Z to a-z on UTF-8 bytes; no other byte changes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The 64 bits as three segments: (shift, width).
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Fingerprints of one bucket that are compared as one block.  A larger bucket is cut by Golay keys of the third segment, and
#: what is larger even then is compared block by block, in different tasks.
BLOCK = 1024


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the ``width``-word shingles of one text; 0 for null or wordless texts."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest, last = xxhash.xxh64_intdigest, width - 1
    if len(words) < width:
        hashes = [digest(joined, seed)]
    else:
        hashes = [digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[last:])]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are those set in over half of ``hashes``."""
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "digest", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest: a hash of the text, fp long) for every row: one narrow pass over whole texts, no shuffle."""
    text = F.col(text_col).cast("binary")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return map_texts(narrow, _fingerprints, "doc_id long, digest long, fp long")


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pigeonhole: with at most two differing bits, one of three segments is equal, and the next one differs in at most two
    bits.  A key is that exact segment with a Golay index of the next: 22 + 12 bits, so random fingerprints rarely meet."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        parts = _segments(fp)
        keys, owners = [], []
        for i in range(3):
            index, used = fuzzy_keys(parts[(i + 1) % 3])
            key = (np.int64(i) << 40) | (parts[i][:, None] << 12) | index
            keys.append(key[used])
            owners.append(np.broadcast_to(fp[:, None], key.shape)[used])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], ["key", "fp"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) -> (key, sub, fp): the third segment, too, differs in at most two bits, so its Golay indices cut a bucket and
    no pair is lost."""
    for batch in batches:
        key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        parts = np.stack(_segments(fp))
        third = parts[((key >> 40) + 2) % 3, np.arange(len(fp))]
        index, used = fuzzy_keys(third)
        spread = lambda x: np.broadcast_to(x[:, None], index.shape)[used]
        yield pa.RecordBatch.from_arrays([pa.array(spread(key)), pa.array(index[used]), pa.array(spread(fp))], ["key", "sub", "fp"])


def _close(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.bitwise_count((u ^ v).view(np.uint64)) <= 2


def _hubs(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that it reaches over the pairs i < j."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    return root


def _star(fp: np.ndarray, block: np.ndarray, apart: bool) -> np.ndarray:
    """Pairs (hub, row) of one large bucket, or of two blocks of it (``apart``), for the rows that are linked with any."""
    found = []
    for at in range(0, len(fp), 256):
        i, j = np.nonzero(_close(fp[at : at + 256, None], fp[None, at:]))
        pairs = np.stack([at + i, at + j])[:, j > i]
        found.append(pairs[:, block[pairs[0]] != block[pairs[1]]] if apart else pairs)
    root = _hubs(len(fp), *np.concatenate(found, axis=1))
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return np.stack([root[moved], moved])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sub, a, b, block, fp), sorted by the first four -> edges (u, v) from each fingerprint to the hub of those
    that it is linked with in its block pair: a row a fingerprint, never a row a pair."""
    rest: list[pa.RecordBatch] = []

    def stars(rows: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal rest
        mark = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("key", "sub", "a", "b")])
        fp, block = rows.column("fp").to_numpy(), rows.column("block").to_numpy()
        new = np.concatenate([[True], (mark[:, 1:] != mark[:, :-1]).any(axis=0)])
        starts = np.flatnonzero(new)
        end = rows.num_rows if last else int(starts[-1])
        rest = [] if last else [rows.slice(end)]
        sizes = np.diff(np.append(starts, rows.num_rows))
        group = np.cumsum(new) - 1
        found = []
        small = sizes <= 64
        for gap in range(1, min(64, int(sizes[small].max(initial=0)))):  # neighbours in small buckets, all buckets at once
            i = np.flatnonzero((group[:-gap] == group[gap:]) & small[group[gap:]])
            i = i[i + gap < end]
            found.append(np.stack([i, i + gap])[:, _close(fp[i], fp[i + gap])])
        for g in np.flatnonzero(~small):
            s, e = int(starts[g]), int(starts[g] + sizes[g])
            if e <= end:
                found.append(s + _star(fp[s:e], block[s:e], bool(mark[2, s] != mark[3, s])))
        i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        root = _hubs(rows.num_rows, i, j)
        moved = np.flatnonzero(root != np.arange(rows.num_rows))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            yield from stars(pa.concat_batches([*rest, batch]), last=False)
    if rest and rest[0].num_rows:
        yield from stars(rest[0], last=True)


def links(classes: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of distinct fingerprints at distance 1 or 2: fingerprints that
    share a Golay key are compared, every one with every one.

    A bucket of up to BLOCK fingerprints is one block.  A larger one is cut further by Golay keys of the third segment; what
    is larger still is dealt to blocks by hash, and every two blocks are compared in a task of their own.  The sizes are
    written before they are joined, so that a bucket of very many fingerprints can be split.
    """
    keyed = classes.select("fp").mapInArrow(_keyed, "key long, fp long")
    sizes = keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    live = keep(keyed.join(sizes, "key"), "golay")
    fit = live.where(F.col("n") <= BLOCK).select("key", F.lit(-1).cast("long").alias("sub"), "fp", F.lit(1).alias("blocks"))
    crowded = live.where(F.col("n") > BLOCK)
    if not crowded.isEmpty():
        cut = crowded.select("key", "fp").mapInArrow(_cut, "key long, sub long, fp long")
        parts = keep(cut.groupBy("key", "sub").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cut-sizes")
        fit = fit.unionByName(cut.join(parts, ["key", "sub"]).select("key", "sub", "fp", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    dealt = fit.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sided = paired.select("key", "sub", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "fp")
    group = ["key", "sub", "a", "b"]
    return sided.repartition(*group).sortWithinPartitions(*group).mapInArrow(_verified, "u long, v long").distinct()


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and for each distinct fingerprint (class_fp) its root."""
    marked = keep(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(links(classes))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left")
    return marked, rooted.select(F.col("fp").alias("class_fp"), F.coalesce("root", "fp").alias("root"), "first_id")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (least doc_id whose fingerprint can be
    reached in steps of at most two differing bits).

    Null and wordless texts have fingerprint zero and are linked like any other; shorter texts than a shingle are one
    shingle; texts of any length are read whole; repeated rows get the same values; null ids never become a component_id
    unless a class has no other; an empty table gives an empty result; other columns are ignored.
    """
    marked, rooted = _rooted(docs, id_col, text_col)
    rooted = keep(rooted, "rooted")
    # each aggregate and class table is written before it is joined: a giant component, or a text of very many rows, can be split
    least = keep(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least-ids")
    named = keep(rooted.join(least, "root").select("class_fp", "component_id"), "named")
    joined = marked.join(named, F.col("fp") == F.col("class_fp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns, whatever their names: that of the least id or, where this id has
    several texts in the component, of the least hash of its text.  So rows with one id and unrelated texts, being in
    different components, stay both; of rows that are equal in id and text, one does.  Rows without an id stay as they are:
    no id can stand for them, and they stand for no other.  An empty table gives an empty result."""
    marked, rooted = _rooted(docs, id_col, text_col)
    roots = keep(rooted.select("class_fp", "root"), "rooted")
    members = marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    best = members.join(roots, F.col("fp") == F.col("class_fp")).groupBy("root").agg(F.min("first").alias("first"))
    of_id, of_text = unused(docs.columns, "kept_id"), unused(docs.columns, "kept_text")
    kept = keep(best.select(F.col("first.doc_id").alias(of_id), F.col("first.digest").alias(f"{of_text}_")), "kept")
    named = docs.withColumn(of_text, F.xxhash64(F.col(text_col).cast("binary")))
    same = (F.col(id_col).cast("long") == F.col(of_id)) & (F.col(of_text) == F.col(f"{of_text}_"))
    once = named.join(kept, same, "left_semi").dropDuplicates([id_col, of_text]).drop(of_text)
    return once.unionByName(docs.where(F.col(id_col).isNull()))
