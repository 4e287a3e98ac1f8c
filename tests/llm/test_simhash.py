import re

import numpy as np
import pytest
import xxhash

from paperloom.llm import golay, simhash
from paperloom.llm.components import components


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(fps):
    out = {f: f for f in fps}
    change = True
    while change:
        change = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2 and out[a] != out[b]:
                    out[a] = out[b] = min(out[a], out[b])
                    change = True
    return out


def test_golay_is_perfect_and_keys_meet():
    table, count = golay.patterns()
    assert sorted(np.unique(count)) == [1, 6] and (count == 1).sum() == 1 + 23 + 253
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 300)
    keys, used = golay.fuzzy_keys(words)
    for bits in [(i, j) for i in range(23) for j in range(i, 23)]:
        other, used2 = golay.fuzzy_keys(words ^ ((1 << bits[0]) | (1 << bits[1])))
        for k in range(0, 300, 23):
            assert set(keys[k][used[k]]) & set(other[k][used2[k]])


@pytest.mark.parametrize("text", [None, "", "  \n", "A", "a b", "A b\tC", "É é Z z \x1c q", "one two three four " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("block", [16, 70, 1024])
def test_links_against_all_pairs(spark, monkeypatch, block):
    rng = np.random.default_rng(2)
    fps = set()
    for _ in range(120):
        base = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        fps.add(base)
        for _ in range(rng.integers(0, 6)):
            for _ in range(rng.integers(1, 4)):
                base ^= 1 << int(rng.integers(0, 64))
            fps.add(base)
    hot = int(rng.integers(0, 1 << 63))
    fps |= {hot ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(0, 64, 5)}
    monkeypatch.setattr(simhash, "BLOCK", block)  # the hot fingerprints fill many buckets beyond one block
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df)).collect()}
    want = brute_roots(fps)
    groups, found = {}, {}
    for f, s in zip(fps, signed):
        groups.setdefault(want[f], set()).add(s)
        found.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in simhash.simhash_classes(docs).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    assert all(got[i].fingerprint == f"{f:016x}" for i, f in fps.items())
    roots = brute_roots(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert all(got[i].component_id == least[roots[f]] for i, f in fps.items())
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_odd_rows(spark):
    rows = [(3, None, 0), (1, "", 0), (2, " \n", 0), (5, "a b c d", 0), (5, "a b c d", 0), (4, "A  b\nC d", 0), (None, "a b c d", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_classes(df).collect()), key=str)
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (None, 4)]
    assert sorted((r.doc_id for r in simhash.drop_near_copies(df).collect()), key=str) == [1, 4, None]
    assert simhash.simhash_classes(df.limit(0)).count() == 0 and simhash.drop_near_copies(df.limit(0)).count() == 0


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (103, 101), (101, 102), (102, 103), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got.get(i, i) for i in range(41)} == {0} and {got.get(i, i) for i in (101, 102, 103)} == {101} and 100 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_id_with_several_texts(spark):
    rows = [(1, "a b c d e f", "x"), (1, "totally other words stand here", "y"), (1, "a b c d e f", "x"), (2, "a b c d e f", "z"), (3, "totally other words stand here", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id string").selectExpr("*", "1 AS kept_text", "2 AS fp", "3 AS digest", "4 AS __kept")
    got = simhash.drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a b c d e f"), (1, "totally other words stand here")]


def test_very_long_text_and_bytes_that_are_not_text(spark):
    long = "some words that go on " * 300_000
    df = spark.createDataFrame([(1, long), (2, long), (3, "x" * 3_000_000)], "doc_id long, text string").unionByName(spark.sql("SELECT 4L doc_id, CAST(X'61FF' AS STRING) text"))
    got = {r.doc_id: r for r in simhash.simhash_classes(df).collect()}
    assert got[1].fingerprint == f"{brute_fingerprint(long):016x}" and got[2].component_id == 1 and got[4].component_id == 4
    assert sorted(r.doc_id for r in simhash.drop_near_copies(df).select("doc_id").collect()) == [1, 3, 4]


def test_a_hot_bucket_is_compared_in_blocks(spark, monkeypatch):
    """A third of all fingerprints in one neighbourhood: no block pair is larger than two blocks."""
    rng = np.random.default_rng(8)
    hot = {int(x) for x in rng.integers(0, 1 << 12, 3000)}
    fps = sorted(hot | {int(x) for x in rng.integers(1 << 40, 1 << 62, 2 * len(hot))})
    want = brute_link_roots(fps)
    monkeypatch.setattr(simhash, "BLOCK", 128)
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    assert {f: got.get(f, f) for f in fps} == want


def brute_link_roots(fps):
    x = np.array(fps, dtype=np.uint64)
    root = np.array(fps)
    near = [np.flatnonzero(np.bitwise_count(x ^ f) <= 2) for f in x]
    while True:
        new = np.array([root[n].min() for n in near])
        if (new == root).all():
            return dict(zip(fps, map(int, root)))
        root = new
