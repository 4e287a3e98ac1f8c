from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from paperloom.llm import mixing


@pytest.mark.parametrize("weights", [[1], [1, 1], [3, 2, 1], [50, 30, 19, 1], [7, 7, 7, 1, 1, 1, 40], list(range(1, 25))])
def test_less_than_one_block_at_every_slot(spark, weights):
    got, total = mixing.period(spark, weights), sum(weights)
    assert Counter(got) == dict(enumerate(weights))
    had = Counter()
    for t, s in enumerate(got, 1):
        had[s] += 1
        assert all(abs(had[i] * total - t * w) < total for i, w in enumerate(weights))


def test_schedule_places_every_block_once(spark):
    blocks, weights = [40, 3, 11, 0, 1], [5, 3, 2, 4, 1]
    rows = mixing.schedule(spark, blocks, weights)
    slots = Counter()
    for i, first, n, w, total, at, places in rows:
        for q in range(n):
            slots[at + q // w * total + places[q % w]] += 1
    assert set(slots.values()) == {1} and sorted(slots) == list(range(sum(blocks)))


def test_mixture(spark):
    rows = [(i, "big" if i % 3 else None, f"t{i}", i) for i in range(900)] + [(900 + i, "small", "t", 0) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_rank int")
    got = mixing.mix(df, {"big": 2, "small": 1}, block=10).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert len({(r.mix_slot, r.mix_place) for r in got}) == len(rows)
    by_slot = {}
    for r in got:
        assert by_slot.setdefault(r.mix_slot, r.source) == r.source
    assert sorted(by_slot) == list(range(60 + 30 + 5))
    counts = {"big": 600, None: 300, "small": 50}
    aims = mixing.target_weights(counts, 0.5) | {"big": 667, "small": 333}
    had, total = Counter(), sum(aims.values())
    for t in range(by_slot and max(t for t, s in by_slot.items() if s == "small") + 1):
        had[by_slot[t]] += 1
        assert all(abs(had[k] - (t + 1) * aims[k] / total) < 1 for k in aims)
    ordered = mixing.in_mixed_order(mixing.mix(df, block=10), df.columns)
    assert ordered.columns == df.columns and ordered.count() == len(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None), (1, "a", "x"), (1, "a", "x"), (2, "", None)], "doc_id long, source string, text string")
    assert mixing.mix(df).count() == 4
    assert mixing.mix(df.limit(0)).count() == 0
    clash = mixing.mix(mixing.mix(df).withColumn("mix_slot", F.lit("clash")))
    assert clash.columns == mixing.mix(df).columns and clash.count() == 4


def worst(blocks, weights):
    """Greatest deviation from the unrounded shares until the first source ends, in exact arithmetic."""
    whole, had, most = sum(map(Fraction, weights)), [0] * len(blocks), 0.0
    shares = [Fraction(w) / whole for w in weights]
    first_end = min(n / s for n, s in zip(blocks, shares))
    for t, i in enumerate(mixing.slots(blocks, weights), 1):
        had[i] += 1
        if t <= first_end:
            most = max(most, *(abs(float(h - t * s)) for h, s in zip(had, shares)))
    assert had == blocks
    return most


def test_exact_weights_however_long():
    sizes = [20_000, *[int(40_000 / 19 * (0.5 + i / 18)) for i in range(19)]]
    aims = mixing.exact_weights(dict(enumerate(sizes)))
    assert worst(sizes, list(aims.values())) < 1
    thirds = mixing.exact_weights({"a": 10**9, "b": 10**9}, given={"a": 1, "b": 2})
    assert worst([10_000, 30_000], list(thirds.values())) < 1
    zipf = mixing.exact_weights({i: 10**6 // (i + 1) for i in range(3000)})
    assert abs(zipf[0] / sum(zipf.values()) - 0.0093) < 0.0001  # 0.0029 with integer weights of at least one


def test_shares_hold_when_many_sources_have_run_out():
    blocks, weights = list(range(1, 120)), [1.0 + i % 5 for i in range(119)]
    had = [0] * len(blocks)
    v, at = 0.0, 0
    for i in mixing.slots(blocks, weights):
        had[i] += 1
        at += 1
        lo, hi = v, v + max(blocks)  # the virtual time at which the ideal mixture fills so many slots
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(n, w * mid) for n, w in zip(blocks, weights)) < at else (lo, mid)
        v = lo
        assert all(abs(h - min(n, w * v)) < 1 + 1e-6 for h, n, w in zip(had, blocks, weights))
    assert had == blocks


def test_long_schedules_are_written_in_runs(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 4 = 0, NULL, id % 3) AS source")
    want = sorted(mixing.mix(df, block=2).collect(), key=str)
    monkeypatch.setattr(mixing, "MOST_SLOTS", 400)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 100)
    got = mixing.mix(df, block=2).collect()
    assert len({(r.mix_slot, r.mix_place) for r in got}) == 3000
    assert sorted({r.mix_slot for r in got}) == list(range(len({r.mix_slot for r in want})))
    first = {r.mix_slot: r.source for r in got}
    assert first == {r.mix_slot: r.source for r in want}


def brute_slots(blocks, weights):
    """Earliest deadline first over windows of the ideal mixture, all in exact fractions, looking at every source each slot."""
    weights = [Fraction(w) for w in weights]
    ends = sorted({n / w for n, w in zip(blocks, weights) if n})

    def when(i, had):
        v, t, last = Fraction(had) / weights[i], Fraction(0), Fraction(0)
        for end in ends:
            rate = sum(w for n, w in zip(blocks, weights) if n and n / w >= end)
            t += (min(v, end) - last) * rate
            last = min(v, end)
            if last == v:
                return t
        return t

    done, out = [0] * len(blocks), []
    for t in range(sum(blocks)):
        left = [i for i in range(len(blocks)) if done[i] < blocks[i]]
        open_ = [i for i in left if when(i, done[i]).__floor__() <= t]
        best = min(open_, key=lambda i: (when(i, done[i] + 1).__ceil__(), i))
        out.append(best)
        done[best] += 1
    return out


@pytest.mark.parametrize("seed", range(8))
def test_schedule_against_brute_force(seed):
    import random

    rnd = random.Random(seed)
    n = rnd.randint(1, 7)
    blocks, weights = [rnd.randint(0, 12) for _ in range(n)], [rnd.choice([1, 2, 3, 5, 0.5, 0.25]) for _ in range(n)]  # exact as doubles
    assert list(mixing.slots(blocks, weights)) == brute_slots(blocks, weights)


def test_order_against_brute_force(spark):
    rows = [(i % 400, ["a", "b", None, "c"][i % 7 % 4], i) for i in range(450)]  # some ids twice
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    # buckets by one hash of the id, order in a bucket by another
    place = {r[0]: (r[1], r[2]) for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(256)), F.xxhash64("doc_id", F.lit("mix"))).distinct().collect()}
    names = [None, "a", "b", "c"]
    of = {s: sorted((place[i], i) for i, x, _ in rows if x == s) for s in names}
    blocks = [-(-len(of[s]) // 8) for s in names]
    weights = mixing.exact_weights({s: len(of[s]) for s in names})
    want, done = [], Counter()
    for slot, k in enumerate(brute_slots(blocks, [weights[s] for s in names])):
        at = done[k] * 8
        want += [(i, names[k], done[k], slot, p) for p, (_, i) in enumerate(of[names[k]][at : at + 8])]
        done[k] += 1
    got = mixing.mix(df, block=8).collect()
    assert sorted(((r.doc_id, r.source, r.mix_block, r.mix_slot, r.mix_place) for r in got), key=str) == sorted(want, key=str)


def test_any_number_of_sources_and_clashing_columns(spark):
    df = spark.range(9000).selectExpr("id AS doc_id", "concat('host', id % 6000) AS source", "id AS __rank", "id + 1 AS __source", "id + 2 AS __block", "id + 3 AS `__w`", "id + 4 AS __rank_bucket", "id + 5 AS `a.b`", "id + 6 AS count")
    got = mixing.mix(df)
    assert got.columns == [*df.columns, "mix_block", "mix_slot", "mix_place"]
    rows = got.collect()
    assert len(rows) == 9000 and all(r["__rank"] == r.doc_id and r["__source"] == r.doc_id + 1 and r["a.b"] == r.doc_id + 5 for r in rows)
    assert sorted({r.mix_slot for r in rows}) == list(range(6000))
    with pytest.raises(ValueError):
        mixing.mix(df, most_sources=100)
