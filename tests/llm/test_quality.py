import re
from collections import Counter

import numpy as np

from paperloom.llm import quality as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


ODD = [None, "", " \t\n", "a", "a " * 9, "a b " * 40, "one two three four five six seven eight " * 2, "x\n\nx\ny z w\n x\nx", "#*$%&|<>" * 3, "é́ ß\x1cq " * 30]


def test_counts_against_brute_force(spark, small):
    texts = [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()] + ODD
    for t in texts:
        assert Q.measure(t)[0] == brute(t), t
    rng = np.random.default_rng(0)
    for _ in range(200):
        t = " ".join(rng.choice(["a", "b"], size=rng.integers(0, 60)))
        assert Q.measure(t)[0] == brute(t)


def test_em_finds_the_hidden_classes():
    rng = np.random.default_rng(5)
    n = 20_000
    good = rng.random(n) < 0.8
    votes = np.full((n, 5), Q.ABSTAIN)
    for r in range(5):
        cast = rng.random(n) < 0.8
        right = np.where(good, rng.random(n) < 0.98, rng.random(n) < 0.7)
        votes[cast, r] = np.where(good == right, Q.GOOD, Q.BAD)[cast]
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = Q.expectation_maximisation(patterns, counts)
    assert abs(model.prior - 0.8) < 0.03
    assert ((model.posterior(patterns)[inverse.ravel()] > 0.5) == good).mean() > 0.97


def test_labels_are_met(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.quality(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and not got[i].base_failed]
    assert all(got[i].kept for i in good)
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(not got[i].kept for i in bad) >= 0.95 * len(bad)
    for r in got.values():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_odd_rows(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(None, "x", 1), (1, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pattern int")
    got = Q.quality(df).collect()
    assert len(got) == len(rows) and not any(r.kept for r in got if r.doc_id == 0)
    assert Q.quality(df.limit(0)).count() == 0
    assert Q.keep_good(df).count() == sum(r.kept for r in got) and Q.keep_good(df.limit(0)).columns == df.columns


def brute_posteriors(rows):
    """Expectation-maximisation over documents one by one, in plain Python."""
    n, rules = len(rows), len(rows[0])
    faith = max(1.0, 1e-5 * n)
    good = [0.1 if Q.BAD in r else 0.98 for r in rows]
    for _ in range(100):
        prior = (sum(good) + 2 * faith) / (n + 3 * faith)
        said = []
        for k in range(rules):
            row = []
            for kind, pseudo in ((0, (0.5, 0.5)), (1, (0.01, 0.99))):
                share = [g if kind else 1 - g for g in good]
                cast = [sum(s for s, r in zip(share, rows) if r[k] == v) + faith * p for v, p in zip((Q.BAD, Q.GOOD), pseudo)]
                row.append([x / sum(cast) for x in cast])
            said.append(row)
        new = []
        for r in rows:
            a, b = 1 - prior, prior
            for k, v in enumerate(r):
                if v != Q.ABSTAIN:
                    a, b = a * said[k][0][v], b * said[k][1][v]
            new.append(b / (a + b))
        change = max(abs(x - y) for x, y in zip(new, good))
        good = new
        if change < 1e-9:
            break
    return good


def test_posterior_and_kept_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.collect()
    measured = [Q.measure(r.text) for r in rows]
    want = {r.doc_id: (p, p >= 0.5 and not Q.base_failed(c[0], c[4])) for r, p, (c, _) in zip(rows, brute_posteriors([v for _, v in measured]), measured)}
    got = {r.doc_id: (r.posterior, r.kept) for r in Q.quality(docs).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i][0] - want[i][0]) < 1e-6 and got[i][1] == want[i][1] for i in want)
    assert {r.doc_id for r in Q.keep_good(docs).collect()} == {i for i, (_, kept) in want.items() if kept}


def test_very_long_text_bytes_that_are_not_text_and_clashing_columns(spark):
    long = " ".join(f"word{i}" for i in range(400_000))
    assert Q.measure(long)[0] == (400_000, len(long) - 399_999, 0, 0, 0)
    assert Q.measure(f"{long} {long}")[0][4] == 800_000
    docs = spark.sql("SELECT 1L doc_id, CAST(concat(X'FF', cast(repeat('some fine words here ', 1) AS BINARY)) AS STRING) text, CAST(X'FE' AS STRING) AS pattern, 7 AS base_failed, 8 AS _pattern UNION ALL SELECT 2L, NULL, NULL, NULL, NULL")
    good = docs.selectExpr("doc_id", "CAST(concat(X'FF20', CAST(array_join(transform(sequence(1, 60), x -> concat('words', chr(97 + x % 26), 'ly', chr(97 + x % 7))), ' ') AS BINARY)) AS STRING) AS text", "pattern", "base_failed", "_pattern").where("pattern IS NOT NULL")
    kept = Q.keep_good(good.unionByName(docs))
    assert kept.columns == docs.columns and [(r.doc_id, r.base_failed) for r in kept.selectExpr("doc_id", "base_failed").collect()] == [(1, 7)]
    assert kept.selectExpr("hex(pattern)").first()[0] == "FE"
