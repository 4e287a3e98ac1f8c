from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from paperloom.llm import langid, mixing, packing, quality, simhash
from paperloom.llm.queries import byte_bpe, oracle_sql, queries
from paperloom.llm.shared import keep

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows, now = docs.collect(), docs
    expected = rows
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, now, D)
        if name == "language":
            model = langid.fit(now)
            expected = [r for r in expected if not model.predict(r.text)[2]]
        elif name == "quality":
            scored = {r.doc_id: r.kept for r in quality.quality(now).collect()}
            expected = [r for r in expected if scored[r.doc_id]]
        elif name == "near copies":
            fps = [(r, simhash.fingerprint(r.text.encode())) for r in expected]
            expected = [r for r, f in fps if not any((f ^ g).bit_count() <= 2 and o.doc_id < r.doc_id for o, g in fps)]
        assert got.columns == docs.columns
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in expected), name
        now = spark.createDataFrame(got.collect(), docs.schema)
    encoder = packing.load_encoder(*byte_bpe())
    packed = corpus_pipeline.packed(spark, now, D).collect()
    assert sum(r.length for r in packed) == sum(len(encoder(r.text)) // 4 + 1 for r in expected)


def test_run_gives_whole_documents(spark):
    got = corpus_pipeline.run(spark, D).collect()
    tokens = {}
    for r in got:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert all(tokens[r.doc_id] == r.doc_tokens for r in got)


def odd_documents(spark):
    """Documents with every oddity: nulls in each column, empty, very long and broken texts, repeats, and other columns whose
    names the operators use inside."""
    docs = spark.read.parquet(f"{D}/documents.parquet").where("length(text) > 300").limit(60)
    odd = spark.sql("""SELECT * FROM VALUES (CAST(NULL AS BIGINT), 'a text without any id at all', 'en', 'src0'), (900001L, NULL, 'en', 'src0'), (900002L, '', NULL, NULL),
      (900003L, ' \n\t ', 'de', ''), (900004L, '12 34 !? $$$', 'en', 'src1'), (900005L, 'x', 'xx', 'only here') AS t(doc_id, text, lang, source)""").withColumn("n_chars", F.length("text").cast("long"))
    long = docs.limit(1).select(F.lit(900006).cast("long").alias("doc_id"), F.repeat(F.concat("text", F.lit(" ")), 300).alias("text"), "lang", "source", F.lit(None).cast("long").alias("n_chars"))
    broken = docs.limit(1).select(F.lit(900007).cast("long").alias("doc_id"), F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF"))).cast("string").alias("text"), "lang", "source", "n_chars")
    whole = docs.unionByName(docs.limit(20)).unionByName(odd).unionByName(long).unionByName(broken)
    clashes = ("fp", "digest", "pattern", "base_failed", "kept_id", "__kept", "__rank", "__w", "mix", "tier", "vec", "a.b", "TEXT_2", "length")
    return whole.select("*", *[F.lit(f"own {c}").alias(c) for c in clashes])


def test_stages_take_every_oddity_and_empty_tables(spark):
    whole = odd_documents(spark)
    for rows in (whole, whole.limit(0), whole.where("text IS NULL")):
        now = rows
        for name, stage in corpus_pipeline.STAGES[:4]:
            got = stage(spark, now, D)
            assert got.columns == rows.columns, name
            got = keep(got, "odd")
            found = got.select("doc_id", "`a.b`", "__rank", "fp").collect()
            assert all(r["a.b"] == "own a.b" and r["__rank"] == "own __rank" and r.fp == "own fp" for r in found), name
            now = got
            if rows is whole:
                ids = [r.doc_id for r in found]
                assert ids and 900001 not in ids and 900002 not in ids and 900003 not in ids and 900004 not in ids
                if name in ("language", "quality"):
                    assert len(ids) > len(set(ids))  # repeated rows are rows like any other
                if name == "near copies":
                    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
            else:
                assert not found
        packed = corpus_pipeline.packed(spark, now, D).collect()
        assert bool(packed) == (rows is whole)


def test_sequences_follow_the_schedule(spark, tmp_path):
    n = 24_000
    text = F.concat(F.lit("word "), F.col("id").cast("string"), F.repeat(F.lit(" and more"), (F.col("id") % 90).cast("int")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 8 < 5, "big").when(F.col("id") % 8 < 7, "middle").otherwise("small").alias("source"))
    # many files of unlike lengths, which the reader does not take by name
    corpus_pipeline.mixed(spark, docs, D).repartitionByRange(12, "doc_id").write.parquet(str(tmp_path / "docs"))
    now = spark.read.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several tasks, whatever the size
    try:
        got = corpus_pipeline.packed(spark, now, D).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.sequence_id >> 36 for r in got}) > 1
    slot = {r.doc_id: r.mix_slot for r in mixing.mix(docs.select("doc_id", "source")).collect()}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    opener = {r.sequence_id: slot[r.doc_id] for r in got if r.offset == 0}
    in_order = [opener[s] for s in sorted(opener)]
    reach = 2 * packing.WAITING // 32 + 2  # slots of the rows that are packed together, and of those that wait from the time before
    high = 0
    for s in in_order:
        assert s >= high - reach
        high = max(high, s)
    # shares of documents, by the first sequence that holds each, until the first source ends
    counts = Counter(source.values())
    aims = mixing.exact_weights(counts)
    first = {}
    for r in got:
        first[r.doc_id] = min(first.get(r.doc_id, r.sequence_id), r.sequence_id)
    had, end = Counter(), min(counts[k] / aims[k] for k in counts)
    for t, d in enumerate(sorted(first, key=first.get), 1):
        had[source[d]] += 1
        if t <= end:
            assert all(abs(had[k] - t * aims[k]) < 0.04 * end for k in aims), (t, had)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    result = con.execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    want = sorted((tuple(r) for r in result.fetchall()), key=str)
    df = queries()[name](spark, D)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == want and want


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries() if n.startswith("op")) == list(range(1, 11)) and "pipeline" in queries()
