import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import tokens

WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=120))
def test_words_sum_to_the_whole(text):
    whole = len(tokens.load_tokenizer(WORDS).encode(text, add_special_tokens=False))
    assert tokens.count_tokens([text.encode()], WORDS, True) == [whole]


def test_only_the_word_tokenizer_splits():
    assert tokens.splits_at_spaces(WORDS) and not tokens.splits_at_spaces(BYTES) and not tokens.splits_at_spaces(PIECES)


ROWS = [(1, "Hello  World"), (2, "hello world"), (3, None), (4, ""), (5, "a <|endoftext|> B"), (6, "a <|ENDOFTEXT|> b"), (None, "hello world"), (7, "İstanbul ΑΣ ας é́"), (8, "x " * 3000), (1, "Hello  World")]


@pytest.mark.parametrize("path", [WORDS, BYTES, PIECES])
def test_counts_and_cache(spark, tmp_path, path):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, n_tokens int")
    cache = f"file://{tmp_path}/cache"
    got = sorted(map(tuple, tokens.token_counts(df, path, cache).collect()), key=str)
    t = tokens.load_tokenizer(path)
    count = (lambda x: len(t.encode(x))) if path.endswith(".model") else (lambda x: len(t.encode(x, add_special_tokens=False)))
    want = sorted(((i, len((x or "").encode()), count(x or ""), count(x or "") > 2048) for i, x in ROWS), key=str)
    assert got == want
    stored = spark.read.parquet(cache)
    first = stored.count()
    assert first == stored.select("content_digest").distinct().count() < len(ROWS)
    again = tokens.token_counts(df.unionByName(spark.createDataFrame([(9, "new text", 1)], df.schema)), path, cache)
    assert again.count() == len(ROWS) + 1 and spark.read.parquet(cache).count() == first + 1
    assert tokens.token_counts(df.limit(0), path).count() == 0


def test_against_the_library_over_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    t = tokens.load_tokenizer(WORDS)
    want = {r.doc_id: len(t.encode(r.text, add_special_tokens=False)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, WORDS).collect()} == want


def test_memo_of_any_size_gives_the_same(spark, small, monkeypatch):
    texts = [r.text.encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = tokens.count_tokens(texts, WORDS, False)
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    monkeypatch.setattr(tokens, "_words", {})
    assert [n for at in range(0, len(texts), 9) for n in tokens.count_tokens(texts[at : at + 9], WORDS, True)] == want


def test_a_cache_that_another_job_appended_to(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    df = spark.createDataFrame([(1, "hello world"), (2, "HELLO\tworld ")], "doc_id long, text string").selectExpr("*", "1 AS n_bytes", "2 AS content_digest", "3 AS n_tokens", "4 AS `rows`")
    first = sorted(map(tuple, tokens.token_counts(df, WORDS, cache).collect()))
    rows = spark.read.parquet(cache).collect()
    spark.createDataFrame(rows, tokens.CACHE_SCHEMA).write.mode("append").parquet(cache)  # the same content once more
    spark.createDataFrame([("another tokenizer", rows[0].content_digest, 99)], tokens.CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert sorted(map(tuple, tokens.token_counts(df, WORDS, cache).collect())) == first == [(1, 11, 2, False), (2, 12, 2, False)]


def test_long_texts_and_bytes_that_are_not_text(spark):
    long = "many words in a row " * 400_000
    df = spark.createDataFrame([(1, long), (2, "x" * 400_000)], "doc_id long, text string").unionByName(spark.sql("SELECT 3L doc_id, CAST(X'61FF62' AS STRING) text"))
    got = {r.doc_id: r for r in tokens.token_counts(df, WORDS).collect()}
    t = tokens.load_tokenizer(WORDS)
    assert got[1].n_tokens == 2_000_000 and got[1].over_limit and got[1].n_bytes == len(long)
    assert got[2].n_tokens == len(t.encode("x" * 400_000, add_special_tokens=False)) and got[3].n_tokens == len(t.encode("a�b", add_special_tokens=False))


def test_digests_fold_case_and_blanks_alike_in_every_script(spark):
    texts = ["A\tb\nC", "a b c", " a\x0bB\fc\r", "É A\tb", "É a b ", "é a b", "a <|x", "A <|x", "İ", "i̇"]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tokens.content_digest(tokens.F.col("t"), WORDS).alias("d")).orderBy("i").collect()
    d = [bytes(r.d) for r in found]
    assert d[0] == d[1] == d[2] and d[3] == d[4] != d[5] and d[6] != d[7] and d[8] != d[9]
