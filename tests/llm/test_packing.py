import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import packing

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(PATH)


def plainly(text):
    """The ids of a whole text, as the library gives them."""
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.fixture(scope="module")
def encoder():
    return plainly


AWKWARD = ["", " ", "a  b\n\n c\t d ", "it's we'll I'D 12345 x², ½", "Straße çà ÉTÉ e\u0301", "<|endoftext|> <|endoftext|>x <|end", "\u3000深度 学习\u200b🙂🏽", "\x00\x1c\x85\xa0z \x1c \x85 z", " 's 't", "a \u180e b \u200b c"]
PARTS = st.sampled_from(["a", " ", "  ", "\n", " 's", "<|endoftext|>", "\x1c", "\x85", "\u3000", "\u180e", "é", "深", "12", "!?", "\ufeff", "\u2028"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.lists(PARTS, max_size=40).map("".join)))
def test_both_libraries_give_the_same_ids(text):
    e = packing.load_encoder(PATH, RANKS)
    assert e.fast is not None and e(text) == plainly(text)


def test_same_ids_over_all_documents(spark, small):
    e = packing.load_encoder(PATH, RANKS)
    for t in AWKWARD + [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]:
        assert e(t) == plainly(t)


def test_very_long_white_space_and_words(spark):
    rows = [(1, " " * 1_500_000), (2, "x" * 300_000), (3, "\n \n" * 200_000), (4, "no end " * 300_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, RANKS).collect()
    holds(got, {i: plainly(t) + b"\1\0\0\0" for i, t in rows})


def holds(rows, docs):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, ids in docs.items():
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    used = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0 and at == rs[0].tier  # full windows, sizes powers of two
        used += at
    return used


def test_pieces(spark, small, encoder):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = packing.pack(docs.repartition(3, "doc_id"), PATH, RANKS).collect()
    texts = {r.doc_id: encoder(r.text) + b"\1\0\0\0" for r in docs.collect()}
    assert holds(got, texts) == sum(len(x) for x in texts.values()) // 4
    small_windows = [r for r in got if r.tier < 256]
    assert len({r.sequence_id for r in small_windows}) <= 3 * 8
    steps = defaultdict(set)
    for r in got:
        steps[r.step_group].add(r.tier)
    assert all(len(t) == 1 for t in steps.values())


def test_odd_rows(spark, encoder):
    rows = [(1, None, 1), (2, "", 1), (3, "a <|endoftext|> b", 1), (4, "word " * 30_000, 1), (5, "x" * 5000, 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length int"), PATH, RANKS).collect()
    holds(got, {i: encoder(t or "") + b"\1\0\0\0" for i, t, _ in rows})
    twice = packing.pack(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string"), PATH, RANKS).collect()
    assert sum(r.length for r in twice) == 4
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH, RANKS).count() == 0


def test_without_ranks(spark):
    got = packing.pack(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"), PATH).collect()
    assert sum(r.length for r in got) == 3


def test_bytes_that_are_not_text(spark):
    df = spark.sql("SELECT 1L doc_id, CAST(X'61FF62' AS STRING) text, 'x' AS tier")
    holds(packing.pack(df, PATH, RANKS).collect(), {1: plainly("a\ufffdb") + b"\1\0\0\0"})
