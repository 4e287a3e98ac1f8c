"""Token counts through a cache keyed by content digest and tokenizer digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shared import keep, map_texts, new_folder

#: Longer words are not remembered.
LONGEST = 64
CACHE_SCHEMA = "tokenizer_digest string, content_digest binary, n_tokens long"
#: Words that one Python worker remembers, in each of two generations: bounds its memory.
REMEMBERED = 300_000


@cache
def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def splits_at_spaces(path: str) -> bool:
    """Whether this tokenizer drops white space, so that a text's count is the sum of its words' counts: a .json whose
    normaliser is NFC, white space runs to one space and lower case, and whose pre-tokenizer keeps only pieces free of
    white space.  None of these looks across an ASCII space."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = (spec.get("normalizer") or {}).get("normalizers", [])
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        [p["type"] for p in parts] == ["NFC", "Replace", "Lowercase"]
        and parts[1].get("pattern") == {"Regex": r"\s+"}
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec.get("added_tokens", []))
    )


#: By tokenizer file: counts of words, the newer generation and the older one.
_words: dict[str, tuple[dict[bytes, int], dict[bytes, int]]] = {}


def count_tokens(texts: list[bytes], path: str, by_word: bool) -> list[int]:
    """The library's counts of UTF-8 texts, without special tokens added.  ``by_word``: see splits_at_spaces; each word
    goes to the library once while it is remembered."""
    tokenizer = load_tokenizer(path)
    if path.endswith(".model"):
        return [len(x) for x in tokenizer.encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)]
    if not by_word:
        return [len(x) for x in tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
    known, older = _words.get(path, ({}, {}))
    if len(known) > REMEMBERED:  # words that come often are in the older generation, and come over
        known, older = {}, known
    _words[path] = known, older
    split = [t.split() for t in texts]
    counts = [list(map(known.get, words)) for words in split]
    missed = {w for words, found in zip(split, counts) if None in found for w, n in zip(words, found) if n is None}
    new = {w: n for w in missed if (n := older.get(w)) is not None}
    fresh = [w for w in missed if w not in new]
    for at in range(0, len(fresh), 5000):
        some = fresh[at : at + 5000]
        new.update(zip(some, map(len, tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False))))
    known.update(x for x in new.items() if len(x[0]) <= LONGEST)
    return [sum(found) if None not in found else sum(new[w] if n is None else n for w, n in zip(words, found)) for words, found in zip(split, counts)]


def content_digest(text: Column, path: str) -> Column:
    """Digest of the normalised content.  Where the tokenizer folds ASCII case and drops ASCII white space, so does this,
    unless the text holds ``<|``, which may begin a special string that only its exact spelling makes special."""
    text = F.coalesce(text, F.lit(""))
    if not splits_at_spaces(path):
        return F.unhex(F.sha2(text.cast("binary"), 256))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # of ASCII texts the plain lower-casing is the same, and much cheaper
    plain = F.regexp_replace(F.lower(text), "[\\t\\n\\x0b\\f\\r]", " ")
    blanks = "\t\n\x0b\f\r"
    folded = F.when(F.octet_length(text) == F.char_length(text), plain).otherwise(F.translate(text, upper + blanks, lower + " " * len(blanks)))
    folded = F.trim(folded)
    exact = F.concat(F.lit("\x01"), text)
    return F.unhex(F.sha2(F.when(text.contains("<|"), exact).otherwise(folded).cast("binary"), 256))


def token_counts(docs: DataFrame, path: str, cache_dir: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``cache_dir`` holds Parquet rows of CACHE_SCHEMA from earlier runs; None starts an empty cache in the shared folder.
    Each content that the cache lacks is encoded once, however many rows have it, and appended.  A null text counts as
    empty; texts of any length are counted whole; bytes that are not UTF-8 are replaced; ids may be null or repeated; other
    columns are ignored, whatever their names; an empty table gives an empty result.  A cache that holds a content twice
    (two jobs appended at once) serves either row.
    """
    spark = docs.sparkSession
    version, by_word = tokenizer_digest(path), splits_at_spaces(path)
    cache_dir = cache_dir or new_folder(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digested = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), content_digest(F.col(text_col), path).alias("content_digest"))
    stored = _stored(spark, cache_dir).where(F.col("tokenizer_digest") == version)
    contents = digested.groupBy("content_digest").agg(F.first("text").cast("binary").alias("text"))
    misses = contents.join(stored, "content_digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts = count_tokens(part.column(1).to_pylist(), path, by_word)
                yield pa.RecordBatch.from_arrays([pa.array([version] * part.num_rows), part.column(0), pa.array(counts, pa.int64())], ["tokenizer_digest", "content_digest", "n_tokens"])

    map_texts(misses.select("content_digest", "text"), encode, CACHE_SCHEMA).write.mode("append").parquet(cache_dir)
    counts = _stored(spark, cache_dir).where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
    per_content = counts.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("rows"))
    if not per_content.where("rows > 1").isEmpty():  # two jobs appended at once: one row each from here on
        counts = keep(per_content.drop("rows"), "counts")
    # the cache joins as it stands: between plain exchanges, a content of very many rows can be split
    return digested.drop("text").join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored(spark: SparkSession, cache_dir: str) -> DataFrame:
    """The cache's rows; none where nothing has been written yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.sql("SELECT '' AS tokenizer_digest, X'' AS content_digest, 0L AS n_tokens WHERE false")
