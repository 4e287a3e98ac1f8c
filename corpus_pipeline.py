"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

All stages take whole texts of any length, carry all columns that they are given, whatever their names, treat repeated rows as
rows like any other unless they say so, and give an empty result for an empty table.  Bytes that are not UTF-8 are replaced for
the decision and stay as they are in the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import langid, mixing, packing, quality, simhash
from paperloom.llm.queries import byte_bpe
from paperloom.llm.shared import keep
from paperloom.llm.tables import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, trained on a bounded sample of them, rejects go; so do null texts and texts
    without a letter.  Null ids and null languages are never learned from, but are classified like any other."""
    return langid.keep_known(docs, langid.fit(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are probably bad by the weighed votes, go; so do null texts, as they have no
    words.  Ids, languages and sources play no part."""
    return quality.keep_good(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal fingerprints, the document with the least id stays, once, and of that id's texts the one
    of least hash.  Documents without an id all stay."""
    return simhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which their sources' blocks come; the part files are in that order.  Null sources are one
    source; documents of one source come by a hash of their ids, null ids first."""
    return mixing.in_mixed_order(mixing.mix(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of at most 2048 tokens, whose ids rise with the schedule of the mixture.  Readers deal
    part files to tasks by length, so the schedule, which depends on the documents alone, is made again.  A null text is the
    end token alone; ids are only carried along."""
    columns = ["doc_id", "source", "text"]
    return packing.pack(mixing.in_mixed_order(mixing.mix(docs.select(*columns)), columns), *byte_bpe())


STAGES = [("language", known_language), ("quality", good_quality), ("near copies", no_near_copies), ("mixing", mixed), ("packing", packed)]
#: The classifier, the expectation-maximisation and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = keep(docs, f"stage-{name.replace(' ', '-')}")
    return docs
