"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from paperloom.llm.langid import decoded
from paperloom.llm.shared import keep, map_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = str.maketrans("", "", "#*$%&|<>")
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
GOOD, BAD, ABSTAIN = 1, 0, 2


def repeated_positions(words: list[str], width: int = 8) -> int:
    """Words inside a ``width``-word window that occurs twice or more in the text, the first one included.  Exact: windows
    are ranked by doubling, not hashed."""
    if len(words) <= width:
        return 0
    ids = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    if len(ids) == len(words):
        return 0
    size = 1
    while size < width:
        pairs = rank[:-size] * np.int64(len(words) + 1) + rank[size:]
        _, rank = np.unique(pairs, return_inverse=True)
        size *= 2
    hit = np.flatnonzero(np.bincount(rank)[rank] > 1)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, hit, 1)
    np.add.at(marks, hit + width, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The five counts of one whole text, and its rules' votes."""
    text = text or ""
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    symbols = len(text) - len(text.translate(SYMBOLS))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_positions(words)
    counts = (n, chars, symbols, dup, repeats)
    return counts, votes(text, words, lines, counts)


def _vote(good: bool, bad: bool) -> int:
    return GOOD if good else BAD if bad else ABSTAIN


RULES = ("length", "repeats", "symbols", "capitals", "exclamations", "variety", "word_length", "duplicate_lines", "cells", "letters")


def votes(text: str, words: list[str], lines: list[str], counts: tuple[int, ...]) -> tuple[int, ...]:
    """One vote per rule: good, bad or abstain.  Rules know no language."""
    n, chars, symbols, dup, repeats = counts
    m, c = max(n, 1), max(chars, 1)
    upper = sum(map(str.isupper, words)) / m
    shout = text.count("!") / m
    variety = len(set(words)) / m
    mean = chars / m
    cells = text.count("|") / m
    letters = sum(map(str.isalpha, text)) / c
    return (
        _vote(n >= 40, n < 20),
        _vote(100 * repeats <= 5 * n, 100 * repeats > 30 * n),
        _vote(symbols <= 0.01 * c, symbols > 0.1 * c),
        _vote(upper <= 0.05, upper > 0.3),
        _vote(shout <= 0.02, shout > 0.15),
        _vote(variety >= 0.3 or n < 40, variety < 0.05 and n >= 40),
        _vote(2.5 <= mean <= 9, mean < 2 or mean > 14),
        _vote(dup <= 0.1 * len(lines), dup > 0.3 * len(lines)),
        _vote(cells <= 0.02, cells > 0.25),
        _vote(letters >= 0.9, letters < 0.7),
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


@dataclass
class LabelModel:
    prior: float  # of good
    said: np.ndarray  # rules x (bad, good) x (votes bad, votes good): probabilities given that the rule votes

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(patterns), 1))
        for r in range(patterns.shape[1]):
            cast = patterns[:, r] != ABSTAIN
            log[cast] += np.log(self.said[r][:, patterns[cast, r]].T)
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(axis=1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Accuracies of the rules and the share of good documents from the distinct vote patterns and how many documents cast
    each; no labels.  It starts from: any bad vote probably means bad.  A pseudo-count says that rules rarely condemn a
    good document; it is a few documents' worth for each million, and at least one."""
    weight = counts.astype(np.float64)
    any_bad = (patterns == BAD).any(axis=1)
    good = np.where(any_bad, 0.1, 0.98)
    faith = max(1.0, 1e-5 * weight.sum())
    model = LabelModel(0.8, np.zeros((patterns.shape[1], 2, 2)))
    for _ in range(rounds):
        share = np.stack([1 - good, good], axis=1) * weight[:, None]
        prior = float((share[:, 1].sum() + 2 * faith) / (weight.sum() + 3 * faith))
        said = np.empty((patterns.shape[1], 2, 2))
        for r in range(patterns.shape[1]):
            for k in (0, 1):
                cast = np.array([share[patterns[:, r] == v, k].sum() for v in (BAD, GOOD)])
                cast += np.array([0.5, 0.5]) * faith if k == 0 else np.array([0.01, 0.99]) * faith
                said[r, k] = cast / cast.sum()
        model, before = LabelModel(prior, said), good
        good = model.posterior(patterns)
        if np.abs(good - before).max() < 1e-9:
            break
    return model


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the five counts, pattern): one narrow pass over whole texts; pattern is the votes as a base-3 number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(None if t is None else t.decode("utf-8", "replace")) for t in (x.as_py() for x in batch.column(1))]
            counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([_pattern(r[1]) for r in rows], pa.int64())], ["doc_id", *COLUMNS, "pattern"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_texts(narrow, run, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", pattern long")


def _pattern(cast: tuple[int, ...]) -> int:
    value = 0
    for v in cast:
        value = 3 * value + v
    return value


def _cast(pattern: int) -> list[int]:
    return [pattern // 3**k % 3 for k in reversed(range(len(RULES)))]


def fit(patterns: DataFrame) -> dict[int, float]:
    """Posterior of good for each pattern that occurs.  Only counts by pattern reach the driver: at most 3^10 of them."""
    found = patterns.groupBy("pattern").count().collect()
    if not found:
        return {}
    found.sort()
    cast, counts = np.array([_cast(r[0]) for r in found]), np.array([r[1] for r in found])
    return dict(zip([r[0] for r in found], expectation_maximisation(cast, counts).posterior(cast).tolist()))


def score(marked: DataFrame, least: float = 0.5) -> DataFrame:
    """``measured`` rows with base_failed, posterior and kept."""
    posterior = fit(marked)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    table = marked.sparkSession.createDataFrame([(k, v) for k, v in posterior.items()] or [(-1, 0.0)], "pattern long, posterior double")
    joined = marked.join(F.broadcast(table), "pattern", "left")
    return joined.select("doc_id", *COLUMNS, failed.alias("base_failed"), (~failed & (F.col("posterior") >= least)).alias("kept"), "posterior")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    posterior.  A null text has no words, so it fails; texts of any length are measured whole; bytes that are not UTF-8 are
    replaced; ids may be null or repeated; other columns are ignored; an empty table gives an empty result.  Statistics come from all rows; the marks are written to the shared folder once."""
    return score(keep(measured(docs, id_col, text_col), "marks"), least)


def keep_good(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all columns, whatever their names.  One pass measures the texts and
    writes each row with its votes and whether it fails the base rule; the posterior of each pattern of votes then filters
    them.  Rows with a null text go, as they have no words; repeated rows share their fate; bytes that are not UTF-8 are
    replaced for the rules and stay in the rows; an empty table gives an empty result."""
    at, names = docs.columns.index(text_col), [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in decoded(batch.column(at))]
            marks = [pa.array([_pattern(cast) for _, cast in rows], pa.int64()), pa.array([base_failed(c[0], c[4]) for c, _ in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks], [*names, "pattern", "base_failed"])

    marked = StructType([*plain.schema.fields, StructField("pattern", LongType()), StructField("base_failed", BooleanType())])
    rows = keep(map_texts(plain, run, marked), "measured")
    good = [(p,) for p, value in fit(rows.select("pattern")).items() if value >= least]
    table = docs.sparkSession.createDataFrame(good or [(-1,)], "pattern long")
    return rows.where("NOT base_failed").join(F.broadcast(table), "pattern", "left_semi").select(*names).toDF(*docs.columns)
