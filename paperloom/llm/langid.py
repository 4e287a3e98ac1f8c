"""Language identification: averaged hashed subword embeddings under a linear softmax, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import keep, map_texts

#: Everything in ASCII but letters becomes a space, so that subwords are of letters and word ends.
SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
UNKNOWN = "und"
#: Characters of a text that are taken at a time: bounds a task's memory.  A longer text is cut at spaces, or where it has none.
AT_A_TIME = 1 << 20
#: Pieces that the training has seen are marked in a table of this many bits' length: so many that foreign ones rarely meet them.
FAMILIAR_BITS = 20


def spelled(text: str) -> Iterator[np.ndarray]:
    """The lower-cased text's letters in UTF-8, a space for what is between words and at both ends, part by part."""
    at = 0
    while at < max(1, len(text)):
        end = at + AT_A_TIME
        if end < len(text):
            end = text.rfind(" ", at + 1, end) + 1 or end
        part = text[at:end].lower().encode("utf-8", "replace").translate(SPACED)
        yield np.frombuffer(b" " + b" ".join(part.split()) + b" ", dtype=np.uint8).astype(np.uint32)
        at = end


def _hashed(b: np.ndarray) -> list[np.ndarray]:
    """32-bit hashes of all 2-, 3- and 4-byte pieces."""
    pairs = b[:-1] | b[1:] << 8
    threes = pairs[:-1] | b[2:] << 16
    fours = threes[:-1] | b[3:] << 24
    return [pairs * np.uint32(0x9E3779B1), threes * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F), fours * np.uint32(0xC2B2AE3D) + np.uint32(0x165667B1)]


def _subwords(b: np.ndarray, bits: int) -> np.ndarray:
    return np.concatenate(_hashed(b)) >> np.uint32(32 - bits)


def _familiar(b: np.ndarray) -> np.ndarray:
    return _hashed(b)[2] >> np.uint32(32 - FAMILIAR_BITS)


def subwords(text: str, bits: int = 15) -> np.ndarray:
    """Hashed buckets of all 2-, 3- and 4-byte pieces of the whole lower-cased text, word ends included."""
    return np.concatenate([_subwords(b, bits) for b in spelled(text)])


def familiar_pieces(text: str) -> np.ndarray:
    """Hashes, of FAMILIAR_BITS bits, of all 4-byte pieces of the text as ``subwords`` sees it."""
    return np.concatenate([_familiar(b) for b in spelled(text)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # a row a bucket: each subword's embedding or, where that is shorter, times the softmax layer
    layer: np.ndarray | None  # softmax layer that is still to be applied
    bias: np.ndarray
    temperature: float
    least_score: float  # predictions below it are rejected
    bits: int
    familiar: np.ndarray | None = None  # 4-byte pieces that the training has seen
    least_familiar: float = 0.0  # texts with a smaller share of such pieces are rejected

    def familiarity(self, text: str) -> float:
        """Share of the text's pieces that the training has seen: the softmax must choose a language, this need not."""
        return self.read(text)[1]

    def logits(self, text: str) -> np.ndarray:
        return self.read(text)[0]

    def read(self, text: str) -> tuple[np.ndarray, float]:
        """Both, in one walk over the text."""
        total, n, seen, fours = np.zeros(self.table.shape[1]), 0, 0, 0
        for b in spelled(text):
            hashes = _hashed(b)
            if self.familiar is not None:
                seen += int(np.count_nonzero(self.familiar[hashes[2] >> np.uint32(32 - FAMILIAR_BITS)]))
                fours += len(hashes[2])
            found = np.concatenate(hashes) >> np.uint32(32 - self.bits)
            n += len(found)
            # each row as often as it occurs: cheaper than a row for each piece
            if len(found) > len(self.table):
                total += np.bincount(found, minlength=len(self.table)) @ self.table.astype(np.float64)
            else:
                total += self.table[found].sum(axis=0, dtype=np.float64)
        mean = total / max(1, n)
        return (mean if self.layer is None else mean @ self.layer) + self.bias, seen / fours if fours else 1.0

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected).  Of equally probable languages, the first by name.  No text or no
        letter: ('und', 0, True)."""
        if not text or not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0, True
        logits, familiarity = self.read(text)
        p = softmax(logits[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best])), bool(p[best] < self.least_score or familiarity < self.least_familiar)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def least(values: np.ndarray, lost: float) -> float:
    """The value that a share ``lost`` of such values falls short of.  Where fewer than ten do, the lowest tenth gives it by
    an exponential tail in log-odds, or the lowest value if that is less: a few values say little about a rare one."""
    x = np.sort(np.clip(values, 1e-9, 1 - 1e-9))
    if lost * len(x) >= 10:
        return float(x[int(lost * len(x))])
    odds = np.log(x / (1 - x))
    n = max(1, len(x) // 10)
    start = odds[min(n, len(x) - 1)]
    cut = start - (start - odds[:n]).mean() * np.log(max(1.0, n / len(x) / lost))
    return min(float(1 / (1 + np.exp(-cut))), float(x[0])) - 1e-9  # rounding rejects nothing


def best_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross entropy.  As in Platt's scaling, of n + 2 rows one counts as wrong, so that there is a
    minimum even where all are right.  The grid is widened while the minimum is at its edge; it stays there only if the
    logits say nothing, or the opposite of what they should, and then any great temperature is as good."""
    n, k = z.shape
    if k == 1 or np.ptp(z, axis=1).max() == 0:
        return 1.0
    aim = np.full((n, k), 1 / (n + 2) / (k - 1))
    aim[np.arange(n), y] = 1 - 1 / (n + 2)
    for reach in (12, 24, 48):
        grid = np.exp(np.linspace(-reach, reach, 40 * reach + 1))
        at = int(np.argmin([-(aim * np.log(softmax(z / t) + 1e-300)).sum() for t in grid]))
        if 0 < at < len(grid) - 1:
            break
    return float(grid[at])


def train(texts: list[str], langs: list[str], dim: int = 16, bits: int = 15, epochs: int = 6, rate: float = 0.5, seed: int = 0, lost: float = 0.001) -> LanguageModel:
    """Stochastic gradient descent over single documents; a fifth of them, held back, sets the temperature, and the score and
    the share of familiar pieces under which predictions are rejected: those which ``lost`` of the right predictions fall
    short of."""
    languages = sorted(set(langs))
    if not languages:
        return LanguageModel([], np.zeros((1 << bits, 0), np.float32), None, np.zeros(0), 1.0, 0.0, bits)
    rng, n = np.random.default_rng(seed), len(languages)
    rows = [np.unique(subwords(t, bits), return_counts=True) for t in texts]
    rows = [(ids, (c / c.sum()).astype(np.float32)) for ids, c in rows]
    y = np.array([languages.index(x) for x in langs])
    embed = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, n), np.float32), np.zeros(n, np.float32)
    order = rng.permutation(len(rows))
    held, learn = order[: len(order) // 5], order[len(order) // 5 :]
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for i in rng.permutation(learn):
            ids, share = rows[i]
            mean = share @ embed[ids]
            p = softmax((mean @ layer + bias)[None, :])[0].astype(np.float32)
            p[y[i]] -= 1
            back = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= step * p
            # each subword's gradient is its share, which is tiny; scaled to the document's subwords as one step
            embed[ids] -= (step * 100) * np.outer(share, back)
    table, left = ((embed @ layer).astype(np.float32), None) if n <= dim else (embed, layer)
    model = LanguageModel(languages, table, left, bias, 1.0, 0.0, bits)
    check = held if len(held) else order
    z = np.array([share @ table[ids] for ids, share in (rows[i] for i in check)], dtype=np.float64)
    z = (z if left is None else z @ left) + bias
    model.temperature = best_temperature(z, y[check])
    model.familiar = np.zeros(1 << FAMILIAR_BITS, bool)
    for i in learn:
        model.familiar[familiar_pieces(texts[i])] = True
    p = softmax(z / model.temperature)
    right = p.argmax(axis=1) == y[check]
    if right.any():
        model.least_score = least(p.max(axis=1)[right], lost)
        shares = [model.familiarity(texts[i]) for i in check[right] if has_letter(texts[i])]
        model.least_familiar = least(np.array(shares), lost) if shares else 0.0
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str, most_rows: int = 1_000_000) -> tuple[list[str], list[str]]:
    """Of each language's labelled documents outside the held-out fold, the ``per_language`` of least hash, equal rows once;
    fewer, but of every language, if that would be over ``most_rows`` together.  Only these reach the driver."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = usable.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    sizes = keep(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    n = sizes.count()
    if n > most_rows:
        raise ValueError(f"{n} languages: a row of each is over {most_rows} rows")
    each = min(per_language, most_rows // max(1, n))
    place = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = usable.withColumn("h", F.xxhash64("id", "text", F.lit("language sample"))).join(sizes, "lang").where(place * F.col("n") < 2 * each)
    once = few.groupBy("lang", "h").agg(F.min("text").alias("text"))
    first = once.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(place, "h"))).where(F.col("at") <= each)
    found = sorted((r[0], r[1], bytes(r[2])) for r in first.select("lang", "h", "text").collect())
    return [r[2].decode("utf-8", "replace") for r in found], [r[0] for r in found]


def fit(docs: DataFrame, per_language: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 1_000_000) -> LanguageModel:
    """Train on a bounded sample of labelled rows; ``per_language`` and ``most_rows`` are the bounds.  Any number of languages
    up to ``most_rows`` can be learned and predicted."""
    return train(*sample(docs, per_language, id_col, text_col, lang_col, most_rows))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected.

    The whole text is read, a very long one part by part; bytes that are not UTF-8 are replaced.  A null text, or one without
    a letter, is ``und`` with score 0 and rejected; any other gets a learned language, and is rejected if its score or its
    share of pieces seen in training is under the calibrated least.  Of equally probable languages, the first by name is
    chosen.  Ids may be null (not held out) or repeated; other columns are ignored; an empty table gives an empty result;
    without any labelled row all are ``und``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(None if t is None else t.decode("utf-8", "replace")) for t in (x.as_py() for x in batch.column(2))]
            lang, score, gone = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gone, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return map_texts(narrow, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known: all columns, whatever their names, in one narrow pass.  Rows whose text
    is null, or has no letter, go; repeated rows share their fate; an empty table gives an empty result."""
    return filter_texts(docs, lambda t: not model.predict(t)[2], text_col)


def filter_texts(docs: DataFrame, wanted, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` for whose text (str or None) ``wanted`` holds.  Bytes that are not UTF-8 are replaced for
    ``wanted``, and stay as they are in the rows."""

    at, plain = docs.columns.index(text_col), docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(wanted(t)) for t in decoded(batch.column(at))], pa.bool_()))

    return map_texts(plain, run, plain.schema).toDF(*docs.columns)


def decoded(texts: pa.Array) -> Iterator[str | None]:
    """The texts of a string or binary column, one at a time."""
    for t in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()):
        raw = t.as_py()
        yield None if raw is None else raw.decode("utf-8", "replace")
