"""Full-text search: postings, a boolean query of phrases, BM25 with column weights, snippets."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.scalars import CJK, CJK_PUNCTUATION, cjk_spaced
from paperloom.functions.textudf import search_tokens, search_tokens_col

#: The weights that really act, by column; those not named count once.
WEIGHTS = {"title": 3.0, "translated": 2.0}
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class TextQuery:
    """Phrases by number, and groups of phrase numbers: any group whose phrases all occur matches."""

    phrases: tuple[tuple[str, ...], ...]
    groups: tuple[tuple[int, ...], ...]

    @property
    def terms(self) -> list[str]:
        return sorted({t for p in self.phrases for t in p})


def rewritten(text: str) -> list[str]:
    """The user's words as quoted phrases and the operators AND and OR.  Runs of CJK become phrases of their characters;
    Latin runs keep letters, digits and ``. _ + -``.  Operators that dangle at either end, or repeat, are dropped."""
    cleaned = re.sub(f"[{CJK_PUNCTUATION}]+", " ", text or "")
    out: list[str] = []
    for word in cleaned.split():
        if word.upper() in ("AND", "OR"):
            if out and out[-1] not in ("AND", "OR"):
                out.append(word.upper())
            continue
        for run in re.findall(f"[{CJK}]+|[^{CJK}]+", word):
            if re.match(f"[{CJK}]", run):
                out.append('"' + " ".join(run) + '"')
            elif plain := " ".join(re.findall(r"[0-9A-Za-z._+-]+", _folded(run))):
                out.append('"' + plain.replace(" ", "") + '"')
    while out and out[-1] in ("AND", "OR"):
        out.pop()
    return out


def _folded(text: str) -> str:
    import unicodedata

    return "".join(ch for ch in unicodedata.normalize("NFD", text) if not unicodedata.combining(ch)).lower()


def parse(text: str) -> TextQuery:
    """Adjacent phrases are joined by AND, which binds tighter than OR."""
    phrases: list[tuple[str, ...]] = []
    groups: list[list[int]] = [[]]
    for item in rewritten(text):
        if item == "OR":
            groups.append([])
        elif item != "AND" and (tokens := tuple(search_tokens(item))):
            if tokens not in phrases:
                phrases.append(tokens)
            groups[-1].append(phrases.index(tokens))
    return TextQuery(tuple(phrases), tuple(tuple(g) for g in groups if g))


def tokenised(df: DataFrame, key: str, columns: dict[str, Column], native: bool = False) -> DataFrame:
    """(key, fields: array of col and tokens): a row per document, the texts read once.  ``native`` splits with built-in
    functions, for text whose letters carry no combining marks to fold; otherwise an Arrow function folds diacritics."""
    tokens = (lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) if native else search_tokens_col
    # most texts have nothing to space: looking costs less than replacing
    spaced = lambda c: F.when(c.rlike(f"[{CJK}]"), cjk_spaced(c)).otherwise(c)
    cols = [F.struct(F.lit(name).alias("col"), tokens(spaced(F.coalesce(c, F.lit("")))).alias("tokens")) for name, c in columns.items()]
    return df.select(F.col(key), F.array(*cols).alias("fields"))


def listed(found: DataFrame, key: str, terms: Sequence[str] | None = None) -> DataFrame:
    """(key, col, pos, term) of tokenised documents: one row per token or, with ``terms``, per token that is one of them; the
    others never leave the stage that reads them."""
    each = found.select(F.col(key), F.explode("fields").alias("x")).select(key, "x.col", F.posexplode("x.tokens").alias("pos", "term"))
    return each if terms is None else each.where(F.col("term").isin(*terms))


def postings(df: DataFrame, key: str, columns: dict[str, Column], native: bool = False, terms: Sequence[str] | None = None) -> DataFrame:
    """(key, col, pos, term) of documents; see ``tokenised`` and ``listed``."""
    return listed(tokenised(df, key, columns, native), key, terms)


def by_term(posts: DataFrame, key: str) -> DataFrame:
    """Postings in order of term, so that a query's filter on terms reads only the row groups that hold them.  The key breaks
    ties: a term of very many postings spans several partitions."""
    return posts.repartitionByRange("term", key).sortWithinPartitions("term", key, "col", "pos")


def lengths(posts: DataFrame, key: str) -> DataFrame:
    """(key, tokens): tokens of a document in all columns."""
    return posts.groupBy(key).agg(F.count(F.lit(1)).alias("tokens"))


def lengths_of(found: DataFrame, key: str) -> DataFrame:
    """The same of tokenised documents, of which each is one row: nothing is shuffled.  Documents without tokens are left out."""
    n = F.aggregate("fields", F.lit(0).cast("long"), lambda a, x: a + F.size(x.tokens))  # a step for each field
    return found.select(key, n.alias("tokens")).where("tokens > 0")


def phrase_hits(posts: DataFrame, key: str, query: TextQuery) -> DataFrame:
    """(key, phrase, col, tf).  Only the query's terms leave the postings; a phrase of n words is where its n terms claim
    the same start position, so it takes one aggregate and no self join."""
    found = posts.where(F.col("term").isin(query.terms))
    claims = [F.struct(F.lit(p).alias("phrase"), F.lit(len(words)).alias("size"), F.lit(w).alias("term"), F.lit(i).alias("shift")) for p, words in enumerate(query.phrases) for i, w in enumerate(words)]
    claimed = found.select(key, "col", "pos", F.col("term").alias("t"), F.explode(F.array(*claims)).alias("c")).where("t = c.term")
    starts = claimed.groupBy(key, "col", "c.phrase", "c.size", (F.col("pos") - F.col("c.shift")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    whole = starts.where("n = size")
    return whole.groupBy(key, "phrase", "col").agg(F.count(F.lit(1)).alias("tf"))


def ranked(posts: DataFrame, key: str, query: TextQuery, weights: dict[str, float] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(key, score) of the documents that match; lower scores are better.

    For each phrase, idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6, and f is its frequency weighted by column;
    score = -sum idf f (k1 + 1) / (f + k1 (1 - b + b D / avg D)), with D the document's tokens in all columns.
    """
    if not query.groups:
        return posts.select(key, F.lit(0.0).alias("score")).limit(0)
    weights = WEIGHTS if weights is None else weights
    sizes = lengths(posts, key) if sizes is None else sizes
    documents, mean = sizes.agg(F.count(F.lit(1)), F.avg("tokens")).first()
    hits = phrase_hits(posts, key, query)
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("col") == name, F.lit(w)).otherwise(weight)
    per_doc = hits.groupBy(key, "phrase").agg(F.sum(weight * F.col("tf")).alias("f"))
    n = per_doc.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))  # a row per phrase of the query
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(documents) - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    scored = per_doc.join(F.broadcast(n), "phrase").join(sizes, key)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("tokens") / F.lit(mean or 1.0)))
    total = scored.groupBy(key).agg((-F.sum(part)).alias("score"), F.collect_set("phrase").alias("has"))
    wanted = F.array(*[F.array(*map(F.lit, g)) for g in query.groups])
    return total.where(F.exists(wanted, lambda g: F.size(F.array_intersect(g, F.col("has"))) == F.size(g))).select(key, "score")


def matching(posts: DataFrame, key: str, query: TextQuery) -> DataFrame:
    """Keys that match, without scores."""
    has = phrase_hits(posts, key, query).groupBy(key).agg(F.collect_set("phrase").alias("has"))
    wanted = F.array(*[F.array(*map(F.lit, g)) for g in query.groups]) if query.groups else None
    if wanted is None:
        return posts.select(key).limit(0)
    return has.where(F.exists(wanted, lambda g: F.size(F.array_intersect(g, F.col("has"))) == F.size(g))).select(key)


def top(posts: DataFrame, key: str, text: str, size: int = 20, number: int = 1) -> DataFrame:
    """A page of (key, score), best first, ties by key."""
    from paperloom.operators.facets import page

    return page(ranked(posts, key, parse(text)).orderBy("score", key), number, size)


def best_column(posts: DataFrame, key: str, query: TextQuery) -> DataFrame:
    """(key, col): the column with most hits, for the snippet; ties by name."""
    counted = phrase_hits(posts, key, query).groupBy(key, "col").agg(F.sum("tf").alias("hits"))
    order = Window.partitionBy(key).orderBy(F.desc("hits"), "col")
    return counted.withColumn("r", F.row_number().over(order)).where("r = 1").select(key, "col")


def trigrams(df: DataFrame, key: str, c: Column) -> DataFrame:
    """(key, gram): distinct three-character pieces of a lower-cased text, in one walk over its characters."""
    chars = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("(?s)."), F.lit(0))
    each = df.select(key, chars.alias("x")).where("size(x) >= 3")
    grams = F.transform(F.sequence(F.lit(0), F.size("x") - 3), lambda i: F.concat(F.get("x", i), F.get("x", i + 1), F.get("x", i + 2)))
    return each.select(key, F.explode(F.array_distinct(grams)).alias("gram"))
