"""Record linkage: postings of keys, a staged resolver, adaptive similarity, compare, merge, identity."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.scalars import compact, paper_id, prefix_key, unnumbered
from paperloom.functions.textudf import leading_ratio_col, ratio_col
from paperloom.operators.ranking import first_per
from paperloom.plans.storage import keep

#: Stages of the resolver in the order in which they are tried, and the kind of key that each looks up.
STAGES = ((1, "title", "title"), (2, "title_compact", "compact"), (3, "title_stripped", "stripped"), (4, "title_compact", "stripped_compact"))
LEAST_BY_YEAR = 0.8
#: A candidate stands out if a threshold parts it from the next best: thresholds are HIGHEST and so many LEVELS below it, a
#: STEP apart, and where one lets in several at once, a grid of GRID parts between it and the one above.
HIGHEST, STEP, LEVELS, GRID = 0.95, 0.05, 10, 1024
#: What a score is rounded by, so that equal thresholds are equal.
NEAR = 1e-9


def targets(df: DataFrame, ident: str, ordinal: str, title_key: Column, year: Column | None = None, author: Column | None = None) -> DataFrame:
    """The postings of the target side: (kind, key, ident, ordinal, title_key), one row per key of a target."""
    none = F.lit(None).cast("string")
    keys = {"title": title_key, "compact": compact(title_key), "prefix": prefix_key(title_key), "year": year if year is not None else none}
    keys["author_year"] = F.concat_ws(":", year, author) if year is not None and author is not None else none
    if author is not None and year is not None:
        keys["author_year"] = F.when(year.isNotNull() & (F.coalesce(author, F.lit("")) != ""), keys["author_year"])
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in keys.items()])
    each = df.select(F.col(ident).alias("target"), F.col(ordinal).alias("target_ord"), title_key.alias("target_title"), F.explode(listed).alias("k"))
    return each.select("k.kind", "k.key", "target", "target_ord", "target_title").where("key IS NOT NULL AND key != ''")


def queries(df: DataFrame, ident: str, title_key: Column, year: Column | None = None, author: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.col(ident).alias("ident"), title_key.alias("title_key"), (year if year is not None else none).alias("year"), (author if author is not None else none).alias("author"))


def exact_stages(asked: DataFrame, posts: DataFrame) -> DataFrame:
    """(ident, target, match_type, score) by the four exact stages, each query's first stage that hits and there the target
    of least ordinal.  All stages are one equi join on (kind, key); the targets are first reduced to one per key, so a
    frequent key costs one row."""
    best = posts.where(F.col("kind").isin("title", "compact")).groupBy("kind", "key").agg(F.min(F.struct("target_ord", "target")).alias("t"))
    t = F.col("title_key")
    bare = unnumbered(t)
    stripped = F.when((bare != "") & (bare != t), bare)
    wanted = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(name).alias("match_type"), F.lit(kind).alias("kind"), key.alias("key")) for (n, name, _), kind, key in zip(STAGES, ("title", "compact", "title", "compact"), (t, compact(t), stripped, compact(stripped)))])
    each = asked.where("title_key != ''").select("ident", F.explode(wanted).alias("w")).where("w.key IS NOT NULL").select("ident", "w.*")
    hits = each.join(best, ["kind", "key"]).select("ident", "stage", "match_type", F.col("t.target").alias("target"))
    return first_per(hits, ["ident"], [F.col("stage")]).select("ident", "target", "match_type", F.lit(1.0).alias("score"))


def stands_out(best: Column, second: Column) -> Column:
    """Whether a threshold lets in the best score alone.  The first level that the best reaches decides: the second falls short
    of it, or is in a lower cell of the grid between it and the level above.  At the highest level there is none above."""
    level = F.greatest(F.lit(0), F.ceil((F.lit(HIGHEST) - best) / STEP - NEAR))
    floor_ = F.lit(HIGHEST) - level * STEP
    cell = lambda s: F.floor((s - floor_) / STEP * GRID + NEAR)
    apart = second.isNull() | (second < floor_ - NEAR) | ((level > 0) & (cell(best) > cell(second)))
    return (level < LEVELS) & apart


def floor_of(best: float, lowest: float) -> float:
    """What a score must reach to matter beside this best: the first level that the best reaches, ``lowest`` at least."""
    level = max(0, math.ceil((HIGHEST - best) / STEP - NEAR))
    return max(lowest, HIGHEST - level * STEP) - 2 * NEAR


def overlap(a: Column, b: Column) -> Column:
    """Equal titles, or one that holds the other, if that is long enough to say something: 24 characters or four words."""
    short, long = F.when(F.length(b) < F.length(a), b).otherwise(a), F.when(F.length(b) < F.length(a), a).otherwise(b)
    telling = (F.length(short) >= 24) | (F.size(F.split(F.trim(short), r"\s+")) >= 4)
    return (short != "") & ((a == b) | (telling & long.contains(short)))


def within_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the lengths allow a ratio of ``least``: 2 m / (|a| + |b|) with m at most the shorter length."""
    return F.least(F.length(a), F.length(b)) * 2 >= (F.length(a) + F.length(b)) * F.lit(least) - NEAR


def block_stage(asked: DataFrame, posts: DataFrame, kind: str, key: Column, match_type: str, least: float = 0.0) -> DataFrame:
    """(ident, target, match_type, score): for each query the target of its block that overlaps it, the first in order, or else
    the one whose similarity stands out among the block's, and is ``least`` at least.

    Pairs are scored in Arrow batches, and only those whose lengths and common letters allow a score that could matter beside
    the best of the query in the batch.  A query's two best are picked by rank, which keeps two rows a query in every task
    before anything is shuffled; no block is gathered.
    """
    mine = asked.select("ident", "title_key", key.alias("key")).where("key IS NOT NULL AND title_key != ''")
    block = posts.where((F.col("kind") == kind) & F.col("target_title").isNotNull()).select("key", "target", "target_ord", "target_title")
    paired = mine.join(block, "key").select("ident", "title_key", "target", "target_ord", "target_title")
    lowest = max(least, HIGHEST - STEP * (LEVELS - 1))
    t, o = F.col("title_key"), F.col("target_title")
    first = F.min(F.struct("target_ord", "target"))
    same = keep(paired.where(overlap(t, o)).groupBy("ident").agg(first.alias("t")).select("ident", F.col("t.target").alias("target")), "overlaps")
    # a second best below the lowest threshold never matters, a best below it never wins
    others = paired.join(same, "ident", "left_anti").where((o != "") & within_reach(t, o, lowest))
    score = leading_ratio_col(F.to_json(F.struct("ident", "title_key")), t, o, partial(floor_of, lowest=lowest))
    scored = others.select("ident", "target", "target_ord", score.alias("score")).where("score IS NOT NULL AND NOT isnan(score)")
    at = F.row_number().over(Window.partitionBy("ident").orderBy(F.desc("score"), "target_ord"))
    two = scored.withColumn("at", at).where("at <= 2").groupBy("ident")
    two = two.agg(F.min_by("target", "at").alias("target"), F.max("score").alias("best"), F.max(F.when(F.col("at") == 2, F.col("score"))).alias("second"))
    found = two.where((F.col("best") >= least) & stands_out(F.col("best"), F.col("second")))
    named = F.when(F.col("best") >= 1.0, match_type).otherwise("title_fuzzy")
    matches = found.select("ident", "target", named.alias("match_type"), F.col("best").alias("score"))
    return matches.unionByName(same.select("ident", "target", F.lit(match_type).alias("match_type"), F.lit(1.0).alias("score")))


def resolve(asked: DataFrame, posts: DataFrame) -> DataFrame:
    """(ident, target, match_type, score) by the whole cascade: exact title, compact, without leading numbers, then prefix
    block, author and year, year.  Every stage sees only what the stages before it left."""
    # what a stage found is written, as the stages after it ask for what it left
    exact = keep(exact_stages(asked, posts), "exact")
    left = asked.join(exact, "ident", "left_anti")
    t = F.col("title_key")
    has_block = posts.where("kind = 'prefix'").select("key").distinct()
    own, bare = prefix_key(t), prefix_key(unnumbered(t))
    tried = left.withColumn("own", own).withColumn("bare", bare)
    known = tried.join(has_block.select(F.col("key").alias("own"), F.lit(True).alias("hit")), "own", "left")
    prefix = keep(block_stage(known, posts, "prefix", F.when(F.col("hit"), F.col("own")).otherwise(F.col("bare")), "title_prefix"), "prefix")
    left = left.join(prefix, "ident", "left_anti").where(F.col("year").rlike(r"^\d+$"))
    both = F.when(F.coalesce(F.col("author"), F.lit("")) != "", F.concat_ws(":", "year", "author"))
    with_author = left.withColumn("ay", both)
    blocks = posts.where("kind = 'author_year'").select(F.col("key").alias("ay"), F.lit(True).alias("hit")).distinct()
    split = keep(with_author.join(blocks, "ay", "left"), "split")
    by_author = block_stage(split.where("hit"), posts, "author_year", F.col("ay"), "title_fuzzy", LEAST_BY_YEAR)
    by_year = block_stage(split.where("hit IS NULL"), posts, "year", F.col("year"), "title_fuzzy", LEAST_BY_YEAR)
    untitled = split.where("title_key = ''").select("ident", F.when(F.col("hit"), "author_year").otherwise("year").alias("kind"), F.when(F.col("hit"), F.col("ay")).otherwise(F.col("year")).alias("key"))
    single = posts.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).where("n = 1")
    alone = untitled.join(single, ["kind", "key"]).select("ident", "target", F.col("kind").alias("match_type"), F.lit(1.0).alias("score"))
    return exact.unionByName(prefix).unionByName(by_author).unionByName(by_year).unionByName(alone)


def compare(a: DataFrame, b: DataFrame, matches: DataFrame, ident: str = "ident", columns: tuple[str, ...] = ("source_hash", "title", "source_path"), lang: str | None = None) -> DataFrame:
    """Both sides and the pairs of a comparison: side, the columns, match_status, match_type, match_score, other_*, lang.

    ``matches`` (ident of A, target: ident of B, match_type, score), at most one per A.  Where several of A match one of
    B, B's own row shows the last of them.
    """
    left = matches.select(F.col("ident").alias("a_id"), F.col("target").alias("b_id"), "match_type", F.col("score").alias("match_score"))
    side_a = a.select(F.col(ident).alias("a_id"), *[F.col(c) for c in columns])
    side_b = b.select(F.col(ident).alias("b_id"), *[F.col(c).alias(f"other_{c}") for c in columns])
    paired = left.join(side_a, "a_id").join(side_b, "b_id")
    last = paired.groupBy("b_id").agg(F.max_by(F.struct("match_type", "match_score", *columns), "a_id").alias("m"))

    def shaped(df: DataFrame, side: str, status: Column) -> DataFrame:
        return df.select(F.lit(side).alias("side"), *columns, status.alias("match_status"), "match_type", F.coalesce("match_score", F.lit(0.0)).alias("match_score"), *[f"other_{c}" for c in columns], F.lit(lang).cast("string").alias("lang"))

    from_a = side_a.join(paired.select("a_id", "match_type", "match_score", *[f"other_{c}" for c in columns]), "a_id", "left")
    from_b = b.select(F.col(ident).alias("b_id"), *[F.col(c) for c in columns]).join(last, "b_id", "left")
    from_b = from_b.select("b_id", *columns, F.col("m.match_type").alias("match_type"), F.col("m.match_score").alias("match_score"), *[F.col(f"m.{c}").alias(f"other_{c}") for c in columns])
    status = lambda only: F.when(F.col("match_type").isNotNull(), "matched").otherwise(only)
    rows = shaped(from_a, "A", status("only_in_A")).unionByName(shaped(from_b, "B", status("only_in_B")))
    return rows.unionByName(shaped(paired, "MATCH", F.lit("matched_pair")))


def first_hits(*stages: DataFrame) -> DataFrame:
    """Matches (ident, target, match_type, score) of several stages, each ident's from the first that has one."""
    numbered = [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)]
    whole = numbered[0]
    for s in numbered[1:]:
        whole = whole.unionByName(s)
    return first_per(whole, ["ident"], [F.col("stage"), F.col("target")]).select("ident", "target", "match_type", "score")


def hash_stage(a: DataFrame, b: DataFrame, ident: str = "ident", key: str = "source_hash") -> DataFrame:
    """Equal, non-empty hashes; the last of B under one hash."""
    best = b.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.max(ident).alias("target"))
    return a.join(best, key).select(F.col(ident).alias("ident"), "target", F.lit("hash").alias("match_type"), F.lit(1.0).alias("score"))


def compare_summary(compared: DataFrame) -> DataFrame:
    """(measure, name, n): totals, matched and unmatched by side, and pairs by type."""
    sides = compared.where("side != 'MATCH'").groupBy(F.col("side").alias("measure"), F.col("match_status").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    kinds = compared.where("side = 'MATCH'").groupBy(F.lit("match_type").alias("measure"), F.col("match_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return sides.unionByName(kinds)


def bibliography_match(papers: DataFrame, ident: str, title: Column, entries: DataFrame, entry: str, entry_ord: str, entry_title: Column, least: float = 0.9) -> DataFrame:
    """(ident, entry, score): each paper's most similar entry, blocked by the first 16 characters; papers whose block is
    empty are compared with all entries, in groups of papers, against a list whose size is checked.  The first of equal
    scores wins."""
    mine = papers.select(F.col(ident).alias("ident"), title.alias("t")).where("t != ''").withColumn("block", F.substring("t", 1, 16))
    theirs = entries.select(F.col(entry).alias("entry"), F.col(entry_ord).alias("ord"), entry_title.alias("e")).where("e != ''").withColumn("block", F.substring("e", 1, 16))
    near = mine.join(theirs, "block").select("ident", "entry", "ord", ratio_col("t", "e").alias("score"))
    far = mine.join(theirs.select("block").distinct(), "block", "left_anti")
    found = near.unionByName(_against_all(far, theirs, least).select("ident", "entry", "ord", "score"))
    return first_per(found.where(F.col("score") >= least), ["ident"], [-F.col("score"), F.col("ord")]).select("ident", "entry", "score")


def bibliography_first(papers: DataFrame, ident: str, title: Column, entries: DataFrame, entry: str, entry_ord: str, entry_title: Column, least: float = 0.9) -> DataFrame:
    """(ident, entry, score): each paper's first entry in order whose title is ``least`` alike, over the whole list; papers
    without one are left out.  Only entries whose lengths allow that score are compared."""
    mine = papers.select(F.col(ident).alias("ident"), title.alias("t")).where("t != ''")
    theirs = entries.select(F.col(entry).alias("entry"), F.col(entry_ord).alias("ord"), entry_title.alias("e")).where("e != ''")
    near = _against_all(mine, theirs, least).where(F.col("score") >= least)
    return first_per(near, ["ident"], [F.col("ord")]).select("ident", "entry", "score")


def _against_all(mine: DataFrame, theirs: DataFrame, least: float, buckets: int = 64) -> DataFrame:
    """Papers without a block, against every entry: texts whose lengths differ too much cannot reach ``least``, so both
    sides are bucketed by length and only buckets within reach meet.  ratio = 2 m / (|a| + |b|) >= least needs
    min / max >= least / (2 - least)."""
    reach = least / (2 - least)
    width = 8
    a = mine.withColumn("n", F.length("t"))
    low, high = F.floor(F.col("n") * reach / width), F.floor(F.col("n") / reach / width)
    a = a.withColumn("b", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    b = theirs.withColumn("b", F.floor(F.length("e") / width).cast("long")).select("entry", "ord", "e", "b")
    return a.join(b, "b").select("ident", "entry", "ord", ratio_col("t", "e").alias("score"))


def merge_groups(records: DataFrame, ident: str, ordinal: str, source_hash: Column, bib_title: Column, paper_title: Column, least: float = 0.95, prefix: int = 5, rounds: int = 30) -> DataFrame:
    """(ident, group_id): records that are one paper, by equal source hash or by similar titles within a block of equal
    first characters; group_id is the least ordinal of the group.

    Linking one by one, as records arrive, depends on their order and is not transitive; here a group is a connected
    component of the links, which is what repeated merging comes to.  BibTeX titles are compared where both have one,
    paper titles otherwise.  Exact titles are links of their own, so a frequent title is a star and not all pairs.
    """
    base = records.select(F.col(ident).alias("ident"), F.col(ordinal).alias("o"), source_hash.alias("h"), bib_title.alias("bt"), paper_title.alias("pt"))
    stars = None
    for c in ("h", "bt", "pt"):
        keyed = base.where(F.coalesce(F.col(c), F.lit("")) != "").select(F.col(c).alias("k"), "o")
        hub = keep(keyed.groupBy("k").agg(F.min("o").alias("v")), "hubs")
        part = keyed.join(hub, "k").select(F.col("o").alias("u"), "v").where("u != v")
        stars = part if stars is None else stars.unionByName(part)
    links = stars
    for c in ("bt", "pt"):
        once = base.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy(F.col(c).alias("t")).agg(F.min("o").alias("o"))
        # written first: the join reads plain exchanges, so a frequent beginning can be split
        keyed = keep(once.withColumn("p", F.substring("t", 1, prefix)), "titles")
        x, y = keyed.alias("x"), keyed.alias("y")
        reach = least / (2 - least)
        close = (F.col("x.o") < F.col("y.o")) & (F.least(F.length("x.t"), F.length("y.t")) >= reach * F.greatest(F.length("x.t"), F.length("y.t")))
        pairs = x.join(y, (F.col("x.p") == F.col("y.p")) & close).select(F.col("x.t").alias("a"), F.col("y.t").alias("b"), F.col("x.o").alias("v"), F.col("y.o").alias("u"))
        links = links.unionByName(pairs.where(ratio_col("b", "a") >= least).select("u", "v"))
    labels = smallest_reachable(base.select(F.col("o").alias("node")), links, rounds)
    return base.select("ident", F.col("o").alias("node")).join(labels, "node").select("ident", F.col("label").alias("group_id"))


def smallest_reachable(nodes: DataFrame, links: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, label): the least node reachable over ``links`` (u, v).  Labels spread along links and then jump to their
    label's label, so a chain takes a number of rounds that grows with the logarithm of its length."""
    both = keep(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    state = keep(nodes.select("node", F.col("node").alias("label")).distinct())
    for _ in range(rounds):
        near = both.join(state, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("seen"))
        spread = state.join(near, F.col("node") == F.col("u"), "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("seen", "label")).alias("label"))
        hop = spread.select(F.col("node").alias("at"), F.col("label").alias("onward"))
        new = keep(spread.join(hop, F.col("label") == F.col("at")).select("node", "old", F.least("label", "onward").alias("label")))
        state = new.select("node", "label")
        if new.where("old != label").isEmpty():
            return state
    raise RuntimeError("labels did not settle")


def identities(papers: DataFrame, ident: str, candidates: Column, aliases: DataFrame, similar: float = 0.8, shared: float = 0.5) -> DataFrame:
    """(ident, paper_id, paper_key, key_type, conflicts): the id that the strongest key had before, else a new one from the
    strongest key.  ``candidates``: array of (strength, key_type, paper_key[, fingerprint]); ``aliases``: (paper_key,
    paper_id, meta_fingerprint).  A match by metadata alone is refused if title and authors both diverge; weaker keys that
    name another id are conflicts."""
    each = papers.select(F.col(ident).alias("ident"), F.posexplode(candidates).alias("i", "c"), candidates.getItem(0).alias("top"))
    old = aliases.select(F.col("paper_key").alias("k"), F.col("paper_id").alias("old_id"), F.col("meta_fingerprint").alias("old_print"))
    hits = each.join(old, F.col("c.paper_key") == F.col("k"), "left")
    now = F.col("c.fingerprint") if "fingerprint" in candidates_fields(papers, candidates) else F.lit(None).cast("string")
    grouped = hits.groupBy("ident").agg(
        F.first("top").alias("top"),
        F.array_sort(F.collect_list(F.when(F.col("old_id").isNotNull(), F.struct((-F.col("c.strength")).alias("s"), F.col("old_id"), F.col("c.paper_key").alias("key"), F.col("c.key_type").alias("kind"), F.col("old_print"), now.alias("new_print"))))).alias("hits"),
    )
    best = F.col("hits").getItem(0)
    fresh = paper_id(F.col("top.paper_key"))
    apart = grouped.withColumn("best", F.when(F.size("hits") > 0, best)).withColumn("diverged", F.coalesce((F.col("best.kind") == "meta") & diverged(F.col("best.old_print"), F.col("best.new_print"), similar, shared), F.lit(False)))
    others = F.filter(F.slice("hits", 2, F.greatest(F.size("hits") - 1, F.lit(0))), lambda h: h.old_id != F.col("best.old_id"))
    told = F.transform(others, lambda h: F.concat(F.lit("key_conflict:"), h.key, F.lit(" maps "), h.old_id, F.lit(" vs "), F.col("best.old_id")))
    told = F.when(F.size("hits") > 1, told).otherwise(F.array().cast("array<string>"))
    told = F.when(F.col("diverged"), F.concat(told, F.array(F.concat(F.lit("meta_divergent:"), F.col("best.key"))))).otherwise(told)
    chosen = F.when(F.col("best").isNull() | F.col("diverged"), fresh).otherwise(F.col("best.old_id"))
    return apart.select("ident", chosen.alias("paper_id"), F.col("top.paper_key").alias("paper_key"), F.col("top.key_type").alias("key_type"), told.alias("conflicts"))


def candidates_fields(df: DataFrame, candidates: Column) -> list[str]:
    return df.select(candidates.alias("c")).schema["c"].dataType.elementType.fieldNames()


def diverged(old: Column, new: Column, similar: float, shared: float) -> Column:
    """Title similarity and author overlap of two fingerprints both too small."""
    schema = "title string, authors array<string>"
    a, b = F.from_json(old, schema), F.from_json(new, schema)
    people = F.array_union(F.coalesce(a.authors, F.array().cast("array<string>")), F.coalesce(b.authors, F.array().cast("array<string>")))
    common = F.array_intersect(F.coalesce(a.authors, F.array().cast("array<string>")), F.coalesce(b.authors, F.array().cast("array<string>")))
    jaccard = F.when(F.size(people) == 0, 1.0).otherwise(F.size(common) / F.size(people))
    return (ratio_col(F.coalesce(a.title, F.lit("")), F.coalesce(b.title, F.lit(""))) < similar) & (jaccard < shared)


def existing_ids(records: DataFrame, ident: str, stages: list[tuple[DataFrame, Column]]) -> DataFrame:
    """(ident, paper_id, stage): all papers of the first stage that finds any.  Each stage is (table with columns key and
    paper_id, the record's key for it)."""
    whole = None
    for i, (table, key) in enumerate(stages):
        part = records.select(F.col(ident).alias("ident"), key.alias("key")).where("key IS NOT NULL AND key != ''").join(table.select("key", "paper_id"), "key").select("ident", "paper_id", F.lit(i).alias("stage"))
        whole = part if whole is None else whole.unionByName(part)
    first = whole.groupBy("ident").agg(F.min("stage").alias("stage"))
    return whole.join(first, ["ident", "stage"]).select("ident", "paper_id", "stage").distinct()


def merged_fields(df: DataFrame, key: str, ordinal: str, fields: list[str]) -> DataFrame:
    """One row per key, each field from the first record in order that has it."""
    return df.groupBy(key).agg(*[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(ordinal))).alias(f) for f in fields])


def kept_best(df: DataFrame, keys: list[str], score: Column, ordinal: str) -> DataFrame:
    """The row of highest score per key; ties to the first."""
    return first_per(df, keys, [-score, F.col(ordinal)])


def first_by_title(df: DataFrame, title: Column, ordinal: str) -> DataFrame:
    """The first row of each title; rows without a title all stay."""
    t = df.withColumn("__t", F.coalesce(title, F.lit("")))
    named = t.where("__t != ''").groupBy("__t").agg(F.min(ordinal).alias("__o"))
    kept = t.join(named.select(F.col("__t").alias("__t2"), "__o"), (F.col("__t") == F.col("__t2")) & (F.col(ordinal) == F.col("__o")), "left_semi")
    return kept.unionByName(t.where("__t = ''")).drop("__t")


def unmatched(files: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """Files that no record claims: the rows that become stubs."""
    return files.join(matched, key, "left_anti")


def union_in_place(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both tables by key, the new one where both have it; a null key matches a null key."""
    same = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    joined = o.join(n, F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full_outer")
    pick = lambda c: F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*[pick(c).alias(c) for c in [key, *same]])
