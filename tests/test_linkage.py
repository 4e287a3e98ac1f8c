import difflib

from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.operators import linkage as L
from paperloom.operators import ranking as R


def by_block(spark, rows, least=0.0):
    """{ident: (target, score)} for rows (ident, title, [(target, title), ...]), each ident with a block of its own."""
    asked = spark.createDataFrame([(i, t, str(i), None) for i, t, _ in rows], "ident long, title_key string, year string, author string")
    posts = spark.createDataFrame([("block", str(i), c, o, x) for i, _, cs in rows for o, (c, x) in enumerate(cs)], "kind string, key string, target string, target_ord long, target_title string")
    return {r.ident: (r.target, r.score) for r in L.block_stage(asked, posts, "block", F.col("year"), "m", least).collect()}


def test_adaptive(spark):
    got = by_block(spark, [(1, "deep learning for graphs and more", [("a", "deep learning for graphs")]), (2, "abcdefgh", [("a", "abcdefgx"), ("b", "zzzzzzzz")]), (3, "abcdefgh", [("a", "abcdefgx"), ("b", "abcdefgy")]), (4, "abcdefghij", [("a", "abcdefghxx"), ("b", "abcdefghix")]), (5, "abc", []), (6, "abcd", [("a", "")]), (7, "a b c d e", [("x", "a b c d"), ("y", "a b c d e")])])
    assert got[1] == ("a", 1.0)
    assert got[2] == ("a", difflib.SequenceMatcher(None, "abcdefgh", "abcdefgx").ratio())
    assert 3 not in got and got[4][0] == "b" and 5 not in got and 6 not in got and got[7] == ("x", 1.0)


def standing_out(title, candidates, least):
    """By definition: going down the thresholds, the first that lets any in, or one on the grid above it, lets in one alone."""
    scores = [(difflib.SequenceMatcher(None, title, x).ratio(), c) for c, x in candidates if x]
    for k in range(10):
        level = 0.95 - 0.05 * k
        grid = [level + 0.05 * j / 1024 for j in range(1024 if k else 1)]
        if any(s >= level - 1e-9 for s, _ in scores):
            for t in grid:
                over = [(c, s) for s, c in scores if s >= t - 1e-9]
                if len(over) == 1:
                    return over[0] if over[0][1] >= least else None
            return None
    return None


def test_adaptive_against_the_definition(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for i in range(150):
        title = "".join(rnd.choice("abcdef") for _ in range(rnd.randint(5, 14)))
        near = lambda: "".join(c if rnd.random() < 0.75 else rnd.choice("abcdef") for c in title)
        rows.append((i, title, [(f"c{k}", x) for k, x in enumerate(near() + rnd.choice(["", "x"]) for _ in range(rnd.randint(1, 6))) if x != title]))
    for least in (0.0, 0.8):
        got = by_block(spark, rows, least)
        want = {i: w for i, t, cs in rows if (w := standing_out(t, cs, least))}
        assert got == want and len(want) > 20


def test_only_what_could_matter_is_scored():
    """What is left out lies below what the best asks for, by the definition, and most is left out."""
    import random
    from functools import partial

    from paperloom.functions import textudf as U

    rnd, words = random.Random(5), [c * 3 + d for c in "abcdefgh" for d in "klmnop"]
    title = " ".join(rnd.choices(words, k=20))
    others = [" ".join(rnd.choices(words, k=rnd.randint(1, 40))) for _ in range(300)] + [title[:-4] + "x", title[4:], "", title]
    for lowest in (0.5, 0.8):
        got = U.leading_ratios(title, others, partial(L.floor_of, lowest=lowest))
        least = L.floor_of(max(U.ratio(title, x) for x in others), lowest)
        assert all(g == U.ratio(title, x) if g is not None else U.ratio(title, x) < least for g, x in zip(got, others))
        assert sum(g is not None for g in got) < 10


def test_every_hundredth_document_is_a_query(spark, small):
    from paperloom.queries import QUERIES

    found = [r.ident for r in QUERIES["resolve_cascade_full"](spark, small).select("ident").collect()]
    assert found and all(i % 100 == 0 for i in found) and len(set(found)) == len(found)


def test_a_block_of_any_size(spark):
    """One key for all queries and targets: rows are ranked per query, no block is gathered."""
    rows = [(i, f"title number {i:04} of the series", "k", None) for i in range(300)]
    asked = spark.createDataFrame(rows, "ident long, title_key string, year string, author string")
    posts = spark.createDataFrame([("block", "k", i, i, t.replace("series", "seriez")) for i, t, *_ in rows], "kind string, key string, target long, target_ord long, target_title string")
    stage = L.block_stage(asked, posts, "block", F.col("year"), "m")
    assert {r.ident: r.target for r in stage.collect()} == {i: i for i in range(300)}
    assert "WindowGroupLimit" in stage._jdf.queryExecution().toString()


def test_cascade(spark):
    files = [(1, "deep learning for graph data", "2020", "lee"), (2, "deeplearning x", "2020", "kim"), (3, "networks", "2021", "kim"), (4, "attention is all you need here", "2017", "vas"), (5, "quite another story", "2015", "solo")]
    f = spark.createDataFrame(files, "id int, t string, y string, a string")
    posts = L.targets(f, "id", "id", F.col("t"), F.col("y"), F.col("a"))
    asked = [("exact", "networks", None, None), ("compact", "deep learningx", None, None), ("strip", "3 networks", None, None), ("prefix", "attention is all you nead hire", None, None), ("over", "attention is all you need here now", None, None), ("author", "networkz", "2021", "kim"), ("none", "nothing alike", "1990", None), ("alone", "", "2015", "solo"), ("far", "zzzz", "2021", "kim")]
    q = spark.createDataFrame(asked, "id string, t string, y string, a string")
    got = {r.ident: (r.target, r.match_type) for r in L.resolve(L.queries(q, "id", F.col("t"), F.col("y"), F.col("a")), posts).collect()}
    assert got == {"exact": (3, "title"), "compact": (2, "title_compact"), "strip": (3, "title_stripped"), "prefix": (4, "title_fuzzy"), "over": (4, "title_prefix"), "author": (3, "title_fuzzy"), "alone": (5, "author_year")}


def test_compare_with_itself_matches_all(spark):
    a = spark.createDataFrame([(i, f"h{i}", f"t{i}", f"/{i}") for i in range(5)], "ident long, source_hash string, title string, source_path string")
    got = L.compare(a, a, L.hash_stage(a, a)).collect()
    assert sorted((r.side, r.match_status) for r in got) == sorted([("A", "matched"), ("B", "matched"), ("MATCH", "matched_pair")] * 5)


def test_compare_shows_the_last_of_several(spark):
    s = "ident long, source_hash string, title string, source_path string"
    a = spark.createDataFrame([(1, "h", "x", "/1"), (2, "h", "y", "/2"), (3, "", "z", None)], s)
    b = spark.createDataFrame([(7, "h", "q", "/7"), (8, "", "z", "/8")], s)
    got = {(r.side, r.title): (r.match_status, r.other_title) for r in L.compare(a, b, L.hash_stage(a, b)).collect() if r.side != "MATCH"}
    assert got == {("A", "x"): ("matched", "q"), ("A", "y"): ("matched", "q"), ("A", "z"): ("only_in_A", None), ("B", "q"): ("matched", "y"), ("B", "z"): ("only_in_B", None)}


def test_bibliography(spark):
    papers = spark.createDataFrame([(1, "a long title about networks"), (2, "b short"), (3, "the long title about networks"), (4, "")], "id int, t string")
    entries = spark.createDataFrame([("k1", 1, "a long title about network"), ("k2", 2, "a long title about networkz"), ("k3", 3, "xx")], "k string, o int, t string")
    got = {r.ident: r.entry for r in L.bibliography_match(papers, "id", F.col("t"), entries, "k", "o", F.col("t")).collect()}
    assert got == {1: "k1", 3: "k1"} or got == {1: "k1", 3: "k2"}
    best = max(("k1", "k2"), key=lambda k: difflib.SequenceMatcher(None, "the long title about networks", {"k1": "a long title about network", "k2": "a long title about networkz"}[k]).ratio())
    assert got.get(3, best) == best


def test_bibliography_first(spark):
    """The first entry in order that is alike enough, not the best, and over the whole list."""
    papers = spark.createDataFrame([(1, "a long title about networks"), (2, "b short"), (3, "xa long title about networks"), (4, "")], "id int, t string")
    entries = spark.createDataFrame([("k0", 0, "something else entirely"), ("k1", 1, "a long title about networkz"), ("k2", 2, "a long title about networks"), ("k3", 3, "a long title about networks and so much more of it")], "k string, o int, t string")
    got = {r.ident: (r.entry, round(r.score, 6)) for r in L.bibliography_first(papers, "id", F.col("t"), entries, "k", "o", F.col("t")).collect()}
    ratio = lambda a, b: round(difflib.SequenceMatcher(None, a, b).ratio(), 6)
    assert got == {1: ("k1", ratio("a long title about networks", "a long title about networkz")), 3: ("k1", ratio("xa long title about networks", "a long title about networkz"))}


def test_merge_is_by_hash_and_similar_title(spark):
    rows = [(0, "h1", None, "a fairly long paper title"), (1, "h1", None, "other"), (2, None, None, "a fairly long paper titla"), (3, None, "bib one title which is here", "zzz"), (4, None, "bib one title which is hera", "yyy"), (5, None, None, ""), (6, "", None, None)]
    df = spark.createDataFrame(rows, "o long, h string, bt string, pt string")
    got = {r.ident: r.group_id for r in L.merge_groups(df, "o", "o", F.col("h"), F.col("bt"), F.col("pt")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6}


def test_identity(spark):
    def fp(title, people):
        return '{"authors":[%s],"title":"%s","venue":"","year":"2020"}' % (",".join(f'"{p}"' for p in people), title)

    aliases = spark.createDataFrame([("doi:10.1/a", "P1", None), ("bib:k", "P2", None), ("meta:m", "P3", fp("same title", ["x"]))], "paper_key string, paper_id string, meta_fingerprint string")
    s = "array<struct<strength:int,key_type:string,paper_key:string,fingerprint:string>>"
    meta = (1, "meta", "meta:m", fp("same title", ["x"]))
    far = (1, "meta", "meta:m", fp("quite unlike it", ["y"]))
    rows = [(1, [(4, "doi", "doi:10.1/a", None), (2, "bib", "bib:k", None)]), (2, [(4, "doi", "doi:new", None), (2, "bib", "bib:k", None)]), (3, [meta]), (4, [far]), (5, [(2, "bib", "bib:none", None)])]
    got = {r.ident: r for r in L.identities(spark.createDataFrame(rows, f"i int, c {s}"), "i", F.col("c"), aliases).collect()}
    assert [got[i].paper_id for i in (1, 2, 3)] == ["P1", "P2", "P3"]
    assert got[1].conflicts == ["key_conflict:bib:k maps P2 vs P1"] and got[2].paper_key == "doi:new"
    assert got[4].conflicts == ["meta_divergent:meta:m"] and got[4].paper_id != "P3" and len(got[4].paper_id) == 32
    assert got[5].conflicts == [] and got[5].paper_id == spark.range(1).select(S.paper_id(F.lit("bib:none"))).first()[0]


def test_existing_ids_fan_out_in_the_first_stage(spark):
    t = lambda rows: spark.createDataFrame(rows, "key string, paper_id string")
    records = spark.createDataFrame([(1, "x", "c"), (2, None, "c"), (3, "no", "no")], "i int, a string, b string")
    got = sorted(tuple(r) for r in L.existing_ids(records, "i", [(t([("x", "P1")]), F.col("a")), (t([("c", "P2"), ("c", "P3")]), F.col("b"))]).collect())
    assert got == [(1, "P1", 0), (2, "P2", 1), (2, "P3", 1)]


def test_ranks_and_names(spark):
    df = spark.createDataFrame([(i * 7 % 101, "b" if i % 2 else "a") for i in range(101)], "id long, g string")
    ranks = {r["id"]: r["rank"] for r in R.global_rank(df, "id").collect()}
    assert ranks == {i: i + 1 for i in range(101)}
    words = spark.createDataFrame([(w,) for w in ["b", "a", "", None, "ab", "é", "abc"]], "w string")
    assert [r.w for r in R.global_rank(words, "w").orderBy("rank").collect()] in ([None, "", "a", "ab", "abc", "b", "é"], ["", None, "a", "ab", "abc", "b", "é"])
    assert R.global_rank(words.limit(0), "w").count() == 0
    assert sorted(r["name"] for r in R.unique_names(df.where("id < 4"), "g", "id").collect()) == ["a", "a_1", "b", "b_1"]
    assert [r["id"] for r in R.slice_rows(df, "id", 98).orderBy("id").collect()] == [98, 99, 100]


def test_union_in_place_and_first_wins(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, None), (2, "c"), (None, "m")], "k int, v string")
    assert sorted(((r.k, r.v) for r in L.union_in_place(old, new, "k").collect()), key=str) == [(1, None), (2, "c"), (None, "m")]
    rows = spark.createDataFrame([(1, 1, None, "x"), (1, 2, "y", "z")], "k int, o int, a string, b string")
    assert tuple(L.merged_fields(rows, "k", "o", ["a", "b"]).first()) == (1, "y", "x")
