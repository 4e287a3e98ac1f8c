import hashlib

import pytest
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.operators import docops as D
from paperloom.functions import textudf as U


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def of(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_identifiers(spark):
    assert of(spark, S.canonical_doi, "https://doi.org/10.1000%2FXYZ.", "doi: 10.1/A+B);", "  ", None, "10.5/%zz") == ["10.1000/xyz", "10.1/a+b", None, None, "10.5/%zz"]
    assert of(spark, S.canonical_arxiv, "https://arxiv.org/abs/2301.00001v3", "arXiv: CS/0101", "") == ["2301.00001", "cs/0101", None]
    assert of(spark, S.doi_in_bibtex, '@a{k, DOI = {10.1/Q},\n}', "@a{k}") == ["10.1/q", None]
    assert of(spark, S.paper_id, "doi:10.1/x") == [hashlib.sha256(b"v1|doi:10.1/x").hexdigest()[:32]]


def test_dates(spark):
    assert of(spark, S.year_of, "May 1999", "18", None, "2021-3") == ["1999", None, None, "2021"]
    assert of(spark, S.month_of, "2021-3", "2021-13", "Sept 2020", "3 march 2020", "1999", None) == ["03", None, "09", "03", None, None]
    assert of(spark, S.month_token, "7", "07", "jul", " July ", "13", "x", "") == ["07", "07", "07", "07", None, None, None]
    assert of(spark, S.leading_int, "2024a", "unknown", None, " -5x") == [2024, 0, 0, -5]


def test_names_and_venues(spark):
    assert of(spark, S.clean_journal, "J. of X (Y) vol. 3 2020,", "", None) == ["J. of X", "Unknown", "Unknown"]
    assert of(spark, S.clean_conference, "Proceedings of the 3rd {ACM} Conference 2019") == ["ACM Conference"]
    assert of(spark, S.venue_class, "IEEE Transactions", "A Workshop", "arXiv", "") == ["journal", "conference", "other", "unknown"]
    assert of(spark, S.facet_value, "  A　 b\n", None) == ["a b", ""]
    assert of(spark, S.author_key, "Doe, Jane", "Jane van Doe et al.", "") == ["doe", "doe", ""]
    assert of(spark, S.template_tag, " Deep Read!! ", "", None) == ["deep_read", "default", "default"]
    assert of(spark, S.safe_name, ' a/b: "c" ', None) == ["a_b_c", ""]
    assert of(spark, S.listed, "a, b,,c ", None) == [["a", "b", "c"], []]


def test_file_names(spark):
    names = ("Doe - 2020 - A_Title.pdf-0123abcd-99.md", "2019 - Other.pdf", "Plain.md")
    assert of(spark, S.file_title, *names) == ["A Title", "Other", "Plain"]
    assert of(spark, S.file_year, *names) == ["2020", "2019", None]
    assert of(spark, S.file_author, *names) == ["Doe", None, None]
    assert of(spark, S.is_pdf_like, "a.PDF", "a.pdf-12", "a.pdf-12.md", "a.md") == [True, True, False, False]


def test_text(spark):
    assert of(spark, lambda c: S.shortened(c, 5), "abcdef", "abc  def", "abc") == ["abcd…", "abc…", "abc"]
    assert of(spark, S.cjk_spaced, "深度学习 x", "abc") == ["深 度 学 习 x", "abc"]
    assert of(spark, lambda c: S.cjk_unspaced(S.cjk_spaced(c)), "深度学习 x ア") == ["深度学习 x ア"]
    assert of(spark, S.cjk_runs, "ab深度c") == [["ab", "深度", "c"]]
    assert of(spark, S.markers_merged, "[[[深]]][[[度]]]") == ["[[[深度]]]"]
    assert of(spark, D.references_col, "see [1], [2, 3] and [x]") == ["see [^1], [^2] [^3] and [x]"]
    assert of(spark, D.links_col, "go https://a.b/c. <https://x.y> me@x.org") == ["go <https://a.b/c>. <https://x.y> <mailto:me@x.org>"]
    assert of(spark, S.unnumbered, "12 deep nets", "123 a", "1 2 a") == ["deep nets", "123 a", "a"]
    assert of(spark, S.prefix_key, "one two three four five", "one two") == ["onetwothreefourf", None]
    assert of(spark, S.json_object_in, '```json\n{"a": {"b": 1}}\n```', "none") == ['{"a": {"b": 1}}', None]
    assert of(spark, lambda c: S.truncated(c, 4, "head_tail")["text"], "abcdefgh", "abc") == ["ab\n\n...\n\ngh", "abc"]
    assert of(spark, lambda c: S.cut_with_note(c, 3), "abcdef") == ["abc\n[truncated: 3 more chars]"]
    with pytest.raises(ValueError):
        S.truncated(F.lit("x"), 1, "middle")


def test_numbers_and_overlap(spark):
    assert one(spark, S.bar(F.lit(1), F.lit(1000)), S.bar(F.lit(0), F.lit(5)), S.bar(F.lit(5), F.lit(5)), S.share(F.lit(1), F.lit(3)), S.tokens_estimated(F.lit(3)), S.tokens_estimated(F.lit(9))) == ("#", "", "#" * 20, 33.3, 1, 2)
    pair = lambda a, b: S.overlaps(F.lit(a), F.lit(b))
    assert one(spark, pair("a b c d", "x a b c d y"), pair("a b", "a b c"), pair("a", "a"), pair("", "")) == (True, False, True, False)


def test_template_choice(spark):
    have = F.array(F.lit("beta"), F.lit("simple"), F.lit("deep_read"))
    assert one(spark, S.preferred_template(have, F.lit("Deep Read")), S.preferred_template(have, F.lit(None)), S.preferred_template(F.array().cast("array<string>"), F.lit("x"))) == ("deep_read", "simple", "default")
    assert one(spark, S.in_order(have, F.array(F.lit("deep_read"), F.lit("none"))))[0] == ["deep_read", "beta", "simple"]


def test_candidates(spark):
    row = one(spark, S.key_candidates(F.lit("10.1/A"), F.lit(None), F.lit(" k "), F.lit("{}")))[0]
    assert [(r.strength, r.key_type) for r in row] == [(4, "doi"), (2, "bib"), (1, "meta")] and row[1].paper_key == "bib:k"


def test_python_texts():
    assert U.title_key(r"$\alpha$-Nets: {A} Study of \textbf{x2y} β") == "nets astudy of x 2 ybeta"
    assert U.meta_title("Ａ—B: c!") == "a b c"
    assert U.plain_text("text\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nmore `code` ![alt](x.png) <b>bold</b>") == "text more code alt bold"
    assert U.search_tokens("Café_x 2.5 ß") == ["cafe", "x", "2", "5", "ss"]
    assert U.display_title("a<sub>2</sub> &amp; <inline-formula><tex-math>$x$</tex-math></inline-formula>") == "a2 & $x$"
    assert U.ratio("abcd", "bcde") == 0.75 and U.ratio("", "x") == 0.0
    assert U.snippet("one two three four five", ["four"], 2) == "…three [[[four]]]…"
    assert U.snippet("深 度 学", ["深", "度"]) == "[[[深]]] [[[度]]] 学"


def test_batched_columns(spark):
    df = spark.createDataFrame([("Ａ b",), (None,)], "t string")
    assert [r[0] for r in df.select(U.meta_name_col("t")).collect()] == ["a b", None]
