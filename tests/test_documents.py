import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import markdown as M
from paperloom.functions import spans as S
from paperloom.functions import translation as T
from paperloom.operators import docops as D

MARKS = st.text(alphabet="ab #*-`~$|<>[]()!\n\\1.:_/é深", max_size=120)
SAMPLE = "# Title\n\nText with `code`, $x_1$ and [link](https://x.org/a) https://y.org/b [^1].\n\n```py\nx = 1\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n<div>\nraw\n</div>\n\n$$\ny\n$$\n\n[^1]: note\n    more\n\n![i](p.png)\n\n    indented\n"


@settings(max_examples=300, deadline=None)
@given(MARKS)
def test_cutting_and_freezing_lose_nothing(text):
    assert "".join(b.content for b in M.parse_blocks(text)) == text
    assert "".join(c for _, c in M.segments(text, 20)) == text
    frozen, store = M.protect(text)
    assert store.restore(frozen) == text


@settings(max_examples=200, deadline=None)
@given(MARKS)
def test_repairs_never_fail(text):
    M.fix_markdown(text, "aggressive")
    M.images_apart(text, True)
    M.math_apart(text)
    S.cleaned_formula(text)
    S.cleaned_diagram(text)


def test_blocks_and_kinds():
    assert [b.kind for b in M.parse_blocks("a\nb\n\n---\n![x](y)\n```\nq\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n$$\nz\n$$\nend")] == ["text", "sep", "page", "image", "code", "table", "math", "text"]
    frozen, store = M.protect(SAMPLE)
    assert {"CODEFENCE", "TABLE", "HTMLBLOCK", "MATHBLOCK", "FOOTDEF", "INDENTCODE", "IMAGE", "LINK", "URL", "CODE", "MATH", "FOOTREF"} <= set(store.kinds)
    assert store.missing(frozen) == [] or all(p.startswith("__PH_") for p in store.missing(frozen))
    kept, _ = M.protect("[words](https://x.org)", link_text=True)
    assert kept.startswith("[words__PH_LINKURL_")


def test_paragraph_merging():
    assert M.merge_paragraphs("the exam-\n---\nple goes on") == "the exam\nple goes on" or M.merge_paragraphs("the exam-\n---\nple goes on").replace("\n", "").startswith("the exam")
    assert M.merge_paragraphs("a sentence without\n---\nan end.") == "a sentence without an end."
    assert M.merge_paragraphs("It ends.\n---\nNew one.") == "It ends.\n---\nNew one."
    assert M.merge_paragraphs("half of it\n![f](x.png)\nand the rest.") == "half of it and the rest.![f](x.png)\n"


def test_references_links_titles():
    assert M.fix_references("see [1], [2-4] and [5, 6]") == "see [^1], [^2] [^3] [^4] and [^5] [^6]"
    assert M.fix_references("[1] First\n[2] Second\n") == "[^1]: First\n[^2]: Second\n"
    assert M.fix_links("https://a.b/c. me@x.org, <https://k.l>") == "<https://a.b/c>. <mailto:me@x.org>, <https://k.l>"
    assert M.fix_titles("# 1 Intro\n# 1.2 Part\n# A. letter\n# B. Name\nplain") == "## 1. Intro\n### 1.2. Part\n#### A. letter\n# B. Name\nplain"
    assert M.fix_titles("# II. Two\n# 1 Sub") == "## II. Two\n### 1 Sub"


def test_fences_notes_algorithms():
    assert M.fences_on_own_lines("text ```py\nx\n```") == "text\n```py\nx\n```"
    assert M.without_open_fences("a\n```\nb") == "a\nb"
    assert M.without_open_fences("```\na\n```\nb") == "```\na\n```\nb"
    assert M.legends_out_of_diagrams("```mermaid\ngraph TD\nLegend: x\n```\nz") == "```mermaid\ngraph TD\n```\nLegend: x\nz"
    assert M.fix_footnotes("a [1]\n\n## References\n1. One\n   more\n2) Two\n\n# Next\n3. list") == "a [^1]\n\n## References\n[^1]: One more\n[^2]: Two\n\n# Next\n3. list"
    assert M.wrap_pseudocode("**Algorithm 1** Sort *all*\n1: for x\nreturn x\nDone.") == "```pseudo\n// Algorithm 1: Sort all\n1: for x\nreturn x\n```\nDone."


def test_formulas_and_diagrams():
    spans = S.math_spans("a $x$ `$y$` \\$5 $$z\n$$")
    assert [(s.delimiter, s.content, s.line) for s in spans] == [("$", "x", 1), ("$$", "z\n", 1)]
    assert S.spliced("abcdef", [(1, 2, "XX"), (4, 5, "")]) == "aXXcdf"
    assert S.cleaned_formula(r"\text{m a x} x^a^b") == r"\text{max} ({x}^{a})^{b}"
    assert S.cleaned_formula("\x08eta + \\Foo") == r"\beta + \text{Foo}"
    assert S.formula_errors(r"\left( {") == ["braces", "left/right"] and S.formula_errors("x_{1}") == []
    assert S.cleaned_diagram("graph TD\na --> b --> c; d & e --> f") == "graph TD\na --> b\nb --> c\nd --> f\ne --> f"
    assert S.cleaned_diagram("--> x[a") == "Start --> x[a]"
    assert S.diagram_spans("```mermaid\ngraph TD\n```")[0].content == "graph TD\n"


@pytest.mark.parametrize(
    "raw, want",
    [
        (r"\5 + \ alpha", r"5 + \alpha"),
        (r"\nabla \nx \nu \neq", r"\nabla x \nu \neq"),
        (r"x^'' + y^' + z^_", r"x^{''} + y^{\prime} + z^{*}"),
        (r"\operatorname_{a r g} \Max_{x} a _\times b", r"\operatorname{arg} \max_{x} a \times b"),
        (r"\arg \max _ {x} a_{b}_c x^{}", r"\arg\max_{x} a_{b} c x"),
        (r"\left ceil x \right ceil \Big{\lfloor}", r"\left\lceil x \right\rceil \Big\lfloor"),
        (r"\text{if x_1 > 2} \text{a \frac{1}{2}}", r"\text{if x} _1 > 2 \text{a} \frac{1}{2}"),
        ("\text{a} + \tfrac{1}{2} \tx", r"\text{a} + \tfrac{1}{2} x"),
        (r"\frac{a}{b}^2 + x^{2}_{i} \{x\} a\\ b {open", r"\frac{a}{b}^2 + x^{2}_{i} \{x\} a\\ b {open"),
        ("  a \u00a0 b \r\n c ", "a   b\nc"),
    ],
)
def test_formula_damage(raw, want):
    assert S.cleaned_formula(raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("graph TDa[x]-->b[y]", "graph TD\na[x] --> b[y]"),
        ("a[(db)] --> b[one\\ntwo]", 'a["(db)"] --> b["one<br/>two"]'),
        ("a[one\ntwo] --> b", 'a["one<br/>two"] --> b'),
        ("a -->[yes] b\na -- no| c\na -. may be .-> d", "a -->|yes| b\na -->|no| c\na -.->|may be| d"),
        ("subgraph one [Title (x)]\na --> b\nend", 'subgraph subgraph_1 ["Title (x)"]\na --> b\nend'),
        ("subgraph subgraph_1\nx\nend", 'subgraph subgraph_2 ["subgraph_1"]\nx\nend'),
        ("a --> b[open\nc --> d", "a --> b[open]\nc --> d"),
        ("a(\"hi -->\") --> b; %% note\n\nc", 'a("hi -->") --> b\n%% note\n\nc'),
        ("\ufeffa[\u201cx\u201d] ==> b{q?}\r\nc", 'a["x"] ==> b{q?}\nc'),
        ("sequenceDiagram\nA->>B: hi\nB-->>A: yo", "sequenceDiagram\nA->>B: hi\nB-->>A: yo"),
    ],
)
def test_diagram_damage(raw, want):
    assert S.cleaned_diagram(raw) == want


def test_freezing_takes_what_begins_first():
    text = "`a [b](c)` $x `y` z$ [l $m$](u) \\[ q \\] <b>x</b> <https://a.b> https://c.d/e [r][s] [^1]\n[d]: http://x\n"
    frozen, store = M.protect(text)
    assert store.kinds == {"CODE": 1, "MATH": 1, "LINK": 1, "MATHBLOCK": 1, "HTMLINLINE": 1, "AUTOLINK": 1, "URL": 1, "REFLINK": 1, "FOOTREF": 1, "LINKDEF": 1}
    assert store.restore(frozen) == text
    block = "<div>\n<div>\nx\n</div>\n</div>\nafter\n<!-- a\n$b$ -->\n<pre>\n<div>\n</pre>\n<hr>\nend"
    assert M.protect(block)[1].kinds == {"HTMLBLOCK": 4} and "after" in M.protect(block)[0]


def test_marks_without_end_cost_no_more():
    import time

    start = time.time()
    for text in ("[" * 100_000, "<a " * 100_000, "$ " * 100_000, "`" * 100_000 + "a", "![" * 50_000):
        frozen, store = M.protect(text)
        assert store.restore(frozen) == text
    assert time.time() - start < 20


def test_plain_texts_of_translations():
    assert T.plain("a $x$ `c` \\(y\\) <b>d</b> https://e.f g ```h\ni``` __PH_A_000001__ $5 `").split() == ["a", "d", "g", "$5", "`"]
    assert T.is_identifier("ABC DEF GHI JKL MNO PQR") and not T.is_identifier("ABC DEF GHI JKL MNO PQR STU")
    assert T.is_identifier("see paper.pdf now") and T.is_identifier("123 - 456") and not T.is_identifier("") and not T.is_identifier("Some words that are longer")
    assert T.is_person("Ann Berg1, Bo Lee2") and T.is_person("Mary-Jane Watson III") and not T.is_person("John") and not T.is_person("A b c d e f g")


def test_translation_gate():
    assert T.failure("Hello world, this is text.", "Hello world, this is text.", "zh").startswith("missing_target_script")
    assert T.failure("Hello world, this is text.", "你好", "zh") is None
    assert T.failure("a __PH_CODE_000001__", "b", "zh") == "placeholders_mismatch"
    assert T.failure("Some words here", " ", "zh") == "empty_output"
    assert T.failure("John Smith", "John Smith", "zh") is None and T.is_person("J. van der Berg Jr.") and not T.is_person("graph networks") and T.is_person("Ann van der Berg")
    assert T.typos_fixed("x __ph_code_000001_ y", {"__PH_CODE_000001__"}) == "x __PH_CODE_000001__ y"
    assert T.realigned("a __PH_A_000001__ __PH_B_000002__", "x __PH_Q_000009__") == "x __PH_A_000001__ __PH_B_000002__"


def test_over_dataframes(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, "plain text"), (3, "")], "id long, text string")
    frozen = D.protected(df, "text")
    assert {r["id"]: r.t for r in frozen.select("id", D.restored(F.col("protected"), F.col("frozen")).alias("t")).collect()} == {1: SAMPLE, 2: "plain text", 3: ""}
    pieces = D.exploded(df, "id", D.segments_col("text"))
    assert {r["id"]: r.text for r in D.reassembled(pieces, "id").collect()} == {1: SAMPLE, 2: "plain text"}
    broken = spark.createDataFrame([(1, "f $\\left( x$ g $y^a^b$ h $ok$"), (2, "none")], "id long, text string")
    fixed, report = D.repaired(broken, "id", "text", D.math_spans_col("text"), D.formula_errors_col, D.formula_col, lambda q: q.select("id", "ord", F.lit("(x").alias("value")))
    assert {r["id"]: r.text for r in fixed.collect()}[1] == "f $(x$ g $y^a^b$ h $ok$"
    assert [r.how for r in report.collect()] == ["repaired"]


def test_translate(spark):
    df = spark.createDataFrame([(1, "# Head\n\nHello `x` world [a](https://b.c).\n"), (2, "`only`")], "id long, text string")
    shout = lambda q: q.select("id", "ord", F.concat(F.lit("译"), "source").alias("target"))
    done, left = D.translate(df, "id", "text", "zh", shout)
    got = {r["id"]: r.translated for r in done.collect()}
    assert "`x`" in got[1] and "[a](https://b.c)" in got[1] and got[1].count("译") == 2 and got[2] == "`only`" and left.isEmpty()
    done, left = D.translate(df, "id", "text", "zh", lambda q: q.select("id", "ord", F.lit("").alias("target")), rounds=2)
    assert left.count() == 2 and "Hello `x` world" in {r["id"]: r.translated for r in done.collect()}[1]


def test_groups_and_images(spark):
    nodes = spark.createDataFrame([(1, i, f"text {i}") for i in range(6)], "id long, ord int, content string")
    groups = D.grouped(nodes, "id", 120)
    assert groups.count() > 1 and all(len(r.text) <= 120 for r in groups.collect())
    back = D.ungrouped(groups.where("group = 0").withColumn("text", F.replace("text", F.lit("text"), F.lit("TEXT"))), "id", nodes)
    assert {r.ord: r.content for r in back.collect()} == {i: (f"TEXT {i}" if i < 2 else f"text {i}") for i in range(6)}
    docs = spark.createDataFrame([(1, "![a](img/x.png) ![b](img/none.png)"), (2, "z")], "id long, text string")
    images = spark.createDataFrame([("img/x.png", "image/png", bytearray(b"\x01\x02"))], "path string, mime string, content binary")
    whole = D.embedded(docs, "id", "text", images)
    assert {r["id"]: r.text for r in whole.collect()}[1] == "![a](data:image/png;base64,AQI=) ![b](img/none.png)"
    texts, files = D.unpacked(whole, "id", "text")
    name = files.first()["name"]
    assert files.count() == 1 and {r["id"]: r.text for r in texts.collect()}[1] == f"![a]({name}) ![b](img/none.png)"
    assert {(r.path, r.status) for r in D.image_inventory(docs, "id", "text", images).collect()} == {("img/x.png", "available"), ("img/none.png", "missing")}


@pytest.mark.parametrize("most", [1, 7, 50])
def test_long_texts_split_at_ends(most):
    text = "One. Two, three; four! Five? " * 5
    parts = M.split_long(text, most)
    assert "".join(parts) == text and (most < 50 or all(len(p) <= most for p in parts))


def test_numbers_that_share_a_mark():
    assert M.fix_links("1-555-123-4567 1-555-123-4568 1-555-123-4569") == "<tel:1-555-123-4567> <tel:1-555-123-4568> <tel:1-555-123-4569>"
    assert M.fix_links("1-555-123-4567 1-555-123-4568 1-555-123-4569", apart=True) == "<tel:1-555-123-4567> 1-555-123-4568 <tel:1-555-123-4569>"
    assert M.fix_links("1-555-123-4567  1-555-123-4568", apart=True) == "<tel:1-555-123-4567>  <tel:1-555-123-4568>"


ADDRESSED = ["fix_links", "fix_pipeline", "fix_pipeline_aggressive", "translated"]


@pytest.mark.parametrize("name", ADDRESSED)
def test_neighbouring_addresses_as_in_sql(spark, tmp_path, name):
    import duckdb

    from paperloom import queries_docs  # noqa: F401
    from paperloom.queries import QUERIES, SQL

    tel, mail = "+1 (436) 555-1138", "ab.12@mail3.example.com"
    texts = [f"of {tel} {tel} {tel} 4678592399679231 is", f"{tel}\n{tel}", f"{mail} {mail} {tel}. {tel}!", f"ße {tel} 4984250489669 {tel}", f"1{tel} {tel},{tel} and", "$$$ of$$$", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.connect().execute(SQL[name].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_words_of_marked_texts_as_in_sql(spark, tmp_path):
    import duckdb

    from paperloom.queries import QUERIES, SQL

    texts = ["$$$ of$$$", "`is`", "<the>", "https://a.b", "\\(x\\) 1", "__PH_CODE_000001__", "$1$ 2", "…", "é", "12 3.", "", None, "```\na\n```", "\\[x\\]"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.connect().execute(SQL["translation_kinds"].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, QUERIES["translation_kinds"](spark, str(tmp_path)).collect())) == sorted(want)
