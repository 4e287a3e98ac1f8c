import json
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.functions import rendering as R
from paperloom.plans import export
from paperloom.plans import generation as G


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab`~$\n <>img table/\\", max_size=100))
def test_held_back_parts_come_back(text):
    for pattern, name in ((R.MATH, "MATH"), (R.IMAGE, "IMG"), (R.TABLE, "TABLE")):
        shown, held = R.held_back(text, pattern, name)
        assert R.put_back(shown, held) == text


def test_display_parts():
    text = "a $x$ `$y$`\n```\n$z$\n```\n<img src='http://x'> <img src=\"data:image/png;base64,AA\" alt='q\"'>\n<table onclick=x><tr><td colspan=2>1 < 2<script>bad()</script></table>"
    shown, held = R.display_parts(text)
    assert "`$y$`" in shown and "$z$" in shown and "$x$" not in shown
    assert held["@@MATH_0@@"] == "$x$" and held["@@IMG_0@@"] == "" and held["@@IMG_1@@"] == '<img src="data:image/png;base64,AA" alt="q&quot;" />'
    assert held["@@TABLE_0@@"] == '<table><tr><td colspan="2">1 &lt; 2</td></tr></table>'
    assert R.chosen_template(["a", "simple"], "z") == "simple" and R.chosen_template([], "z") is None and R.chosen_template(["b"], None) == "b"
    assert R.rendered({"t": "T", "l": [1, 2]}, "{t}: {l}{none}") == "T: 1, 2"


def test_templates_and_prompts():
    reg = G.Registry()
    assert len(reg.names()) == 7 and [s.fields for s in reg["eight_questions"].stages][1][0] == "question5"
    with pytest.raises(ValueError):
        reg["none"]
    m = G.messages(reg["deep_read"], "BODY {x}", reg["deep_read"].stages[0], '{"a":1}', "fr")
    assert "module_a" in m[1]["content"] and "BODY {x}" in m[1]["content"] and m[0]["content"].endswith("Output language: fr.")


def test_calls_with_keys():
    now = [0.0]
    keys = G.Keys(["k1", "k2"], rest=10, clock=lambda: now[0])
    used = []

    def generate(asked, key):
        used.append(key)
        if len(used) == 1:
            raise G.Exhausted
        return "junk" if len(used) == 2 else '{"a": 1}'

    slept = []
    got = G.checked_call(generate, [], lambda d: None if "a" in d else "no a", keys, 2, lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    assert got == ({"a": 1}, None) and used == ["k1", "k2", "k2"]
    assert G.checked_call(lambda m, k: "{}", [], lambda d: "no a", attempts=2) == (None, "no a")
    keys.failed("k1")
    keys.failed("k2")
    assert keys.next() is None and keys.wait() == 10
    utc = timezone.utc
    assert G.next_reset(datetime(2024, 1, 1, tzinfo=utc), 3600, datetime(2024, 1, 1, 2, 30, tzinfo=utc)) == datetime(2024, 1, 1, 3, tzinfo=utc).timestamp()
    assert G.next_reset(datetime(2024, 1, 1, tzinfo=utc), 3600, datetime(2023, 1, 1, tzinfo=utc)) == datetime(2024, 1, 1, tzinfo=utc).timestamp()
    assert [G.pause(i) for i in (1, 2, 9)] == [1, 2, 30]
    assert G.tags_in('x ["a", "b c"]') == ["a", "b c"] and G.tags_in("a, b\nc") == ["a", "b", "c"]


def test_files(spark):
    paper = spark.createDataFrame([("p1", "A title", "2020", "V", "deep", "h", None, "10.1/x", 1), ("p2", "B", "2021", "W", "simple", None, "m", None, 2)], "paper_id string, title string, year string, venue string, preferred_summary_template string, pdf_content_hash string, source_md_content_hash string, doi string, paper_index long")
    sums = spark.createDataFrame([("p1", "deep", "d"), ("p1", "simple", "s"), ("p2", "simple", "t")], "paper_id string, template_tag string, text string")
    docs = {r.path: json.loads(r.json) for r in export.summary_documents(paper, sums).collect()}
    assert set(docs) == {"summary/p1/deep.json", "summary/p1/simple.json", "summary/p1.json", "summary/p2/simple.json", "summary/p2.json"}
    assert docs["summary/p1.json"]["summary"] == "d" and docs["summary/p1.json"]["available_templates"] == ["deep", "simple"]
    t = spark.createDataFrame([("p1", "fr", "hf")], "paper_id string, lang string, md_content_hash string")
    a = spark.createDataFrame([("p1", "Lee")], "paper_id string, value string")
    images = spark.createDataFrame([("p1", "i.png", None, "png", "missing"), ("p1", "i.png", "x", "png", "available")], "paper_id string, path string, sha256 string, ext string, status string")
    got = {r.path: json.loads(r.json) for r in export.manifests(paper, a, t, sums, images).collect()}
    one = got["manifest/p1.json"]
    assert one["assets"]["pdf"] == {"static_path": "pdf/h.pdf", "zip_path": "Lee_2020_A_title.pdf", "sha256": "h"} and one["assets"]["source_md"]["static_path"] is None
    assert [i["status"] for i in one["images"]] == ["available"] and one["folder_name"] == "Lee_2020_A_title_p1"
    bib = spark.createDataFrame([("p2", "k")], "paper_id string, bibtex_key string")
    assert {r.paper_id: r.bibtex_key for r in export.index(paper, bib).collect()} == {"p1": None, "p2": "k"}


def test_images_and_fields(spark):
    docs = spark.createDataFrame([(1, "![a](x.png) ![b](http://y/z.png) ![c](no.png)")], "id long, text string")
    files = spark.createDataFrame([("x.png", bytearray(b"1"))], "path string, content binary")
    texts, inventory = export.images_by_content(docs, "id", "text", files)
    rows = {r.status: r.path for r in inventory.collect()}
    assert rows["missing"] == "no.png" and rows["available"] in texts.first().text and "http://y/z.png" in texts.first().text
    fixed, counts = export.fields_fixed(spark.createDataFrame([(1, "see [1]", "x")], "id long, a string, b string"), ["a", "b"])
    assert fixed.first().a == "see [^1]" and {r.field: r.changed for r in counts.collect()} == {"a": 1, "b": 0}
