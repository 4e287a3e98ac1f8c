import pytest

from paperloom.functions import templating as T
from paperloom.functions.rendering import rendered
from paperloom.plans.generation import Throttle, checked_call, markdown_fields


@pytest.mark.parametrize(
    "template, record, want",
    [
        ("a {{ x }} b", {"x": 1}, "a 1 b"),
        ("{{ x }}{{ y.z }}{{ y['z'] }}{{ l[1] }}{{ l[9] }}", {"y": {"z": 2}, "l": [3, 4]}, "224"),
        ("{% if a and not b %}yes{% elif c == 'q' %}maybe{% else %}no{% endif %}", {"c": "q"}, "maybe"),
        ("{% if a and not b %}yes{% elif c == 'q' %}maybe{% else %}no{% endif %}", {"a": 1}, "yes"),
        ("{% for x in l %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% else %}none{% endfor %}", {"l": "ab"}, "1a,2b"),
        ("{% for x in l %}{{ x }}{% else %}none{% endfor %}", {}, "none"),
        ("{% set zh = lang == 'zh' %}{{ 'T / 题' if zh else 'T' }}: {{ l | join(', ') }}", {"lang": "zh", "l": ["a", 1]}, "T / 题: a, 1"),
        ("a  {{- x -}}  b {# note #}c\n", {"x": 1}, "a1b c"),
        ("{{ x | default('none') }} {{ n | length }} {{ s | upper | lower | trim }}", {"n": [1, 2], "s": " Ab "}, "none 2 ab"),
        ("{{ 'x' in l }} {{ a + 1 }} {{ s + 1 }}", {"l": ["x"], "a": 2, "s": "t"}, "True 3 t1"),
    ],
)
def test_render(template, record, want):
    assert T.render(template, record) == want
    assert rendered(record, template) == want


@pytest.mark.parametrize("template", ["{% if a %}", "{% endif %}", "{% for x in y %}{% endif %}", "{{ a b }}", "{{ __import__('os') }}", "{{ x.y() }}", "{{ [i for i in x] }}", "{{ x | nothing }}", "{% include 'x' %}"])
def test_refused(template):
    with pytest.raises(T.TemplateError):
        T.render(template, {"x": {}, "y": []})


def test_plain_names():
    assert rendered({"a": [1, 2], "b": None}, "{a}|{b}|{c}") == "1, 2||"


def test_throttle():
    rests, replies = [], iter(["", "", '{"a": 1}'])
    t = Throttle(2, 0.5, rests.append)
    assert checked_call(lambda m, k: next(replies), [], lambda o: None, sleep=lambda s: None, throttle=t)[0] == {"a": 1}
    assert rests == [0.5] and t.calls == 3
    with pytest.raises(ValueError):
        Throttle(0, 1)


def test_fields_of_templates():
    assert markdown_fields("nothing known") == ["summary", "abstract"] and markdown_fields("deep_read")[0] == "module_a" and len(markdown_fields("eight_questions")) == 8
