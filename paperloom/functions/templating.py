"""Record templates: ``{{ value }}``, ``{% if %}``, ``{% for %}``, ``{% set %}`` and comments, as record templates are written.

A template is read once into a tree.  Its expressions are read by Python's own parser, of whose syntax only names, constants,
attributes, items, comparisons, and/or/not, ``a if b else c``, sums and ``value | filter(...)`` are known; nothing is executed.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

MARK = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.DOTALL)
COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.In: lambda a, b: a in (b or ()), ast.NotIn: lambda a, b: a not in (b or ())}
FILTERS: dict[str, Callable] = {
    "join": lambda v, by="": by.join(map(shown, v or ())) if not isinstance(v, str) else by.join(v),
    "default": lambda v, other="", empty=False: other if v is None or (empty and not v) else v,
    "upper": lambda v: shown(v).upper(),
    "lower": lambda v: shown(v).lower(),
    "trim": lambda v: shown(v).strip(),
    "length": lambda v: len(v or ()),
    "first": lambda v: next(iter(v or ()), None),
    "last": lambda v: v[-1] if v else None,
    "replace": lambda v, a, b: shown(v).replace(a, b),
}


class TemplateError(ValueError):
    """A template that cannot be read."""


def shown(value: object) -> str:
    return "" if value is None else str(value)


@dataclass
class Node:
    """``text``, ``value``, ``set``, ``if`` (branches of condition and body) or ``for``."""

    kind: str
    text: str = ""
    name: str = ""
    expression: ast.expr | None = None
    branches: list[tuple[ast.expr | None, list[Node]]] = field(default_factory=list)


def _expression(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as wrong:
        raise TemplateError(f"not an expression: {text.strip()}") from wrong


@cache
def read(template: str) -> list[Node]:
    """The template's tree; an error where a block is not closed, closed twice or unknown."""
    root: list[Node] = []
    opened: list[tuple[Node, list[Node]]] = []
    here, at, cut = root, 0, False
    for m in MARK.finditer(template):
        before = template[at : m.start()]
        before = before.lstrip() if cut else before
        first, last = next((m[i] or "", m[i + 2] or "") for i in (1, 4, 7) if m[i + 1] is not None)
        here.append(Node("text", before.rstrip() if first else before))
        at, cut = m.end(), bool(last)
        if m[2] is not None:
            here.append(Node("value", expression=_expression(m[2])))
        elif m[5] is not None:
            here = _block(m[5].strip(), here, opened)
    if opened:
        raise TemplateError(f"{opened[-1][0].kind} is not closed")
    rest = template[at:]
    here.append(Node("text", (rest.lstrip() if cut else rest).removesuffix("\n")))
    return root


def _block(said: str, here: list[Node], opened: list[tuple[Node, list[Node]]]) -> list[Node]:
    """Takes in one block mark; returns the list that what follows belongs to."""
    word, _, rest = said.partition(" ")
    if word == "set":
        name, _, value = rest.partition("=")
        here.append(Node("set", name=name.strip(), expression=_expression(value)))
        return here
    if word in ("if", "for"):
        name, _, source = rest.partition(" in ") if word == "for" else ("", "", rest)
        node = Node(word, name=name.strip(), branches=[(_expression(source), [])])
        here.append(node)
        opened.append((node, here))
        return node.branches[0][1]
    if not opened:
        raise TemplateError(f"{word} without a beginning")
    node, outer = opened[-1]
    if word in ("elif", "else"):
        node.branches.append((_expression(rest) if word == "elif" else None, []))
        return node.branches[-1][1]
    if word != f"end{node.kind}":
        raise TemplateError(f"unknown block {word}")
    opened.pop()
    return outer


def evaluated(e: ast.expr, names: dict) -> object:
    """The value of an expression; unknown names, attributes and items are null."""
    if isinstance(e, ast.Constant):
        return e.value
    if isinstance(e, ast.Name):
        return {"true": True, "false": False, "none": None}.get(e.id, names.get(e.id))
    if isinstance(e, ast.IfExp):
        return evaluated(e.body if evaluated(e.test, names) else e.orelse, names)
    if isinstance(e, ast.BoolOp):
        value = None
        for part in e.values:
            value = evaluated(part, names)
            if bool(value) == isinstance(e.op, ast.Or):
                break
        return value
    if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not):
        return not evaluated(e.operand, names)
    if isinstance(e, ast.Compare) and all(type(op) in COMPARE for op in e.ops):
        values = [evaluated(x, names) for x in (e.left, *e.comparators)]
        return all(COMPARE[type(op)](a, b) for op, a, b in zip(e.ops, values, values[1:]))
    if isinstance(e, ast.Attribute) or isinstance(e, ast.Subscript):
        of, key = evaluated(e.value, names), e.attr if isinstance(e, ast.Attribute) else evaluated(e.slice, names)
        if isinstance(of, dict):
            return of.get(key)
        return of[key] if isinstance(of, (list, tuple, str)) and isinstance(key, int) and -len(of) <= key < len(of) else None
    if isinstance(e, ast.BinOp) and isinstance(e.op, ast.BitOr):
        name, given = (e.right.func, e.right.args) if isinstance(e.right, ast.Call) else (e.right, [])
        if isinstance(name, ast.Name) and name.id in FILTERS:
            return FILTERS[name.id](evaluated(e.left, names), *[evaluated(x, names) for x in given])
    if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Add):
        a, b = evaluated(e.left, names), evaluated(e.right, names)
        return a + b if isinstance(a, (int, float)) and isinstance(b, (int, float)) else shown(a) + shown(b)
    raise TemplateError(f"not allowed in a template: {ast.unparse(e)}")


def _written(nodes: list[Node], names: dict, out: list[str]) -> None:
    for n in nodes:
        if n.kind == "text":
            out.append(n.text)
        elif n.kind == "value":
            out.append(shown(evaluated(n.expression, names)))
        elif n.kind == "set":
            names[n.name] = evaluated(n.expression, names)
        elif n.kind == "if":
            chosen = next((body for test, body in n.branches if test is None or evaluated(test, names)), [])
            _written(chosen, names, out)
        else:
            items = list(evaluated(n.branches[0][0], names) or ())
            for i, x in enumerate(items):
                loop = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
                _written(n.branches[0][1], {**names, n.name: x, "loop": loop}, out)
            if not items and len(n.branches) > 1:
                _written(n.branches[-1][1], names, out)


def render(template: str, record: dict) -> str:
    """The record in the template.  Missing fields are empty."""
    out: list[str] = []
    _written(read(template), dict(record), out)
    return "".join(out)
