"""Preparing Markdown for display: math, images and tables as placeholders, HTML that is safe, rendering by template."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

from paperloom.functions.markdown import lines_of
from paperloom.functions.templating import render

# Fixed values.
TABLE_TAGS = {"table", "thead", "tbody", "tfoot", "tr", "th", "td", "caption", "colgroup", "col", "br"}
TABLE_ATTRIBUTES = {"colspan", "rowspan", "align"}
MATH = re.compile(r"(?<!\\)\$\$[\s\S]+?(?<!\\)\$\$|(?<!\\)\$(?!\$)[^$\n]+?(?<!\\)\$")
CODE = re.compile(r"(`+)(?!`)[\s\S]*?(?<!`)\1(?!`)")
IMAGE = re.compile(r"<img\b[^>]*>", re.IGNORECASE)
TABLE = re.compile(r"<table\b[\s\S]*?</table\s*>", re.IGNORECASE)


def outside_code(text: str) -> list[tuple[bool, str]]:
    """(plain, piece): stretches outside and inside fences and inline code; joined, they are the text."""
    out: list[tuple[bool, str]] = []
    at, runs = 0, []
    for line in lines_of(text):
        end = at + len(line.text)
        end += len(re.match(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]|", text[end:])[0])
        if runs and runs[-1][0] == (not line.fenced):
            runs[-1] = (runs[-1][0], runs[-1][1], end)
        else:
            runs.append((not line.fenced, at, end))
        at = end
    for plain, a, b in runs:
        piece = text[a:b]
        if not plain:
            out.append((False, piece))
            continue
        last = 0
        for m in CODE.finditer(piece):
            out += [(True, piece[last : m.start()]), (False, m[0])]
            last = m.end()
        out.append((True, piece[last:]))
    return [(p, s) for p, s in out if s]


def held_back(text: str, pattern: re.Pattern, name: str) -> tuple[str, dict[str, str]]:
    """Matches outside code as ``@@NAME_n@@``."""
    held: dict[str, str] = {}

    def hold(m: re.Match) -> str:
        key = f"@@{name}_{len(held)}@@"
        held[key] = m[0]
        return key

    return "".join(pattern.sub(hold, s) if plain else s for plain, s in outside_code(text)), held


def put_back(text: str, held: dict[str, str]) -> str:
    return re.sub(r"@@[A-Z]+_\d+@@", lambda m: held.get(m[0], m[0]), text)


class _Table(HTMLParser):
    """Keeps table tags and their harmless attributes, closes what is open, and drops scripts with their contents."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.silent += 1
        elif tag in TABLE_TAGS and not self.silent:
            kept = "".join(f' {k}="{html.escape(v or "", quote=True)}"' for k, v in attrs if k in TABLE_ATTRIBUTES)
            self.out.append(f"<{tag}{kept}>")
            if tag not in ("br", "col"):
                self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag in self.open:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(html.escape(data))


def safe_table(raw: str) -> str:
    parser = _Table()
    parser.feed(raw)
    parser.close()
    return "".join(parser.out) + "".join(f"</{t}>" for t in reversed(parser.open))


def safe_image(raw: str) -> str | None:
    """An image whose source is inline base64 data, with its description; any other is dropped."""
    found = {k.lower(): (a or b or c) for k, a, b, c in re.findall(r"(\w+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", raw)}
    src = found.get("src", "")
    if not re.match(r"data:image/[^,]*;base64,", src, re.IGNORECASE):
        return None
    alt = f' alt="{html.escape(found["alt"], quote=True)}"' if found.get("alt") else ""
    return f'<img src="{html.escape(src, quote=True)}"{alt} />'


def display_parts(text: str) -> tuple[str, dict[str, str]]:
    """Text with math, images and tables held back, these in the form in which they may be shown."""
    text, math = held_back(text, MATH, "MATH")
    text, tables = held_back(text, TABLE, "TABLE")
    text, images = held_back(text, IMAGE, "IMG")
    shown = {k: safe_table(v) for k, v in tables.items()} | {k: safe_image(v) or "" for k, v in images.items()}
    return text, math | shown


def chosen_template(available: list[str], asked: str | None, default: str | None = None) -> str | None:
    """The asked one if there is one, else the default, else ``simple``, else the first."""
    if not available:
        return None
    fallback = default or ("simple" if "simple" in available else available[0])
    return asked if asked in available else fallback


def rendered(record: dict, template: str) -> str:
    """A record in a template: see ``templating``.  A template without its marks may name fields as ``{name}``; lists are
    joined by commas there."""
    if "{{" in template or "{%" in template:
        return render(template, record)

    def value(m: re.Match) -> str:
        found = record.get(m[1])
        return ", ".join(map(str, found)) if isinstance(found, list) else "" if found is None else str(found)

    return re.sub(r"\{(\w+)\}", value, template)
