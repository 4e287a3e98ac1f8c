"""Is a translation sound?  Placeholders, scripts, identifiers and names."""

from __future__ import annotations

import difflib
import re
from collections import Counter

# Placeholders, scripts, parts of names, marks of identifiers, and the marks between which nothing is translated.
PLACEHOLDER = re.compile(r"__PH_[A-Z0-9_]+_\d{6}__")
LOOSE_PLACEHOLDER = re.compile(r"_{1,3}\s*PH[\s_]+([A-Za-z0-9]+)[\s_]+(\d{6})\s*_{0,3}", re.IGNORECASE)
SCRIPTS = {"zh": r"[一-鿿]", "ja": r"[぀-ヿ一-鿿]", "jp": r"[぀-ヿ一-鿿]", "en": r"[A-Za-z]"}
PARTICLES = {"van", "von", "de", "del", "der", "da", "di", "la", "le", "du", "al", "bin", "ibn", "dos", "das", "mac", "mc"}
SUFFIXES = {"jr", "sr", "ii", "iii", "iv"}
REGISTRIES = {"isbn", "issn", "doi", "arxiv", "acm", "ieee"}
FILE_KINDS = {"pdf", "png", "jpg", "jpeg", "gif", "svg", "tex", "bib", "csv", "json", "md"}
MARKS = (("```", "```"), ("$$", "$$"), ("\\(", "\\)"), ("\\[", "\\]"), ("`", "`"), ("$", "$"), ("<", ">"))
#: Marks whose content is at most one line, and may not be empty.
IN_LINE = {"`", "$"}


def plain(text: str) -> str:
    """What is left to be translated: no placeholders, formulas, code, tags and addresses.  One walk over the text; where a mark
    opens, it goes on behind the one that closes, if there is one."""
    out, at = [], 0
    starts = re.compile("|".join([PLACEHOLDER.pattern, r"https?://\S+", *[re.escape(a) for a, _ in MARKS]]))
    while m := starts.search(text, at):
        end, closing = m.end(), dict(MARKS).get(m[0])
        if closing:
            found = text.find(closing, m.end())
            inside = text[m.end() : found]
            end = found + len(closing)
            if found < 0 or (m[0] in IN_LINE and "\n" in inside) or (m[0] in ("$", "<") and not inside):
                out.append(text[at : m.start() + 1])
                at = m.start() + 1
                continue
        out.append(text[at : m.start()])
        at = end
    return "".join([*out, text[at:]])


def core(text: str) -> str:
    """Letters and digits of what a translator would have to translate."""
    return "".join(c for c in plain(text) if c.isalnum())


def has_letters(text: str) -> bool:
    return any(map(str.isalpha, core(text)))


def in_script(text: str, lang: str) -> bool:
    pattern = SCRIPTS.get((lang or "").lower()[:2])
    return pattern is None or re.search(pattern, text) is not None


def is_identifier(text: str) -> bool:
    """What stays the same in any language: codes, file names, up to six acronyms, two Latin words if they are short, or hardly
    anything beside placeholders."""
    t = text.strip()
    if not t:
        return False
    marked = {w.lower() for w in re.findall(r"\w+", t)} & REGISTRIES
    files = {w.rpartition(".")[2].lower() for w in re.findall(r"\S\.\w+\b", t)} & FILE_KINDS
    words = re.findall(r"[A-Za-z]+", t)
    frozen = "__PH_" in t and len(core(t)) <= 2
    allowed = max(6 if t == t.upper() else 0, 2 if len(t) <= 24 else 0)
    return bool(marked or files or frozen or len(words) <= allowed)


#: A name by the kinds of its words: capitalised ones or initials, of which there are two at least, particles and suffixes.
NAME = re.compile(r"(?=(?:[ps]*N){2})[Nps]{2,6}")
CAPITALISED = re.compile(r"[A-Z](?:[A-Za-z]+(?:[-'][A-Za-z]+)*)?\.?")


def is_person(text: str) -> bool:
    """Two to six words of a name in at most 80 characters; marks of footnotes at the words are no part of it."""

    def kind(word: str) -> str:
        return "p" if word.lower() in PARTICLES else "s" if word.lower() in SUFFIXES else "N" if CAPITALISED.fullmatch(word) else "x"

    bare = re.sub(r"[,;:*†‡()\[\]{}]|(?<=\S)\d+(?=[\s,;:*†‡.()\[\]{}]|$)", " ", text)
    words = [w.strip(".") + "." * (len(w.strip(".")) == 1 and w.endswith(".")) for w in bare.split()]
    return len(text.strip()) <= 80 and NAME.fullmatch("".join(kind(w) for w in words if w.strip("."))) is not None


def likeness(source: str, target: str) -> float:
    """How much of the plain source stands in the plain target, blanks aside."""
    a, b = (" ".join(plain(x).split()) for x in (source, target))
    return difflib.SequenceMatcher(None, a, b).ratio()


def failure(source: str, target: str | None, lang: str) -> str | None:
    """Why a translation is refused; None if it is not.  It must hold the source's placeholders, as often as that does, and must
    not be empty.  If there is anything to translate, it must differ from the source, be in the language's script, or be of
    what stays the same in any language."""
    given = target or ""
    empty, worded = not given.strip(), has_letters(source)
    if Counter(PLACEHOLDER.findall(given)) != Counter(PLACEHOLDER.findall(source)):
        return "placeholders_mismatch"
    if empty:
        return "empty_output" if worded else "placeholder_only_empty"
    if not worded or in_script(given, lang):
        return None
    alike = likeness(source, given)
    return f"missing_target_script ratio={alike:.2f}" if alike >= 0.92 and not (is_identifier(source) or is_person(source)) else None


def typos_fixed(text: str, valid: set[str]) -> str:
    """Placeholders that came back with other case, spaces or underscores."""

    def fixed(m: re.Match) -> str:
        name = f"__PH_{m[1].upper()}_{m[2]}__"
        return name if name in valid else m[0]

    return LOOSE_PLACEHOLDER.sub(fixed, text)


def realigned(source: str, target: str) -> str:
    """The source's placeholders in the target's places, one after the other; those without a place go to the end, and places
    without one are closed."""
    supply = iter(PLACEHOLDER.findall(source))
    filled = PLACEHOLDER.sub(lambda _: next(supply, ""), target)
    rest = " ".join(supply)
    gap = " " if rest and filled and not filled.endswith((" ", "\n")) else ""
    return f"{filled}{gap}{rest}"
