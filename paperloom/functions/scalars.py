"""Scalar functions as native column expressions: identifiers, dates, venues, names, text clean-up.

Every function takes and returns columns and stays inside whole-stage code generation.  Regular expressions that must
follow Unicode white space or case say so with ``(?U)`` and ``(?iu)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MONTHS = {
    "january": "01", "february": "02", "march": "03", "april": "04", "may": "05", "june": "06",
    "july": "07", "august": "08", "september": "09", "october": "10", "november": "11", "december": "12",
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "jun": "06", "jul": "07",
    "aug": "08", "sep": "09", "sept": "09", "oct": "10", "nov": "11", "dec": "12",
}
YEAR = r"(19|20)\d{2}"
#: Han (with extension A and compatibility), kana, Hangul syllables.
CJK = r"㐀-䶿一-鿿豈-﫿぀-ゟ゠-ヿ가-힯"
CJK_PUNCTUATION = "，。、《》、；：！？（）【】「」『』·…—"
JOURNAL_NOISE = (
    r"\([^)]*\)", r"(?i)vol\.\s*\d+", r"(?i)volume\s*\d+", r"(?i)no\.\s*\d+", r"(?i)number\s*\d+",
    r"(?i)pp\.\s*\d+[-–]\d+", r"(?i)pages\s*\d+[-–]\d+", r"\b(19|20)\d{2}\b", r"[,:.;]+\s*$",
)
CONFERENCE_NOISE = (
    r"\b(19|20)\d{2}\b", r"(?i)\b\d+(st|nd|rd|th)\b", r"(?i)proceedings\s+of\s+the\s+",
    r"(?i)proceedings\s+of\s+", r"[,:.;]+\s*$",
)
JOURNAL_WORDS = ("journal", "transactions", "letters", "review")
CONFERENCE_WORDS = ("conference", "proceedings", "symposium", "workshop", "meeting")


def blank(c: Column) -> Column:
    """Null or nothing but white space: "missing" in every sense the data knows."""
    return F.coalesce(strip(c) == "", F.lit(True))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def one_spaced(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def or_null(c: Column) -> Column:
    return F.when(c != "", c)


def matched(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null, not the empty string, where nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def without(c: Column, patterns: Sequence[str]) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


# Identifiers


def url_decoded(c: Column) -> Column:
    """Percent-decoding that keeps ``+`` and leaves undecodable input as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def canonical_doi(c: Column) -> Column:
    bare = strip(F.regexp_replace(url_decoded(strip(c)), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))
    return or_null(F.regexp_replace(F.lower(bare), r"[.,;)]+$", ""))


def canonical_arxiv(c: Column) -> Column:
    bare = strip(F.regexp_replace(strip(c), r"(?i)^(?:https?://arxiv\.org/abs/|arxiv:\s*)", ""))
    return or_null(F.regexp_replace(F.lower(bare), r"v\d+$", ""))


def doi_in_bibtex(raw: Column) -> Column:
    return canonical_doi(matched(raw, r"(?i)\bdoi\s*=\s*[{\"]?([^}\",\n]+)", 1))


def paper_id(key: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("v1|"), key), 256), 1, 32)


def fingerprint_json(authors: Column, title: Column, venue: Column, year: Column) -> Column:
    """Compact JSON with sorted keys; every field is present."""
    some = lambda c: F.coalesce(c, F.lit(""))
    people = F.coalesce(authors, F.array().cast("array<string>"))
    return F.to_json(F.struct(people.alias("authors"), some(title).alias("title"), some(venue).alias("venue"), some(year).alias("year")))


def fingerprint_key(fingerprint: Column) -> Column:
    return F.concat(F.lit("meta:"), F.sha2(fingerprint, 256))


def key_candidates(doi: Column, arxiv: Column, bib_key: Column, fingerprint: Column) -> Column:
    """Array of (strength, key_type, paper_key), strongest first; the metadata key is always there."""
    one = lambda n, kind, key: F.struct(F.lit(n).alias("strength"), F.lit(kind).alias("key_type"), key.alias("paper_key"))
    prefixed = lambda p, c: F.concat(F.lit(p), c)
    listed = F.array(one(4, "doi", prefixed("doi:", canonical_doi(doi))), one(3, "arxiv", prefixed("arxiv:", canonical_arxiv(arxiv))), one(2, "bib", prefixed("bib:", or_null(strip(bib_key)))), one(1, "meta", fingerprint_key(fingerprint)))
    return F.filter(listed, lambda x: x.paper_key.isNotNull())


def short_hash(c: Column) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, 8)


# Dates


def year_of(c: Column) -> Column:
    return matched(c, YEAR)


def month_token(c: Column) -> Column:
    """'3', '03', 'mar', 'March' -> '03'; anything else null."""
    low = F.lower(strip(c))
    number = low.try_cast("int")
    digits = F.when(low.rlike(r"^\d+$") & number.between(1, 12), F.lpad(number.cast("string"), 2, "0"))
    return F.coalesce(digits, _lookup(low, MONTHS))


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def month_of(c: Column) -> Column:
    """From year-month numbers if there are any (null if the month is none), else from the first month word."""
    numeric = matched(c, YEAR + r"[-/](\d{1,2})", 2)
    words = "|".join(sorted(MONTHS, key=lambda w: (-len(w), w)))
    return F.when(numeric.isNotNull(), month_token(numeric)).otherwise(_lookup(matched(F.lower(c), rf"\b({words})\b", 1), MONTHS))


def publication_year(bib_year: Column, date: Column) -> Column:
    return F.coalesce(F.when(bib_year.rlike(r"^\d+$"), bib_year.try_cast("int")), year_of(date).cast("int"))


def leading_int(c: Column) -> Column:
    """The integer at the start of a text, 0 if there is none."""
    return F.coalesce(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def is_year(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9]{4}$"), F.lit(False))


def is_month(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-1][0-9]$"), F.lit(False))


# Venues, names, tags


def _cleaned_name(c: Column, noise: Sequence[str]) -> Column:
    text = F.translate(one_spaced(without(F.coalesce(c, F.lit("")), noise)), "{}", "")
    return F.when(text == "", "Unknown").otherwise(text)


def clean_journal(c: Column) -> Column:
    return _cleaned_name(c, JOURNAL_NOISE)


def clean_conference(c: Column) -> Column:
    return _cleaned_name(c, CONFERENCE_NOISE)


def venue_class(c: Column) -> Column:
    has = lambda words: F.lower(c).rlike("|".join(words))
    return F.when(F.coalesce(c, F.lit("")) == "", "unknown").when(has(JOURNAL_WORDS), "journal").when(has(CONFERENCE_WORDS), "conference").otherwise("other")


def venue_of(bib_type: Column, journal: Column, booktitle: Column, venue: Column) -> Column:
    kind = F.lower(bib_type)
    in_journal, in_book = (kind == "article") & (journal != ""), kind.isin("inproceedings", "conference", "proceedings") & (booktitle != "")
    return F.when(in_journal, journal).when(in_book, booktitle).otherwise(F.coalesce(venue, F.lit("")))


def display_venue(c: Column) -> Column:
    return one_spaced(F.regexp_replace(c, r"\{\{|\}\}", ""))


def facet_value(c: Column) -> Column:
    return one_spaced(F.lower(F.coalesce(c, F.lit(""))))


def listed(c: Column, separators: str = ",") -> Column:
    """Parts of a separated string, trimmed, without empty ones; null gives an empty array."""
    parts = F.split(F.coalesce(c, F.lit("")), f"[{separators}]")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def meta_names(names: Column) -> Column:
    """Lower-cased, single-spaced names in order; empty ones go."""
    return F.sort_array(F.filter(F.transform(names, lambda x: one_spaced(F.lower(x))), lambda x: x != ""))


def author_key(c: Column) -> Column:
    """Last word of what stands before the first comma, without 'et al'."""
    low = F.regexp_replace(F.lower(c), r"et al\.?", "")
    words = strip(F.regexp_replace(F.substring_index(low, ",", 1), r"[^a-z0-9]+", " "))
    return F.substring_index(words, " ", -1)


def template_tag(c: Column) -> Column:
    tag = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"[^a-z0-9_-]+", "_")
    tag = F.regexp_replace(F.regexp_replace(tag, r"_+", "_"), r"^_+|_+$", "")
    return F.when(tag == "", "default").otherwise(tag)


def safe_name(c: Column, most: int | None = None) -> Column:
    text = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"[\\/:*?\"<>|]+", "_")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", "_"), r"_+", "_"), r"^_+|_+$", "")
    if most:
        text = F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(F.substring(text, 1, most), r"_+$", ""))
    return text


def folder_name(author: Column, year: Column, title: Column, ident: Column) -> Column:
    part = lambda c, other, most: F.coalesce(or_null(safe_name(c, most)), F.lit(other))
    a, y, t = part(author, "unknown", 32), part(year, "unknown", None), part(title, "untitled", 80)
    full = safe_name(F.concat(a, F.lit("_"), y, F.lit("_"), t, F.lit("__"), ident))
    return F.when(F.length(full) > 200, safe_name(F.concat(a, F.lit("_"), y, F.lit("__"), ident))).otherwise(full)


# File names


def file_base(name: Column) -> Column:
    """Without ``.md``, a hash after ``.pdf-`` and ``.pdf``."""
    base = F.regexp_replace(name, r"(?i)\.md$", "")
    return F.regexp_replace(F.regexp_replace(base, r"(?i)(\.pdf)-[0-9a-f\-]{8,}$", "$1"), r"(?i)\.pdf$", "")


def file_title(name: Column) -> Column:
    base = strip(F.replace(file_base(name), F.lit("_"), F.lit(" ")))
    return strip(F.coalesce(matched(base, r"^\s*\d{4}\s*-\s*(.+)$", 1), matched(base, r"^\s*.+?\s*-\s*\d{4}\s*-\s*(.+)$", 1), base))


def file_year(name: Column) -> Column:
    return matched(file_base(name), r"^\s*(?:.+?\s*-\s*)?((?:19|20)\d{2})\s*-\s*", 1)


def file_author(name: Column) -> Column:
    return strip(matched(file_base(name), r"^\s*(.+?)\s*-\s*(?:19|20)\d{2}\s*-\s*", 1))


def embedded_title(c: Column, name: Column) -> Column:
    """A title that a PDF carries, without what word processors put before it; null if it says nothing: under three
    characters, or the file's own name."""
    bare = F.regexp_replace(strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\x00"), F.lit(""))), r"(?i)^(?:microsoft\s+word|pdf)\s*-\s*", "")
    text = strip(F.regexp_replace(strip(F.regexp_replace(bare, r"(?i)^untitled\b", "")), r"(?i)\.pdf$", ""))
    stem = strip(F.regexp_replace(name, r"\.[^.]*$", ""))
    return F.when((F.length(text) >= 3) & (F.lower(text) != F.lower(stem)), text)


def is_pdf_like(name: Column) -> Column:
    low = F.lower(name)
    return low.endswith(".pdf") | (low.contains(".pdf-") & ~low.endswith(".md"))


# Text


def shortened(c: Column, most: int) -> Column:
    cut = F.concat(F.regexp_replace(F.substring(c, 1, most - 1), r"(?U)\s+$", ""), F.lit("…"))
    return F.when(F.length(c) > most, cut).otherwise(c)


def untagged(c: Column) -> Column:
    return one_spaced(F.regexp_replace(c, r"<[^>]+>", ""))


def truncated(c: Column, most: int, how: str = "head") -> Column:
    """Struct (text, strategy, original_chars, kept_chars); strategy and what follows are null if nothing was cut."""
    if how not in ("head", "head_tail"):
        raise ValueError(f"unknown strategy {how}")
    head, tail = most // 2, most - most // 2
    cut = F.substring(c, 1, most) if how == "head" else F.concat(F.substring(c, 1, head), F.lit("\n\n...\n\n"), F.right(c, F.lit(tail)))
    long = (F.length(c) > most) if most > 0 else F.lit(False)
    return F.struct(F.when(long, cut).otherwise(c).alias("text"), F.when(long, F.lit(how)).alias("strategy"), F.when(long, F.length(c)).alias("original_chars"), F.when(long, F.lit(most)).alias("kept_chars"))


def cut_with_note(c: Column, most: int) -> Column:
    note = F.concat(F.substring(c, 1, most), F.lit("\n[truncated: "), (F.length(c) - most).cast("string"), F.lit(" more chars]"))
    return F.when(F.length(c) > most, note).otherwise(c)


def cjk_spaced(c: Column) -> Column:
    """A space between any two neighbouring ideographs, kana or syllables."""
    return F.regexp_replace(c, f"(?<=[{CJK}])(?=[{CJK}])", " ")


def cjk_unspaced(c: Column) -> Column:
    return F.regexp_replace(c, f"(?<=[{CJK}]) (?=[{CJK}])", "")


def cjk_runs(c: Column) -> Column:
    """Runs of CJK and runs of anything else, in order."""
    return F.regexp_extract_all(c, F.lit(f"([{CJK}]+|[^{CJK}]+)"), F.lit(1))


def punctuation_spaced(c: Column) -> Column:
    return F.regexp_replace(c, f"[{CJK_PUNCTUATION}]+", " ")


def markers_merged(c: Column, start: str = "[[[", end: str = "]]]") -> Column:
    return F.replace(c, F.lit(end + start), F.lit(""))


def overlaps(a: Column, b: Column, least_chars: int = 24, least_words: int = 4) -> Column:
    """Equal, or the shorter one (long enough to mean something) is inside the longer."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    enough = (F.length(short) >= least_chars) | (F.size(F.split(short, " ")) >= least_words)
    return F.coalesce((a != "") & (b != "") & ((a == b) | (enough & long.contains(short))), F.lit(False))


def compact(title_key: Column) -> Column:
    return F.replace(title_key, F.lit(" "), F.lit(""))


def unnumbered(title_key: Column) -> Column:
    """Without the one- or two-digit words that open a title key."""
    return F.regexp_replace(title_key, r"^(?:\d{1,2}(?: |$))+", "")


def prefix_key(title_key: Column, length: int = 16, least_words: int = 4) -> Column:
    enough = (F.size(F.split(title_key, " ")) >= least_words) & (F.length(compact(title_key)) >= length)
    return F.when(enough, F.substring(compact(title_key), 1, length))


def markdown_images(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"!\[[^\]]*\]\(\s*<?([^)\s>]+)[^)]*\)"), F.lit(1))


def image_counts(c: Column) -> Column:
    """Struct (total, data, http, local) of the Markdown images of a text."""
    links = markdown_images(c)
    n = lambda p: F.size(F.filter(links, p)).cast("long")
    data, http = (lambda x: x.rlike("^(?i)data:")), (lambda x: x.rlike("^(?i)https?://"))
    return F.struct(F.size(links).cast("long").alias("total"), n(data).alias("data"), n(http).alias("http"), n(lambda x: ~data(x) & ~http(x)).alias("local"))


def data_url(c: Column) -> Column:
    """Struct (mime, content) of a base64 data URL; null if it is none."""
    p = r"^data:([^;,]+);base64,([A-Za-z0-9+/=\s]*)$"
    return F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).alias("mime"), F.try_to_binary(F.regexp_replace(F.regexp_extract(c, p, 2), r"\s+", ""), F.lit("base64")).alias("content")))


def json_object_in(c: Column) -> Column:
    """The JSON object inside a reply, fenced or not; null if there is none that parses."""
    found = matched(c, r"(?s)\{.*\}")
    return F.when(F.try_parse_json(found).isNotNull(), found)


def json_place(raw: Column, value: Column, start: Column | None = None) -> Column:
    """Struct (line, offset) of a string value in a JSON text, looked for from ``start`` on: the line it begins in, from 1, and
    the position behind it, from 0.  Where it is not found, line 1 and ``start``."""
    start = F.lit(0) if start is None else start
    quoted = F.to_json(F.array(value))
    inner = F.substr(quoted, F.lit(3), F.length(quoted) - 4)  # without [" and "]
    at = F.position(inner, raw, start + 1)
    line = F.size(F.split(F.substr(raw, F.lit(1), at - 1), "\n"))
    found = at > 0
    return F.struct(F.when(found, line).otherwise(1).cast("int").alias("line"), F.when(found, at - 1 + F.length(inner)).otherwise(start).cast("int").alias("offset"))


def asset_url(base: str, folder: str, name: Column, extension: str, build_id: str | None = None) -> Column:
    tail = f".{extension}" + (f"?v={build_id}" if build_id else "")
    return F.when(~blank(name), F.concat(F.lit(f"{base.rstrip('/')}/{folder}/"), name, F.lit(tail)))


def preferred_template(available: Column, wanted: Column) -> Column:
    """The wanted one, else ``simple``, else ``simple_phi``, else the first in order, else ``default``."""
    tag = template_tag(wanted)
    pick = F.when(F.array_contains(available, tag), tag)
    for name in ("simple", "simple_phi"):
        pick = F.coalesce(pick, F.when(F.array_contains(available, F.lit(name)), F.lit(name)))
    return F.coalesce(pick, F.try_element_at(F.sort_array(available), F.lit(1)), F.lit("default"))


def in_order(available: Column, order: Column) -> Column:
    """``available`` in the declared order, the rest after it, each once."""
    return F.array_distinct(F.concat(F.filter(order, lambda x: F.array_contains(available, x)), available))


def tokens_estimated(chars: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(chars / 4).cast("long"))


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))


def bar(count: Column, most: Column, width: int = 20) -> Column:
    """Of ``#``; at least one for any count above 0, halves rounded to even."""
    size = F.greatest(F.lit(1), F.bround(F.lit(width) * count / most).cast("int"))
    return F.when((count > 0) & (most > 0), F.repeat(F.lit("#"), size)).otherwise("")


def empty_value(c: Column, kind: str = "string") -> Column:
    """Null, a blank string, an empty array or map.  Zero and false are values."""
    if kind in ("array", "map"):
        return c.isNull() | (F.size(c) == 0)
    return blank(c) if kind == "string" else c.isNull()
