"""The two small query languages over the library: search terms with fields, and presence filters."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "author", "tag", "venue", "year", "month")
PRESENCES = ("pdf", "source", "summary", "translated")
# Fixed values.
YES = {"1", "true", "yes", "with", "has"}
NO = {"0", "false", "no", "without"}


@dataclass(frozen=True)
class Term:
    field: str | None
    value: str
    negated: bool = False


def words(text: str) -> list[str]:
    """Split at white space outside double quotes; the quotes go, so a quoted OR or leading minus still acts as one."""
    parts = re.findall(r'((?:"[^"]*(?:"|$)|[^\s"])+)', text or "")
    return [w for w in (p.replace('"', "").strip() for p in parts) if w]


def parse_query(text: str) -> list[list[Term]]:
    """Groups joined by OR, each a list of terms joined by AND; no terms give one empty group, which matches all."""
    groups: list[list[Term]] = [[]]
    for word in words(text):
        if word.upper() == "OR":
            groups.append([])
            continue
        negated, word = word.startswith("-"), word.removeprefix("-").strip()
        name, colon, rest = word.partition(":")
        known = bool(colon) and name.lower() in FIELDS and rest != ""
        value = rest.strip() if known else word
        if value:
            groups[-1].append(Term(name.lower() if known else None, value, negated))
    return [g for g in groups if g] or [[]]


@dataclass(frozen=True)
class Library:
    """Columns of a library: expressions over one DataFrame.  ``authors`` and ``tags`` are string arrays."""

    title: Column
    authors: Column
    tags: Column
    venue: Column
    year: Column
    month: Column


def exact_values(df: DataFrame, lib: Library, groups: list[list[Term]]) -> set[tuple[str, str]]:
    """Which (field, value) of the query occur whole as a tag, author, year or month anywhere: one pass over the table,
    one row per term to the driver.  Such a value is matched whole; any other is searched inside the values."""
    asked = sorted({(t.field, t.value.lower()) for g in groups for t in g if t.field in ("tag", "author", "year", "month")})
    if not asked:
        return set()
    has = {
        "tag": lambda v: F.exists(lib.tags, lambda x: F.lower(F.trim(x)) == v),
        "author": lambda v: F.exists(lib.authors, lambda x: F.lower(F.trim(x)) == v),
        "year": lambda v: F.lower(F.trim(lib.year)) == v,
        "month": lambda v: F.lower(F.trim(lib.month)) == v,
    }
    flags = df.agg(*[F.coalesce(F.bool_or(has[f](v)), F.lit(False)).alias(f"t{i}") for i, (f, v) in enumerate(asked)]).first()
    return {a for a, yes in zip(asked, flags) if yes}


def condition(term: Term, lib: Library, exact: set[tuple[str, str]]) -> Column:
    v = term.value.lower()
    whole = (term.field, v) in exact
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    if term.field is None:
        # the parts are joined by spaces, so a term may span two of them
        found = F.lower(F.concat_ws(" ", lib.title, lib.venue, F.concat_ws(" ", lib.authors), F.concat_ws(" ", lib.tags))).contains(v)
    elif term.field in ("title", "venue"):
        found = text(getattr(lib, term.field)).contains(v)
    elif term.field in ("tag", "author"):
        values = lib.tags if term.field == "tag" else lib.authors
        found = F.exists(values, (lambda x: F.lower(F.trim(x)) == v) if whole else (lambda x: F.lower(x).contains(v)))
    elif term.field == "month":
        found = text(lib.month) == v
    else:
        ends = [p.strip() for p in term.value.split("..", 1)]
        if len(ends) == 2 and all(e.isdigit() for e in ends):
            low, high = sorted(map(int, ends))
            found = F.when(lib.year.rlike(r"^\d+$"), lib.year.try_cast("int").between(low, high))
        else:
            found = (text(lib.year) == v) if whole else text(lib.year).contains(v)
    found = F.coalesce(found, F.lit(False))
    return ~found if term.negated else found


def search(df: DataFrame, query: str, lib: Library) -> DataFrame:
    """Rows that match any group; one filter, whatever the number of terms."""
    groups = parse_query(query)
    exact = exact_values(df, lib, groups)
    return df.where(reduce(or_, [reduce(and_, [condition(t, lib, exact) for t in g], F.lit(True)) for g in groups]))


@dataclass
class Filters:
    """Allowed presences ('with', 'without') by kind, and template tags; an empty set filters nothing."""

    presence: dict[str, set[str]] = field(default_factory=lambda: {k: set() for k in PRESENCES})
    templates: set[str] = field(default_factory=set)


def presence(value: str) -> str | None:
    low = value.strip().lower()
    return "with" if low in YES else "without" if low in NO else None


def parse_filters(text: str) -> Filters:
    """``pdf:yes source:no,yes has:summary no:translated tmpl:a,b``; unknown keys and values are passed over."""
    out = Filters()
    for word in words(text):
        key, colon, value = word.partition(":")
        key, parts = key.strip().lower(), [p.strip().lower() for p in value.split(",") if p.strip()]
        if not colon:
            continue
        if key in ("tmpl", "template"):
            out.templates.update(parts)
        elif key in PRESENCES:
            out.presence[key].update(p for p in map(presence, parts) if p)
        elif key in ("has", "no"):
            for kind in parts:
                if kind in PRESENCES:
                    out.presence[kind].add("with" if key == "has" else "without")
    return out


def allowed(values: Iterable[str]) -> set[str] | None:
    """None, for no filter, if there is no value or both."""
    found = {p for p in map(presence, values) if p}
    return found if len(found) == 1 else None


def merged(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """Both filters together.  Contradicting ones leave an empty set, and that filters nothing, as does none."""
    return a & b if a and b else a or b


def presence_condition(wanted: set[str] | None, present: Column) -> Column:
    if not wanted:
        return F.lit(True)
    return F.lit(False) | (F.lit("with" in wanted) & present) | (F.lit("without" in wanted) & ~present)


def filtered(df: DataFrame, filters: Filters, present: dict[str, Column], templates: Column | None = None) -> DataFrame:
    rules = [presence_condition(merged(None, filters.presence[k] if len(filters.presence[k]) == 1 else None), c) for k, c in present.items()]
    if filters.templates and templates is not None:
        rules.append(F.arrays_overlap(F.transform(templates, F.lower), F.array(*map(F.lit, sorted(filters.templates)))))
    return df.where(reduce(and_, rules, F.lit(True)))


def structured(df: DataFrame, key: str, bridges: dict[str, DataFrame], contains: dict[str, str], venue: tuple[Column, str] | None = None, year: tuple[Column, str] | None = None) -> DataFrame:
    """Rows that, for each given facet, have a bridge row (key, value) whose value contains the text; venue contains,
    year equals.  A semi join for each facet given and none for the others, so no row is doubled."""
    if venue:
        df = df.where(F.lower(venue[0]).contains(venue[1].lower()))
    if year:
        df = df.where(year[0] == year[1])
    for name, text in contains.items():
        hits = bridges[name].where(F.lower("value").contains(text.lower())).select(key)
        df = df.join(hits, key, "left_semi")
    return df


def year_expression(text: str, year: Column) -> Column:
    """``2020``, ``2018-2021``, ``-2019`` or ``2020-``."""
    if m := re.fullmatch(r"\s*(\d{4})?\s*-\s*(\d{4})?\s*", text):
        low, high = m.groups()
        if not (low or high):
            raise ValueError(f"no year in {text!r}")
        return (year >= int(low) if low else F.lit(True)) & (year <= int(high) if high else F.lit(True))
    if not re.fullmatch(r"\s*\d{4}\s*", text):
        raise ValueError(f"no year in {text!r}")
    return year == int(text)


def library_sort(by: str, direction: str, lib: Library, tie: Column) -> list[Column]:
    """Missing values last in both directions; ties follow the direction."""
    way = (lambda c: c.asc()) if direction == "asc" else (lambda c: c.desc())
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    keys = {"year": [number(lib.year), number(lib.month)], "title": [text(lib.title)], "venue": [text(lib.venue)], "author": [text(F.try_element_at(lib.authors, F.lit(1)))]}.get(by, [text(lib.title)])
    missing = keys[0] == (0 if by == "year" else "")
    return [missing.asc(), *map(way, keys), way(tie)]


def search_sort(by: str, title: Column, venue: Column, year: Column) -> list[Column]:
    """Orders of the search service: numeric years before others in both directions, then the title."""
    from paperloom.functions.scalars import is_year, leading_int

    orders = {
        "year_desc": [F.when(is_year(year), 0).otherwise(1), leading_int(year).desc(), F.lower(title)],
        "year_asc": [F.when(is_year(year), 0).otherwise(1), leading_int(year).asc(), F.lower(title)],
        "title_asc": [F.lower(title).asc()],
        "title_desc": [F.lower(title).desc()],
        "venue_asc": [F.lower(venue).asc(), F.lower(title)],
        "venue_desc": [F.lower(venue).desc(), F.lower(title)],
    }
    if by not in orders:
        raise ValueError(f"unknown sort {by}")
    return orders[by]
