"""Calling text generators: templates with stages, prompts, checked replies, keys with cool-down.

A generator is any function from messages to text.  Nothing here needs a network; tests and dry runs use stubs.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from paperloom.plans.workflow import Stage, object_in

Messages = list[dict[str, str]]
# Built-in templates and the fields that their stages fill.
METADATA = ("paper_title", "paper_authors", "publication_date", "publication_venue")
STAGES: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "simple": (),
    "simple_phi": (),
    "deep_read": tuple((f"module_{m}", (f"module_{m}",)) for m in ("a", "b", *[f"c{i}" for i in range(1, 9)], "d", "e", "f", "g", "h")),
    "deep_read_phi": tuple((f"module_m{i}", (f"module_m{i}",)) for i in range(1, 7)),
    "eight_questions": (("questions_1to4", tuple(f"question{i}" for i in range(1, 5))), ("questions_5to8", tuple(f"question{i}" for i in range(5, 9)))),
    "eight_questions_phi": (("questions_1to4", tuple(f"question{i}" for i in range(1, 5))), ("questions_5to8", tuple(f"question{i}" for i in range(5, 9)))),
    "three_pass": (),
}


@dataclass
class Template:
    name: str
    stages: list[Stage] = field(default_factory=list)
    system: str = "Extract the record that the schema describes. Answer with one JSON object."
    user: str = "Schema:\n{schema}\n\nEarlier results:\n{previous}\n\nDocument:\n{content}"
    schema: dict = field(default_factory=dict)
    render: str = "# {paper_title}\n\n{summary}\n"


class Registry:
    """Templates by name; the built-in ones, and any that a caller adds."""

    def __init__(self) -> None:
        self.known = {n: Template(n, [Stage(s, fields) for s, fields in stages]) for n, stages in STAGES.items()}

    def add(self, template: Template) -> None:
        self.known[template.name] = template

    def __getitem__(self, name: str) -> Template:
        if name not in self.known:
            raise ValueError(f"unknown template {name}")
        return self.known[name]

    def names(self) -> list[str]:
        return sorted(self.known)


def markdown_fields(template: str) -> list[str]:
    """The fields of a template's records that hold Markdown: those its stages fill, else the summary and the abstract."""
    return [f for _, fields in STAGES.get(template, ()) for f in fields] or ["summary", "abstract"]


def stage_schema(schema: dict, fields: tuple[str, ...]) -> dict:
    """The part of a schema that one stage must fill, beside the record's metadata."""
    props = schema.get("properties", {})
    wanted = [*METADATA, *fields]
    return {"type": "object", "properties": {k: props.get(k, {"type": "string"}) for k in wanted}, "required": [k for k in wanted if k in fields or k in schema.get("required", [])], "additionalProperties": True}


def messages(template: Template, content: str, stage: Stage | None = None, previous: str = "", language: str = "") -> Messages:
    schema = stage_schema(template.schema, stage.fields) if stage else template.schema
    values = {"schema": json.dumps(schema, ensure_ascii=False), "content": content, "previous": previous or "none"}
    user = template.user
    for k, v in values.items():
        user = user.replace(f"{{{k}}}", v)
    return [{"role": "system", "content": template.system + (f" Output language: {language}." if language else "")}, {"role": "user", "content": user}]


class Exhausted(RuntimeError):
    """A key's quota is used up."""


@dataclass
class Keys:
    """Round-robin over keys; one that failed rests, one without quota rests until its window ends."""

    keys: list[str]
    rest: float = 30.0
    clock: Callable[[], float] = time.time
    until: dict[str, float] = field(default_factory=dict)
    at: int = 0

    def next(self) -> str | None:
        now = self.clock()
        for i in range(len(self.keys)):
            key = self.keys[(self.at + i) % len(self.keys)]
            if self.until.get(key, 0) <= now:
                self.at = (self.at + i + 1) % len(self.keys)
                return key
        return None

    def wait(self) -> float:
        """Seconds until some key may be used."""
        return max(0.0, min((self.until.get(k, 0) for k in self.keys), default=0) - self.clock())

    def failed(self, key: str) -> None:
        self.until[key] = self.clock() + self.rest

    def used_up(self, key: str, reset: float | None) -> None:
        self.until[key] = reset if reset is not None else self.clock() + self.rest


@dataclass
class Throttle:
    """Rests for ``seconds`` after every ``every`` calls."""

    every: int
    seconds: float
    sleep: Callable[[float], None] = time.sleep
    calls: int = 0

    def __post_init__(self) -> None:
        if self.every <= 0 or self.seconds <= 0:
            raise ValueError("every and seconds must be positive")

    def tick(self) -> None:
        self.calls += 1
        if self.calls % self.every == 0:
            self.sleep(self.seconds)


def next_reset(base: datetime, seconds: float, now: datetime) -> float | None:
    """The first end of a quota window after ``now``; windows of equal length follow each other from ``base``."""
    if seconds <= 0:
        return None
    base, now = base.astimezone(timezone.utc), now.astimezone(timezone.utc)
    gone = (now - base).total_seconds()
    return base.timestamp() + (0 if gone <= 0 else (math.floor(gone / seconds) + 1) * seconds)


def pause(attempt: int, base: float = 1.0, most: float = 30.0) -> float:
    return min(most, base * 2 ** max(0, attempt - 1))


def checked_call(generate: Callable[[Messages, str | None], str], asked: Messages, check: Callable[[dict], str | None], keys: Keys | None = None, attempts: int = 3, sleep: Callable[[float], None] = time.sleep, throttle: Throttle | None = None) -> tuple[dict | None, str | None]:
    """(object, error): asks until the reply is a JSON object that ``check`` accepts.  A key without quota costs no attempt."""
    error, tried = None, 0
    while tried < attempts:
        key = keys.next() if keys else None
        if keys and key is None:
            sleep(keys.wait())
            continue
        if throttle:
            throttle.tick()
        try:
            found = object_in(generate(asked, key))
        except Exhausted:
            if not keys:
                raise
            keys.used_up(key, None)
            continue
        except (OSError, ValueError) as problem:
            tried, error = tried + 1, str(problem)
            if keys:
                keys.failed(key)
            sleep(pause(tried))
            continue
        tried += 1
        error = "no object" if found is None else check(found)
        if error is None:
            return found, None
    return None, error


def tags_in(reply: str, most: int = 5) -> list[str]:
    """Up to ``most`` tags of a JSON array in a reply, else of a list separated by commas or line ends."""
    import re

    try:
        listed = json.loads(re.search(r"\[[\s\S]*\]", reply)[0])
    except (TypeError, ValueError):
        listed = re.split(r"[,\n]", reply.strip("[] \n"))
    return [t for t in (str(x).strip().strip("\"'") for x in listed) if t][:most]
