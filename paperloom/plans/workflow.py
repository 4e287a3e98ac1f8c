"""Extraction workflow: stages with dependencies, reuse of earlier results, pluggable text generation."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.plans.storage import keep


@dataclass(frozen=True)
class Stage:
    name: str
    fields: tuple[str, ...] = ()
    depends_on: tuple[str, ...] | None = None  # None: the stage before it
    prompt: str = ""


def dependencies(stages: list[Stage]) -> dict[str, tuple[str, ...]]:
    return {s.name: ((stages[i - 1].name,) if i else ()) if s.depends_on is None else s.depends_on for i, s in enumerate(stages)}


def levels(stages: list[Stage]) -> list[list[str]]:
    """Stages that may run together, level by level, in declared order; unknown stages and circles are errors."""
    needs = dependencies(stages)
    for name, ds in needs.items():
        for d in ds:
            if d not in needs:
                raise ValueError(f"stage {name} depends on unknown stage {d}")
    out: list[list[str]] = []
    done: set[str] = set()
    while len(done) < len(needs):
        ready = [n for n in needs if n not in done and set(needs[n]) <= done]
        if not ready:
            raise ValueError("stages depend on each other in a circle")
        out.append(ready)
        done |= set(ready)
    return out


def prompt_hash(stage: Stage, template: str, schema: dict | None = None) -> str:
    """Of everything that decides a stage's prompt, as JSON with sorted keys."""
    import hashlib

    payload = {"fields": list(stage.fields), "name": stage.name, "prompt": stage.prompt, "schema": schema or {}, "template": template}
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


Generator = Callable[[dict], str]


def echo(request: dict) -> str:
    """The generator for tests and dry runs: JSON with a value for every field asked."""
    return json.dumps({f: f"{request['stage']}:{f}:{len(request['text'])}" for f in request["fields"]})


def object_in(reply: str) -> dict | None:
    """The JSON object in a reply, fenced or not; a missing end is closed; None if there is none."""
    start = reply.find("{")
    if start < 0:
        return None
    body = reply[start : reply.rfind("}") + 1] or reply[start:]
    for candidate in (body, reply[start:].rstrip("` \n") + "}"):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def run_stage(todo: DataFrame, key: str, text: str, stage: Stage, generate: Generator, attempts: int = 3) -> DataFrame:
    """(key, stage, data: JSON or null, error): each document asked up to ``attempts`` times until the reply is an object with
    all the stage's fields."""
    kind = dict(todo.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t, before in zip(pdf[key], pdf[text], pdf["before"]):
                error, data = "", None
                for _ in range(attempts):
                    data = object_in(generate({"stage": stage.name, "fields": stage.fields, "text": t or "", "before": before or "", "prompt": stage.prompt}))
                    gone = [f for f in stage.fields if data is None or f not in data]
                    error = "no object" if data is None else f"missing {', '.join(gone)}" if gone else ""
                    if not error:
                        break
                rows.append((k, stage.name, None if error else json.dumps(data, sort_keys=True, ensure_ascii=False), error or None))
            yield pd.DataFrame(rows, columns=[key, "stage", "data", "error"])

    return todo.select(key, text, "before").mapInPandas(run, f"{key} {kind}, stage string, data string, error string")


@dataclass
class Run:
    state: DataFrame  # key, stage, data, prompt_hash, source_hash
    errors: DataFrame  # key, stage, error
    merged: DataFrame  # key, record: JSON of all stages, later ones win
    asked: dict[str, int] = field(default_factory=dict)


def run_stages(docs: DataFrame, key: str, text: str, stages: list[Stage], generate: Generator, template: str = "simple", state: DataFrame | None = None, force: bool = False) -> Run:
    """All stages, level by level.  A stage is not asked again for a document whose text and prompt are what they were;
    a stage whose dependencies failed for a document is not asked for it."""
    needs, by_name = dependencies(stages), {s.name: s for s in stages}
    base = keep(docs.select(key, text, F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("source_hash")), "workflow")
    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, stage string, data string, prompt_hash string, source_hash string"
    known = state if state is not None else docs.sparkSession.createDataFrame([], schema)
    errors = docs.sparkSession.createDataFrame([], f"{key} {kind}, stage string, error string")
    asked: dict[str, int] = {}
    done = docs.sparkSession.createDataFrame([], schema)
    for level in levels(stages):
        for name in level:
            stage = by_name[name]
            mark = prompt_hash(stage, template)
            reusable = known.where((F.col("stage") == name) & (F.col("prompt_hash") == mark) & F.col("data").isNotNull() & F.lit(not force)).join(base.select(key, "source_hash"), [key, "source_hash"], "left_semi")
            todo = base.join(reusable.select(key), key, "left_anti")
            before = F.lit("")
            if needs[name]:
                ready = done.where(F.col("stage").isin(*needs[name])).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "data"))))).alias("before"))
                todo = todo.join(ready.where(F.col("n") == len(set(needs[name]))), key)
                before = F.col("before")
            found = keep(run_stage(todo.withColumn("before", before), key, text, stage, generate), "stage")
            asked[name] = found.count()
            good = found.where("data IS NOT NULL").join(base.select(key, "source_hash"), key).select(key, "stage", "data", F.lit(mark).alias("prompt_hash"), "source_hash")
            done = keep(done.unionByName(good).unionByName(reusable.select(*done.columns)), "state")
            errors = errors.unionByName(found.where("error IS NOT NULL").select(key, "stage", "error"))
    order = F.create_map(*[F.lit(x) for i, s in enumerate(stages) for x in (s.name, i)])
    listed = done.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order[F.col("stage")].alias("i"), "data"))).alias("d"))
    # later stages win: read from the last to the first, the first of equal keys stays
    pairs = F.flatten(F.transform(F.reverse("d"), lambda x: F.map_entries(F.from_json(x["data"], "map<string,string>"))))
    keys = F.array_distinct(F.transform(pairs, lambda e: e.key))
    record = F.map_from_entries(F.array_sort(F.transform(keys, lambda k: F.struct(k.alias("key"), F.filter(pairs, lambda e: e.key == k)[0].value.alias("value")))))
    return Run(done, errors, listed.select(key, F.to_json(record).alias("record")), asked)


def changed(docs: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Documents whose path and content are not both as they were."""
    return docs.join(known.select(*keys), keys, "left_anti")


def dry_run(docs: DataFrame, text: str) -> DataFrame:
    """One row: documents, characters, tokens as estimated."""
    from paperloom.functions.scalars import tokens_estimated

    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(n), F.lit(0)).alias("chars"), F.coalesce(F.sum(tokens_estimated(n)), F.lit(0)).alias("tokens"))


def empty_fields(df: DataFrame, key: str, required: dict[str, str]) -> DataFrame:
    """(key, missing): the required fields (name -> kind) that a record leaves empty; complete records are not listed."""
    from paperloom.functions.scalars import empty_value

    gone = F.array_compact(F.array(*[F.when(empty_value(F.col(c), kind), F.lit(c)) for c, kind in required.items()]))
    return df.select(key, gone.alias("missing")).where(F.size("missing") > 0)


def empty_histogram(found: DataFrame) -> DataFrame:
    """(field, n), most frequent first, then by name."""
    return found.select(F.explode("missing").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "field")
