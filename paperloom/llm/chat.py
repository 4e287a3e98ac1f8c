"""Tool-call linking: calls meet results by identifier, get a topological order, and leave as canonical JSON lines."""

from __future__ import annotations

import json
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import keep, map_texts, new_folder

#: Tools by name, each with the JSON schema of its arguments.
REPLY_TOOLS = {
    "reply": {
        "type": "object",
        "required": ["prompt", "turn"],
        "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 1000}, "turn": {"type": "integer", "minimum": 0}},
    }
}
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
LINE = "conv_id long, turn long, kind string, call_id string, linked_turn long, ready long, hops long, valid boolean, problem string, line string"


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, characters as they are; numbers that are whole are written as integers.  Halves of
    surrogate pairs, which UTF-8 cannot hold, stay escaped."""
    text = json.dumps(_plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def parsed(body: str) -> object:
    """The value of a JSON text.  ValueError, with what is wrong, for what JSON does not allow and what cannot be kept exact:
    numbers beyond doubles or over 4,300 digits, and nesting deeper than the interpreter's stack."""

    def finite(digits: str) -> float:
        value = float(digits)
        if not math.isfinite(value):
            raise OverflowError
        return value

    def constant(name: str) -> object:
        raise json.JSONDecodeError(name, body, 0)

    try:
        return json.loads(body, parse_float=finite, parse_constant=constant)
    except json.JSONDecodeError:
        raise ValueError("not JSON") from None
    except RecursionError:
        raise ValueError("too deep") from None
    except (OverflowError, ValueError):  # json gives up on very long integers with a plain ValueError
        raise ValueError("number too large") from None


def _plain(value: object) -> object:
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, float):
        return None if not math.isfinite(value) else int(value) if value.is_integer() and abs(value) < 2**53 else value
    return value


def invalid(value: object, schema: dict, at: str = "") -> str | None:
    """The first thing in ``value`` that the schema forbids, as path and keyword; None if there is none.  Keywords: type,
    enum, required, properties, additionalProperties, items, minLength, maxLength, minimum, maximum, minItems, maxItems."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at or '/'} type"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at or '/'} enum"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", []):
            if k not in value:
                return f"{at}/{k} required"
        for k in sorted(value):
            if k in known:
                if found := invalid(value[k], known[k], f"{at}/{k}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{at}/{k} additionalProperties"
    sized = {"minLength": str, "maxLength": str, "minItems": list, "maxItems": list}
    for word, kind in sized.items():
        if word in schema and isinstance(value, kind) and (len(value) < schema[word] if word[:3] == "min" else len(value) > schema[word]):
            return f"{at or '/'} {word}"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            return f"{at or '/'} minimum"
        if "maximum" in schema and value > schema["maximum"]:
            return f"{at or '/'} maximum"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := invalid(x, schema["items"], f"{at}/{i}"):
                return found
    return None


def _is(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, KINDS[kind])


def turns_as_tools(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations as tool traffic: a user's turn calls ``reply`` under the identifier conv:turn, an
    assistant's turn is the result of the turn before it, others are messages.  A call needs the call of two turns before
    or, in conversations of odd numbers, as in logs that were written backwards, of two turns after; there, calls must be put
    in order."""
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    user, assistant, t = F.col("role") == "user", F.col("role") == "assistant", F.col("turn")
    arguments = F.to_json(F.struct(t.alias("turn"), F.col("text").alias("prompt")))
    other = F.when(F.col("conv_id") % 2 != 0, name(t + 2)).when(t >= 2, name(t - 2))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        F.when(user, name(t)).when(assistant, name(t - 1)).alias("call_id"),
        F.when(user, F.lit("reply")).otherwise(F.col("role")).alias("name"),
        F.when(user, arguments).otherwise(F.col("text")).alias("body"),
        F.when(user, F.array_compact(F.array(other))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )


#: Needs of a conversation that are ordered in one go; a conversation of more is ordered round by round, in many tasks.
AT_ONCE = 100_000


def ordered(messages: DataFrame, owners: DataFrame) -> DataFrame:
    """(conv_id, call_id, ready, hops) for the calls that must come later than their turn says, or that never can (hops
    null).  Sorting a conversation by ready, hops, turn is a topological order: every call after the results it needs.

    A need that was met in an earlier turn asks for nothing.  The others push their calls back, and those push the calls that
    need them; ``ready`` is the last turn that any of them waits for.  Then the pushed calls are taken in layers, each when
    all calls that push it are taken: its layer is its hops.  What no layer takes is in a circle, or is pushed by one.

    Only conversations with a need that is met too late take part.  Those of up to AT_ONCE needs are ordered one by one, by
    their identifiers and turns alone; larger ones together, by joins, in as many rounds as their longest chain.
    """
    met = owners.select("conv_id", F.col("call_id").alias("need"), F.coalesce("result_turn", "call_turn").alias("met"))
    edges = messages.where("kind = 'call'").select("conv_id", "call_id", "turn", F.explode("needs").alias("need")).distinct()
    edges = keep(edges.join(met, ["conv_id", "need"]).select("conv_id", "call_id", "turn", "need", "met"), "needs")
    sizes = edges.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("met") >= F.col("turn")).alias("late"))
    late = keep(sizes.where("late").select("conv_id", "n"), "late")
    if late.isEmpty():
        return edges.select("conv_id", "call_id", F.col("met").alias("ready"), F.lit(None).cast("long").alias("hops")).where("false")
    taking_part = edges.join(late, "conv_id")
    large = taking_part.where(F.col("n") > AT_ONCE).drop("n")
    # identifiers as bytes, so that those which are not UTF-8 pass as they are
    named = ["conv_id", F.col("call_id").cast("binary").alias("call_id"), "turn", F.col("need").cast("binary").alias("need"), "met"]
    whole = taking_part.where(F.col("n") <= AT_ONCE).select(*named).repartition("conv_id").sortWithinPartitions("conv_id")
    found = whole.mapInArrow(_in_order, "conv_id long, call_id binary, ready long, hops long").withColumn("call_id", F.col("call_id").cast("string"))
    return found if late.where(F.col("n") > AT_ONCE).isEmpty() else found.unionByName(_by_rounds(keep(large, "large")))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Needs (conv_id, call_id, turn, need, met) in order of conversation -> the pushed calls of each."""
    columns, types = ["conv_id", "call_id", "ready", "hops"], [pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], columns)

    here, needs, rows = None, [], []
    for batch in batches:
        for conv, *need in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != here:
                rows += [(here, *x) for x in _settled(needs)]
                here, needs = conv, []
                if len(rows) > 20_000:
                    yield out(rows)
                    rows = []
            needs.append(need)
    rows += [(here, *x) for x in _settled(needs)]
    if rows:
        yield out(rows)


def _settled(needs: list[list]) -> Iterator[tuple[bytes, int, int | None]]:
    """One conversation's needs [call_id, turn, need, met] -> (call_id, ready, hops) of its pushed calls."""
    by_need: dict[bytes, list[tuple[bytes, int]]] = {}
    ready: dict[bytes, int] = {}
    for call, turn, need, met in needs:
        by_need.setdefault(need, []).append((call, turn))
        if met >= turn:
            ready[call] = max(met, ready.get(call, met))
    # the latest first: what it pushes waits for it, and for nothing later
    latest, done = [(-r, c) for c, r in ready.items()], set()
    heapify(latest)
    while latest:
        r, now = heappop(latest)
        if now in done:
            continue
        done.add(now)
        for call, turn in by_need.get(now, ()):
            if -r >= turn and -r > ready.get(call, -1):
                ready[call] = -r
                heappush(latest, (r, call))
    pushes = {c: [x for x, turn in by_need.get(c, ()) if ready[c] >= turn] for c in ready}
    waits = Counter(x for xs in pushes.values() for x in xs)
    hops = {c: 1 for c in ready if not waits[c]}
    queue = deque(hops)
    while queue:
        now = queue.popleft()
        for call in pushes[now]:
            waits[call] -= 1
            if not waits[call]:
                hops[call] = hops[now] + 1  # the last that it waited for is of the highest layer
                queue.append(call)
    return ((c, r, hops.get(c)) for c, r in ready.items())


def _by_rounds(edges: DataFrame) -> DataFrame:
    """The same of all conversations together: each round follows only what the round before it pushed, and the layers are
    taken one by one; circles cost no rounds, however long their conversation."""
    spark, key = edges.sparkSession, ["conv_id", "call_id"]
    moves, step = new_folder(spark, "pushed"), 0
    pushed = edges.where("met >= turn").groupBy(*key).agg(F.max("met").alias("ready"))
    while True:
        pushed.withColumn("step", F.lit(step)).write.mode("append").parquet(moves)
        moved = spark.read.schema("conv_id long, call_id string, ready long, step int").parquet(moves)
        last = moved.where(F.col("step") == step)
        if last.isEmpty():
            break
        so_far = moved.groupBy(*key).agg(F.max("ready").alias("before"))
        to = edges.join(last.select("conv_id", F.col("call_id").alias("need"), F.col("ready").alias("r")), ["conv_id", "need"])
        later = to.where("r >= turn").groupBy(*key).agg(F.max(F.greatest("r", "met")).alias("ready"))
        pushed = later.join(so_far, key, "left").where("before IS NULL OR ready > before").select(*key, "ready")
        step += 1
    state = keep(moved.groupBy(*key).agg(F.max("ready").alias("ready")), "ready")
    pushing = state.select("conv_id", F.col("call_id").alias("need"), F.col("ready").alias("r"))
    waits = keep(edges.join(pushing, ["conv_id", "need"]).where("r >= turn").select(*key, "need").distinct(), "waits")
    left, layers, hops = state.select(*key), new_folder(spark, "layers"), 1
    while True:
        left.join(waits, key, "left_anti").withColumn("hops", F.lit(hops).cast("long")).write.mode("append").parquet(layers)
        taken = spark.read.schema("conv_id long, call_id string, hops long").parquet(layers)
        free = taken.where(F.col("hops") == hops)
        if free.isEmpty():
            return state.join(taken, key, "left").select(*key, "ready", "hops")
        left = keep(left.join(free, key, "left_anti"), "left")
        waits = keep(waits.join(free.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti"), "waits")
        hops += 1


def format_chats(messages: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """One row per message (conv_id, turn, kind: call, result or message, call_id, name, body, needs): its link, its place
    in the order, whether it is sound, and its canonical JSON line.

    The first call of an identifier owns it, and the first result answers it; linked_turn is the other's turn.  Problems:
    ``no id``, ``duplicate call``, ``duplicate result``, ``no call``, ``no result``, ``result before call``, ``unknown
    tool``, ``not JSON``, ``number too large``, ``too deep`` (arguments that cannot be kept exact stand in the line as the
    text that they were), ``circle``, or the path and keyword of the schema that the arguments break; null if none.  A need
    that names no call of the conversation asks for nothing.  Repeated rows share their values; a null body is an empty text;
    bodies of any length are read whole; null conversations or turns are linked with nothing; bytes that are not UTF-8 are
    replaced in the line; other columns are ignored; an empty table gives an empty result.  No texts are gathered by
    conversation, and at most AT_ONCE needs, so long ones need no larger task.
    """
    messages = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "kind", "call_id", "name", "body", "needs")
    calls = F.col("kind") == "call"
    usable = messages.where("call_id IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL")
    owners = keep(usable.groupBy("conv_id", "call_id").agg(F.min(F.when(calls, F.col("turn"))).alias("call_turn"), F.min(F.when(F.col("kind") == "result", F.col("turn"))).alias("result_turn")), "owners")
    called = owners.where("call_turn IS NOT NULL")
    pushed = ordered(messages, called)
    joined = messages.join(owners, ["conv_id", "call_id"], "left").join(pushed.withColumn("pushed", F.lit(True)), ["conv_id", "call_id"], "left")
    link = F.when(calls, F.col("result_turn")).when(F.col("kind") == "result", F.col("call_turn"))
    result_after = F.greatest("turn", F.coalesce("ready", "turn"))
    rows = joined.select(
        "conv_id",
        "turn",
        "kind",
        "call_id",
        link.cast("long").alias("linked_turn"),
        F.when(F.col("kind") == "message", F.col("turn")).otherwise(result_after).cast("long").alias("ready"),
        F.when(F.col("pushed") & F.col("hops").isNull(), None).otherwise(F.coalesce("hops", F.lit(0))).cast("long").alias("hops"),
        F.when((F.col("kind") != "message") & (F.col("call_id").isNull() | F.col("conv_id").isNull() | F.col("turn").isNull()), "no id")
        .when(calls & (F.col("turn") != F.col("call_turn")), "duplicate call")
        .when((F.col("kind") == "result") & F.col("call_turn").isNull(), "no call")
        .when((F.col("kind") == "result") & (F.col("turn") != F.col("result_turn")), "duplicate result")
        .when((F.col("kind") == "result") & (F.col("turn") < F.col("call_turn")), "result before call")
        .when(calls & F.col("pushed") & F.col("hops").isNull(), "circle")
        .when(calls & F.col("result_turn").isNull(), "no result")
        .alias("problem"),
        F.col("name").cast("binary").alias("name"),
        F.coalesce("body", F.lit("")).cast("binary").alias("body"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in LINE.split(", ")]
        for batch in batches:
            lines, valid, problems = [], [], []
            for *texts, problem in zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in (2, 3, 8, 9)), batch.column(7).to_pylist()):
                line, wrong = _line(*(None if x is None else x.decode("utf-8", "replace") for x in texts), tools)
                problem = wrong or problem
                lines.append(line)
                problems.append(problem)
                valid.append(problem is None)
            head = [batch.column(i) for i in range(7)]
            yield pa.RecordBatch.from_arrays([*head, pa.array(valid, pa.bool_()), pa.array(problems, pa.string()), pa.array(lines, pa.string())], names)

    return map_texts(rows, run, LINE)


def _line(kind: str, call_id: str | None, name: str | None, body: str, tools: dict[str, dict]) -> tuple[str, str | None]:
    if kind != "call":
        return canonical({"content": body, "role": name, "type": kind} | ({"id": call_id} if kind == "result" else {})), None
    schema, wrong, arguments = tools.get(name or ""), None, body
    try:
        arguments = parsed(body)
        wrong = "unknown tool" if schema is None else invalid(arguments, schema)
        return canonical({"arguments": arguments, "id": call_id, "name": name, "type": "call"}), wrong
    except ValueError as unsound:
        wrong = str(unsound)
    except RecursionError:
        wrong = "too deep"
    return canonical({"arguments": body, "id": call_id, "name": name, "type": "call"}), wrong


#: The same over ``turns_as_tools`` in SQL.  In conversations of odd numbers, a run of user's turns two apart is a chain that
#: waits for its last call; all other needs are met in an earlier turn, and push nothing back.
ORACLE = """
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id
  FROM conversations),
o AS (SELECT conv_id, call_id, min(turn) FILTER (kind = 'call') AS call_turn, min(turn) FILTER (kind = 'result') AS result_turn
  FROM m WHERE call_id IS NOT NULL GROUP BY ALL),
c AS (SELECT conv_id, call_id, call_turn, coalesce(result_turn, call_turn) AS met, call_turn - 2 * row_number() OVER (PARTITION BY conv_id, call_turn % 2 ORDER BY call_turn) AS run
  FROM o WHERE call_turn IS NOT NULL AND conv_id % 2 <> 0),
r AS (SELECT conv_id, call_id, last_value(met) OVER w AS ready, row_number() OVER (PARTITION BY conv_id, call_turn % 2, run ORDER BY call_turn DESC) - 1 AS hops
  FROM c WINDOW w AS (PARTITION BY conv_id, call_turn % 2, run ORDER BY call_turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
j AS (SELECT m.*, call_turn, result_turn, CASE WHEN hops > 0 THEN ready END AS ready, coalesce(hops, 0)::BIGINT AS hops
  FROM m LEFT JOIN o USING (conv_id, call_id) LEFT JOIN r USING (conv_id, call_id)),
p AS (SELECT *, CASE
    WHEN kind = 'call' AND length(text) < 1 THEN '/prompt minLength'
    WHEN kind = 'call' AND length(text) > 1000 THEN '/prompt maxLength'
    WHEN kind = 'call' AND turn <> call_turn THEN 'duplicate call'
    WHEN kind = 'result' AND call_turn IS NULL THEN 'no call'
    WHEN kind = 'result' AND turn <> result_turn THEN 'duplicate result'
    WHEN kind = 'call' AND result_turn IS NULL THEN 'no result' END AS problem FROM j)
SELECT conv_id, turn, kind, call_id, CASE kind WHEN 'call' THEN result_turn WHEN 'result' THEN call_turn END AS linked_turn,
  greatest(turn, coalesce(ready, turn)) AS ready, hops, problem IS NULL AS valid, problem,
  CASE kind WHEN 'call' THEN '{"arguments":{"prompt":' || to_json(text)::VARCHAR || ',"turn":' || turn || '},"id":"' || call_id || '","name":"reply","type":"call"}'
    WHEN 'result' THEN '{"content":' || to_json(text)::VARCHAR || ',"id":"' || call_id || '","role":"assistant","type":"result"}'
    ELSE '{"content":' || to_json(text)::VARCHAR || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"type":"message"}' END AS line
FROM p
"""
