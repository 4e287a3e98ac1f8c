import json

import pytest

from paperloom.llm import chat

SCHEMA = "conv_id long, turn long, kind string, call_id string, name string, body string, needs array<string>"
TOOLS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"type": "string"}, "maxItems": 2}}, "additionalProperties": False}}


def run(spark, rows):
    return {(r.conv_id, r.turn, r.kind, r.call_id): r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA), TOOLS).collect()}


def test_canonical():
    assert chat.canonical({"b": 1.0, "a": [1.5, None, "é\n"], "c": {"z": True, "y": 10**20}}) == '{"a":[1.5,null,"é\\n"],"b":1,"c":{"y":100000000000000000000,"z":true}}'


def test_schema():
    s = TOOLS["add"]
    assert chat.invalid({"a": 1, "b": ["x"]}, s) is None
    assert chat.invalid({"a": 2.0}, s) is None
    assert chat.invalid({}, s) == "/a required"
    assert chat.invalid({"a": True}, s) == "/a type"
    assert chat.invalid({"a": -1}, s) == "/a minimum"
    assert chat.invalid({"a": 1, "b": ["x", 2]}, s) == "/b/1 type"
    assert chat.invalid({"a": 1, "b": ["x"] * 3}, s) == "/b maxItems"
    assert chat.invalid({"a": 1, "z": 1}, s) == "/z additionalProperties"
    assert chat.invalid([], s) == "/ type"


def test_links_and_problems(spark):
    rows = [
        (1, 0, "message", None, "user", "hi", []),
        (1, 1, "call", "x", "add", '{"a": 1}', []),
        (1, 2, "result", "x", None, "2", []),
        (1, 3, "call", "x", "add", '{"a": 1}', []),
        (1, 4, "result", "x", None, "again", []),
        (1, 5, "call", "y", "add", '{"a": "no"}', ["x"]),
        (1, 6, "result", "y", None, None, []),
        (1, 7, "call", "z", "nope", "{}", None),
        (1, 8, "result", "q", None, "?", []),
        (1, 9, "call", "w", "add", "not json", []),
        (2, 0, "result", "v", None, "early", []),
        (2, 1, "call", "v", "add", '{"a":3}', []),
        (None, 1, "call", "v", "add", '{"a":3}', []),
        (3, 1, "call", None, "add", '{"a":3}', []),
        (3, 2, "call", "alone", "add", '{"a":3}', []),
    ]
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS result_turn", "2 AS ready", "3 AS pushed", "4 AS valid")
    assert chat.format_chats(clash, TOOLS).count() == len(rows)
    got = run(spark, rows)
    problem = {k: v.problem for k, v in got.items()}
    assert problem[(1, 1, "call", "x")] is None and got[(1, 1, "call", "x")].linked_turn == 2
    assert problem[(1, 3, "call", "x")] == "duplicate call"
    assert problem[(1, 4, "result", "x")] == "duplicate result"
    assert problem[(1, 5, "call", "y")] == "/a type"
    assert problem[(1, 7, "call", "z")] == "unknown tool"
    assert problem[(1, 8, "result", "q")] == "no call"
    assert problem[(1, 9, "call", "w")] == "not JSON"
    assert problem[(2, 0, "result", "v")] == "result before call"
    assert problem[(None, 1, "call", "v")] == "no id"
    assert problem[(3, 1, "call", None)] == "no id"
    assert problem[(3, 2, "call", "alone")] == "no result"
    assert json.loads(got[(1, 1, "call", "x")].line) == {"arguments": {"a": 1}, "id": "x", "name": "add", "type": "call"}
    assert json.loads(got[(1, 6, "result", "y")].line)["content"] == ""


def test_order_is_topological_and_circles_are_found(spark):
    calls = {"a": (1, ["c"]), "b": (2, ["a"]), "c": (3, []), "d": (4, ["e"]), "e": (5, ["d"]), "f": (6, ["d"]), "g": (7, ["a"])}
    rows = [(1, t, "call", k, "add", '{"a":1}', needs) for k, (t, needs) in calls.items()]
    got = {k[3]: v for k, v in run(spark, rows).items()}
    place = {k: (v.ready, v.hops, v.turn) for k, v in got.items()}
    for k in "abcg":
        for need in calls[k][1]:
            assert place[need] < place[k], (need, k, place)
    assert [got[k].problem for k in "de"] == ["circle", "circle"]
    assert got["d"].hops is None and got["e"].hops is None


def test_plain_conversations(spark):
    plain = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "r"), (1, 3, "user", ""), (2, 0, "assistant", None), (2, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    got = chat.format_chats(chat.turns_as_tools(plain), chat.REPLY_TOOLS).collect()
    assert len(got) == 6
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[(1, 1)].valid and by[(1, 1)].linked_turn == 2
    assert by[(1, 3)].problem == "/prompt minLength"
    assert by[(2, 0)].problem == "no call"
    assert chat.format_chats(chat.turns_as_tools(plain.limit(0)), chat.REPLY_TOOLS).count() == 0


def test_arguments_that_cannot_be_kept(spark):
    bodies = ["[" * 100_000 + "]" * 100_000, '{"a":' + "9" * 400 + "}", '{"a":' + "9" * 5000 + "}", '{"a":1e999}', '{"a":NaN}', '{"a":1,"b":["\\ud800"]}', '{"a":' + "[" * 900 + "]" * 900 + "}", '{"a":1e300}', "nul", ""]
    got = run(spark, [(1, t, "call", f"c{t}", "add", body, []) for t, body in enumerate(bodies)])
    problems = [got[(1, t, "call", f"c{t}")].problem for t in range(len(bodies))]
    assert problems == ["too deep", "no result", "number too large", "number too large", "not JSON", "no result", "/a type", "no result", "not JSON", "not JSON"]
    lines = [json.loads(got[(1, t, "call", f"c{t}")].line) for t in range(len(bodies))]
    assert lines[1]["arguments"] == {"a": 10**400 - 1} and lines[5]["arguments"]["b"] == ["\ud800"] and lines[0]["arguments"] == bodies[0]


def test_bytes_that_are_not_text(spark):
    df = spark.sql("SELECT 1L conv_id, 2L turn, 'message' kind, CAST(NULL AS STRING) call_id, CAST(X'61FF' AS STRING) name, CAST(X'62FE' AS STRING) body, CAST(array() AS array<string>) needs")
    assert json.loads(chat.format_chats(df, TOOLS).first().line) == {"content": "b\ufffd", "role": "a\ufffd", "type": "message"}


def brute_order(calls):
    """ready and hops by repeated relaxation over one conversation's calls (turn, needs); circles by the length of chains."""
    state = {}
    for _ in range(3 * len(calls) + 3):
        for k, (turn, needs) in calls.items():
            for n in needs:
                if n not in calls:
                    continue
                r, h = state.get(n, (calls[n][0], 0))
                r = max(r, calls[n][0])
                if r >= turn:
                    old = state.get(k, (-1, 0))
                    ready = max(r, old[0])
                    state[k] = (ready, old[1])
    hops = {k: 1 for k in state}
    for _ in range(len(calls) + 2):
        for k in state:
            turn, needs = calls[k]
            up = [hops[n] for n in needs if n in state and state[n][0] >= turn]
            hops[k] = min(len(calls) + 1, 1 + max(up, default=0))
    return {k: (r, None if hops[k] > len(calls) else hops[k]) for k, (r, _) in state.items()}


@pytest.mark.parametrize("at_once", [100_000, 4, 0])
def test_order_against_brute_force(spark, monkeypatch, at_once):
    import random

    monkeypatch.setattr(chat, "AT_ONCE", at_once)  # conversations of more needs are ordered round by round

    rnd = random.Random(4)
    rows, want = [], {}
    for conv in range(40):
        names = [f"c{i}" for i in range(rnd.randint(1, 9))]
        calls = {k: (t, rnd.sample([*names, "nobody"], rnd.randint(0, 2))) for t, k in enumerate(names)}
        rows += [(conv, t, "call", k, "add", '{"a":1}', needs) for k, (t, needs) in calls.items()]
        expected = brute_order(calls)
        want |= {(conv, k): expected.get(k, (t, 0)) for k, (t, _) in calls.items()}
    got = {(r.conv_id, r.call_id): (r.ready, r.hops) for r in run(spark, rows).values()}
    assert got == want and any(h is None for _, h in want.values()) and any((h or 0) > 2 for _, h in want.values())


def test_a_circle_in_a_long_conversation_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(chat, "AT_ONCE", 0)
    written, plain = [], chat.keep
    monkeypatch.setattr(chat, "keep", lambda df, label: written.append(label) or plain(df, label))
    rows = [(1, t, "call", f"c{t}", "add", '{"a":1}', {3: ["c4"], 4: ["c3"]}.get(t, [f"c{t - 1}"])) for t in range(60)]
    got = run(spark, rows)
    assert [got[(1, t, "call", f"c{t}")].hops for t in (2, 3, 4, 5, 59)] == [0, None, None, 0, 0]
    assert len(written) < 12


def test_empty_and_repeated(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA), TOOLS).count() == 0
    rows = [(1, 1, "call", "x", "add", '{"a":1}', []), (1, 1, "call", "x", "add", '{"a":1}', []), (1, 2, "result", "x", None, "long " * 400_000, [])]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA), TOOLS).collect()
    assert [r.problem for r in got] == [None] * 3 and max(len(r.line) for r in got) > 2_000_000


def test_a_long_chain_takes_one_job(spark, monkeypatch):
    written, plain = [], chat.keep
    monkeypatch.setattr(chat, "keep", lambda df, label: written.append(label) or plain(df, label))
    n = 20_000
    rows = [(1, t, "call", f"c{t}", "add", '{"a":1}', [f"c{t + 1}"]) for t in range(n)]
    got = run(spark, rows)
    assert [got[(1, t, "call", f"c{t}")].hops for t in (0, 1, n - 2, n - 1)] == [n - 1, n - 2, 1, 0]
    assert all(got[(1, t, "call", f"c{t}")].ready == n - 1 for t in range(0, n - 1, 97)) and len(written) < 5


def test_odd_conversations_are_put_in_order(spark):
    plain = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(6)] + [(2, t, "user", "x") for t in (0, 2)], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.ready, r.hops) for r in chat.format_chats(chat.turns_as_tools(plain), chat.REPLY_TOOLS).collect()}
    assert got == {(1, 0): (5, 2), (1, 1): (5, 2), (1, 2): (5, 1), (1, 3): (5, 1), (1, 4): (4, 0), (1, 5): (5, 0), (2, 0): (0, 0), (2, 2): (2, 0)}


def test_identifiers_that_are_not_text(spark):
    df = spark.sql("""SELECT 1L conv_id, 1L turn, 'call' kind, CAST(X'61FF' AS STRING) call_id, 'add' name, '{"a":1}' body, array(CAST(X'62FE' AS STRING)) needs
      UNION ALL SELECT 1L, 2L, 'call', CAST(X'62FE' AS STRING), 'add', '{"a":1}', CAST(array() AS array<string>)""")
    got = {r.turn: (r.ready, r.hops) for r in chat.format_chats(df, TOOLS).drop("call_id").collect()}
    assert got == {1: (2, 1), 2: (2, 0)}
