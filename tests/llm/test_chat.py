"""Tool-call linking on small conversations."""

import json
import random

from pyspark.sql import functions as F

from ctxloom.llm import chat_format as c

SCHEMA = json.dumps({"type": "object", "required": ["q"], "additionalProperties": False, "properties": {"q": {"type": "string", "minLength": 1}, "n": {"type": "integer", "minimum": 1}}})


def test_links_order_and_faults(spark):
    calls = spark.createDataFrame([
        ("k", 1, "a", "find", '{"q":"x","n":2}', ["b"]), ("k", 1, "b", "find", '{"n":0,"q":"y"}', []), ("k", 3, "c", "find", '{"q":1}', ["a", "gone"]), ("k", 5, "d", "other", "not json", None),
        ("k", 7, "e", "find", None, ["f"]), ("k", 7, "f", "find", '{"q":"z","w":1}', ["e"]), ("k", 9, "a", "find", "{}", []), (None, 1, "a", "find", '{"q":"é"}', []),
    ], "conv_id string, turn long, call_id string, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([("k", 2, "a", "ra"), ("k", 0, "b", "rb"), ("k", 4, "c", None), ("k", 6, "zz", "orphan"), ("k", 8, "a", "again"), ("m", 2, "d", "other talk"), (None, 2, "a", "null talk")], "conv_id string, turn long, call_id string, content string")
    plain = spark.createDataFrame([("k", 0, "user", "hi"), ("k", None, None, None)], "conv_id string, turn long, role string, text string")
    rows = c.format_chats(plain, calls, results, spark.createDataFrame([("find", SCHEMA), (None, "{}")], "name string, schema string")).collect()
    assert len(rows) == calls.count() + results.count() + 2
    of = {(r.conv_id, r.call_id, r.part): r for r in rows}
    level = {k: of["k", k, 1].level for k in "abcdef"}
    assert level == {"b": 0, "a": 1, "c": 2, "d": 0, "e": -1, "f": -1}
    status = {(r.conv_id, r.call_id, r.part): r.status for r in rows}
    assert status["k", "a", 1] == status["k", "a", 2] == status["k", "b", 2] == "linked" and status["k", "d", 1] == "unanswered" and status["k", "zz", 2] == "orphan" and status["k", "e", 1] == "cycle"
    assert status["k", "a", 3] == status["k", "a", 4] == "duplicate" and status[None, "a", 2] == "linked" and status["m", "d", 2] == "orphan"
    verdict = {k: of["k", k, 1].verdict for k in "abcdef"}
    assert verdict == {"a": "valid", "b": "$.n: under minimum", "c": "$.q: not string", "d": "not JSON", "e": "$.q: missing", "f": "$.w: unknown"}
    assert of["k", "a", 1].json == '{"role":"assistant","tool_call":{"arguments":{"n":2,"q":"x"},"id":"a","name":"find"}}'
    assert of[None, "a", 1].json == '{"role":"assistant","tool_call":{"arguments":{"q":"é"},"id":"a","name":"find"}}'
    assert of["k", "b", 2].at == 1 and of["k", "b", 2].turn == 0  # behind its call
    assert all(json.loads(r.json) is not None for r in rows)


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>"


def test_long_chain(spark):
    calls = spark.createDataFrame([(1, i, f"c{i}", "f", "{}", [f"c{i - 1}"] if i else []) for i in range(100)], CALLS)
    assert {r.call_id: r.level for r in c.levels(calls).collect()} == {f"c{i}": i for i in range(100)}


def test_levels_equal_brute_force(spark):
    rng, needs = random.Random(9), {}
    for conv in (None, 1, 2):
        for i in range(40):
            pool = [f"c{j}" for j in range(i)] or ["gone"]
            needs[conv, f"c{i}"] = rng.sample(pool, min(len(pool), rng.choice([0, 1, 1, 1, 2, 3])))
    needs[1, "c3"], needs[2, "c5"], needs[2, "c9"], needs[2, "c12"] = ["c3"], ["c9"], ["c12", "c1"], ["c5", "c5"]

    def level(conv, call, path=()):
        if call in path:
            return None
        below = [level(conv, x, (*path, call)) for x in needs[conv, call] if (conv, x) in needs]
        return None if None in below else max(below, default=-1) + 1

    calls = spark.createDataFrame([(conv, 0, call, "f", "{}", x) for (conv, call), x in needs.items()], CALLS)
    got = {(r.conv_id, r.call_id): r.level for r in c.levels(calls).collect()}
    expected = {k: level(*k) for k in needs}
    assert got == {k: -1 if v is None else v for k, v in expected.items()}


def test_messages_are_read(spark):
    said = json.dumps({"tool_calls": [{"id": "1", "name": "f", "arguments": {"a": 1}}, {"id": "2", "name": "g", "arguments": '{"b":2}', "needs": ["1"]}]})
    rows = [("k", 0, "user", "hi"), ("k", 1, "assistant", said), ("k", 2, "tool", '{"tool_call_id":"1","content":"ok"}'), ("k", 3, "assistant", "{broken"), ("k", 4, None, None)]
    plain, calls, results = c.read_messages(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    assert sorted(r.turn for r in plain.collect()) == [0, 3, 4]
    assert [(r.call_id, json.loads(r.arguments), r.needs) for r in calls.orderBy("call_id").collect()] == [("1", {"a": 1}, []), ("2", {"b": 2}, ["1"])]
    assert [(r.call_id, r.content) for r in results.collect()] == [("1", "ok")]


def test_empty_tables(spark):
    plain, calls, results = c.read_messages(spark.createDataFrame([], "conv_id string, turn int, role string, text string"))
    assert c.format_chats(plain, calls, results, spark.createDataFrame([], "name string, schema string")).count() == 0


def test_bad_rows_get_verdicts(spark):
    deep = "[" * 100_000 + "]" * 100_000
    cases = {
        "deep": (deep, "find", "too deep"), "half": ('{"q":"\\ud800"}', "find", "not JSON"), "nan": ('{"q":NaN}', "find", "not JSON"), "digits": ("9" * 5000, "find", "not JSON"),
        "text": ('{"q":"x"}', "torn", "bad schema"), "kind": ('{"q":"x"}', "odd", "bad schema"), "none": ('{"q":"x"}', "gone", "no schema"), "null": ('{"q":"x"}', None, "no schema"),
        "false": ("{}", "never", "$: not allowed"), "true": ("{}", "ever", "valid"), "ok": ('{"q":"x"}', "find", "valid"), "empty": ("", "find", "not JSON"),
    }
    schemas = [("find", SCHEMA), ("torn", "{"), ("odd", '{"properties":5}'), ("never", "false"), ("ever", "true"), ("find", SCHEMA + " "), (None, SCHEMA), ("gone", None)]
    calls = [("k", i, k, name, text, []) for i, (k, (text, name, _)) in enumerate(cases.items())]
    frames = spark.createDataFrame([], "conv_id string, turn long, role string, text string"), spark.createDataFrame(calls, CALLS.replace("conv_id long", "conv_id string")), spark.createDataFrame([("k", 3, None, "lost")], "conv_id string, turn long, call_id string, content string")
    got = c.format_chats(*frames, spark.createDataFrame(schemas, "name string, schema string")).collect()
    assert {r.call_id: r.verdict for r in got if r.call_id} == {k: v for k, (_, _, v) in cases.items()}
    assert [(r.status, json.loads(r.json)["content"]) for r in got if not r.call_id] == [("no id", "lost")]
    assert json.loads(next(r.json for r in got if r.call_id == "deep"))["tool_call"]["arguments"] == deep


def brute(plain, calls, results, schemas):
    """The rows of format_chats by loops over small lists."""
    owner, answer, out = {}, {}, []
    text = lambda v: "" if v is None else v
    for call in sorted(calls, key=lambda x: (x[1], text(x[4]), text(x[3]), json.dumps(x[5], separators=(",", ":")) if x[5] is not None else "")):
        out += [] if call[2] is None or owner.setdefault((call[0], call[2]), call) is call else [(call, "duplicate", 3)]
        out += [(call, "no id", 3)] if call[2] is None else []
    for r in sorted(results, key=lambda x: (x[1], text(x[3]))):
        out += [] if r[2] is None or answer.setdefault((r[0], r[2]), r) is r else [(r, "duplicate", 4)]
        out += [(r, "no id", 4)] if r[2] is None else []

    def level(k, path=()):
        if k in path:
            return None
        below = [level((k[0], n), (*path, k)) for n in owner[k][5] or () if (k[0], n) in owner]
        return None if None in below else max(below, default=-1) + 1

    best = {}
    for n, s in sorted((n, s) for n, s in schemas if n is not None and s is not None):
        best.setdefault(n, s)

    def call_json(x):
        try:
            value = {} if x[4] is None else json.loads(x[4])
        except ValueError:
            return "not JSON", x[4]
        return ("no schema" if x[3] not in best else c.fault(value, json.loads(best[x[3]])) or "valid"), value

    rows = []

    def say(x, at, lvl, part, status, call):
        verdict, value = call_json(x) if call else (None, None)
        body = {"role": "assistant", "tool_call": {"id": x[2], "name": x[3], "arguments": value}} if call else {"role": "tool", "tool_call_id": x[2], "content": x[3]}
        rows.append((x[0], at, lvl, part, x[1], x[2], status, verdict, json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":"))))

    for x, status, part in out:
        say(x, x[1], 0, part, status, part == 3)
    for k in {**owner, **answer}:
        o, a = owner.get(k), answer.get(k)
        lvl = None if o is None else level(k)
        status = "orphan" if o is None else "cycle" if lvl is None else "linked" if a else "unanswered"
        at, lvl = (o or a)[1], 0 if o is None else -1 if lvl is None else lvl
        if o:
            say(o, at, lvl, 1, status, True)
        if a:
            say(a, at, lvl, 2, status, False)
    for conv, turn, role, said in plain:
        rows.append((conv, turn, 0, 0, turn, None, "message", None, json.dumps({"role": role, "content": said}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))))
    return rows


def test_formatter_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    args = ['{"q":"x","n":2}', '{"n":0,"q":"y"}', "{}", "torn {", None, '{"q":"é","z":[1,{"b":2,"a":1}]}']
    convs, ids = [None, "k", "l"], [None, "a", "b", "c", "d", "e"]
    calls = [(rng.choice(convs), rng.randrange(6), rng.choice(ids), rng.choice(["find", "other", None, "big"]), rng.choice(args), rng.choice([None, [], ["a"], ["b", "c"], ["e", "gone", "d"]])) for _ in range(40)]
    results = [(rng.choice(convs), rng.randrange(6), rng.choice(ids), rng.choice(["yes", "no", None])) for _ in range(30)]
    calls, results = calls + [(*x,) for x in calls[:5]], results + [(*x,) for x in results[:5]]
    plain = [(rng.choice(convs), rng.choice([None, 0, 3]), rng.choice(["user", None]), rng.choice(["hi", None, ""])) for _ in range(8)]
    schemas = [("find", SCHEMA), ("find", '{"type":"object"}'), ("big", '{"required":["q"]}')]
    frames = [spark.createDataFrame(rows, k).withColumns({"k": F.lit(1), "first": F.lit(2), "level": F.lit(3), "__row": F.lit(4)}) for rows, k in (
        (plain, "conv_id string, turn long, role string, text string"), (calls, CALLS.replace("conv_id long", "conv_id string")), (results, "conv_id string, turn long, call_id string, content string"), (schemas, "name string, schema string"))]
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    expected = sorted(brute(plain, calls, results, schemas), key=key)
    assert sorted(map(tuple, c.format_chats(*frames).collect()), key=key) == expected
    monkeypatch.setattr(c, "SCHEMA_BYTES", 10)  # joined instead
    assert sorted(map(tuple, c.format_chats(*frames).collect()), key=key) == expected


def test_text_beside_calls_and_calls_without_an_id_stay(spark):
    rows = [("k", 1, "assistant", '{"content":"let me see","tool_calls":[{"name":"f","arguments":{}},{"id":"1","name":"f"}]}')]
    plain, calls, _ = c.read_messages(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    assert [r.text for r in plain.collect()] == ["let me see"] and sorted(str(r.call_id) for r in calls.collect()) == ["1", "None"]
