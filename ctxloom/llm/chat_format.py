"""Chat formatting with tool-call linking.

Input: messages (conv_id, turn, role, text) and, per call and result, tables made by `read_messages` or by the caller:

  calls    conv_id, turn, call_id, name, arguments (JSON text), needs (ids of calls whose results the call uses)
  results  conv_id, turn, call_id, content
  schemas  name, schema (JSON Schema text: true, false, or an object with type, properties, required, enum, minimum,
           maximum, minLength, maxLength, additionalProperties, items). Of schemas with one name the smallest text counts.
           Up to SCHEMA_BYTES in all go to every task; beyond that they are joined, a name's calls in SALT parts

1. Results are hash-joined to calls by (conv_id, call_id). The call with the lowest turn (then the smallest arguments) owns an id, and so does the
   result; later ones are marked `duplicate`. A result without a call is an `orphan`, a call without a result `unanswered`.
   Results before their call's turn are linked all the same. Calls and results without an id are linked with nothing: `no id`.
2. Topological order: a call's level is 1 more than the highest level of the calls it needs (0 without). Chains of calls
   with one need each are shortened by pointer doubling, so a chain of n calls takes log2(n) joins; calls with several
   needs then go by one join a level. Needs that are not there are ignored. Calls in or behind a cycle get level -1 and
   status `cycle`.
3. Arguments are validated against the schema of the call's name: `valid`, the first fault in path order, `no schema`, `bad
   schema` (not JSON, or JSON that is no schema where it is read), `not JSON` (NaN and lone surrogates included), or `too
   deep` (nested beyond what Python's parser takes). A fault of one row never fails the job.
4. Every message is one row: canonical JSON (keys sorted, no spaces, UTF-8 as is), and the sort key (at, level, part,
   turn): a linked result stands right behind its call. Rows of a conversation in sort-key order are its transcript; no
   conversation is gathered in one task.

Null roles and texts serialise as JSON null; null conv_id is a conversation of its own; null arguments are an empty object. Arguments that are
`not JSON` or `too deep` serialise as the string they are; of a repeated key the last value counts. Of repeated rows
one owns the id, the others are duplicates. Extra columns, whatever their names, are not read; empty tables give no rows.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, drop_tables, materialize

#: Bytes of all schemas that go to every task; more are joined to their calls, with the same result.
SCHEMA_BYTES = 8 << 20
SALT = 32

_CALLS = "array<struct<id:string,name:string,arguments:string,needs:array<string>>>"


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def fault(value: object, schema: dict | bool, path: str = "$") -> str:
    """The first way in which a value breaks the schema, or ''."""
    if isinstance(schema, bool):
        return "" if schema else f"{path}: not allowed"
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    is_kind = {
        "object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool), "null": value is None,
        "integer": isinstance(value, int) and not isinstance(value, bool), "number": isinstance(value, int | float) and not isinstance(value, bool),
    }
    if kinds and not any(is_kind.get(k, False) for k in kinds):
        return f"{path}: not {'/'.join(kinds)}"
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return f"{path}: not in enum"
    if is_kind["number"]:
        if value < schema.get("minimum", value):
            return f"{path}: under minimum"
        if value > schema.get("maximum", value):
            return f"{path}: over maximum"
    if is_kind["string"]:
        if len(value) < schema.get("minLength", 0):
            return f"{path}: too short"
        if len(value) > schema.get("maxLength", len(value)):
            return f"{path}: too long"
    if is_kind["object"]:
        for k in sorted(schema.get("required", ())):
            if k not in value:
                return f"{path}.{k}: missing"
        for k in sorted(value):
            if k in schema.get("properties", {}):
                if found := fault(value[k], schema["properties"][k], f"{path}.{k}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{path}.{k}: unknown"
    if is_kind["array"] and "items" in schema:
        for i, v in enumerate(value):
            if found := fault(v, schema["items"], f"{path}[{i}]"):
                return found
    return ""


_parsed = functools.lru_cache(256)(json.loads)


def checked(text: str | None, schema: str | None) -> tuple[str, object]:
    """(verdict, what stands for the arguments in the message) of a call's arguments."""
    try:
        value = json.loads(text) if text is not None else {}
        canonical([[[value]]]).encode()  # as deep as in the message, and beyond
    except RecursionError:
        return "too deep", text
    except ValueError:
        return "not JSON", text
    if schema is None:
        return "no schema", value
    try:
        return fault(value, _parsed(schema)) or "valid", value
    except (ValueError, TypeError, AttributeError, KeyError, RecursionError):
        return "bad schema", value


def read_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plain messages, calls, results) of messages whose assistant texts may be JSON with `tool_calls` ([{id, name, arguments,
    needs}], arguments an object or JSON text) and whose tool texts are JSON with `tool_call_id` and `content`."""
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    said = F.when(F.col("role") == "assistant", F.from_json(F.get_json_object("text", "$.tool_calls"), _CALLS))
    m = m.withColumn("calls", F.when(F.col("text").startswith("{"), said)).withColumn("reply", F.when((F.col("role") == "tool") & F.col("text").startswith("{"), F.get_json_object("text", "$.tool_call_id")))
    calls = m.where(F.size("calls") > 0).select("conv_id", "turn", F.explode("calls").alias("c"))
    calls = calls.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.needs", F.array().cast("array<string>")).alias("needs"))
    results = m.where("reply is not null").select("conv_id", "turn", F.col("reply").alias("call_id"), F.get_json_object("text", "$.content").alias("content"))
    called = F.coalesce(F.size("calls"), F.lit(0)) > 0
    beside = F.when(called, F.get_json_object("text", "$.content")).otherwise(F.col("text"))  # what is said beside calls is a message, too
    plain = m.where(F.col("reply").isNull() & (~called | beside.isNotNull())).select("conv_id", "turn", "role", beside.alias("text"))
    return plain, calls, results


def _owned(rows: DataFrame, *key: str, name: str) -> DataFrame:
    """rows with an id, stored, with `first`: whether the row owns its id, having the lowest turn, then the smallest of the other columns;
    of equal rows one owns it."""
    rows = materialize(rows.where("call_id is not null").withColumn("__row", F.monotonically_increasing_id()), f"{name}-rows")
    place = F.struct("turn", *[F.coalesce(F.to_json(c) if c == "needs" else F.col(c), F.lit("")).alias(c) for c in key], "__row")
    low = rows.groupBy("conv_id", "call_id").agg(F.min(place)["__row"].alias("__first"))
    low = low.select(F.col("conv_id").alias("__c"), F.col("call_id").alias("__i"), "__first")
    owned = rows.join(low, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("call_id") == F.col("__i"))).withColumn("first", F.col("__row") == F.col("__first"))
    owned = materialize(owned.drop("__c", "__i", "__first", "__row"), name)
    drop_tables(rows)
    return owned


def _anchors(chain: DataFrame) -> DataFrame:
    """(k, to, dist) of nodes with one need -> the first node behind each that has none or several, by pointer doubling.
    Nodes on a cycle of such nodes, or behind one, have no row."""
    left, rounds = chain.count(), 0
    active, done = chain, chain.limit(0)
    while left >> rounds and not active.isEmpty():
        every = done.unionByName(active).select(F.col("k").alias("to"), F.col("to").alias("next"), F.col("dist").alias("more"))
        moved = active.join(every, "to", "left").select("k", F.coalesce("next", "to").alias("to"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("next").isNotNull().alias("moved"))
        moved = materialize(moved, f"chat-jump{rounds}")
        done, active = done.unionByName(moved.where("not moved").drop("moved")), moved.where("moved").drop("moved")
        rounds += 1
    last = active.join(chain.select(F.col("k").alias("to")), "to", "left_anti").select("k", "to", "dist")
    return materialize(done.unionByName(last), "chat-anchors")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of owned calls (conv_id, call_id, needs)."""
    key = lambda call: F.to_json(F.array(F.col("conv_id").cast("string"), F.col(call))).alias("k")
    nodes = materialize(calls.select("conv_id", "call_id", "needs", key("call_id")).dropDuplicates(["k"]), "chat-nodes")
    wants = nodes.select("k", "conv_id", F.explode(F.array_distinct("needs")).alias("need")).where("need is not null")
    wants = wants.select(F.col("k").alias("from"), key("need")).join(nodes.select("k"), "k").select(F.col("from").alias("k"), F.col("k").alias("to"))
    wants = materialize(wants.groupBy("k").agg(F.collect_set("to").alias("to")), "chat-needs")  # a call's own list
    known = newest = materialize(nodes.select("k").join(wants, "k", "left_anti").withColumn("level", F.lit(0).cast("long")), "chat-roots")
    chain = _anchors(wants.where("size(to) = 1").select("k", F.col("to")[0].alias("to"), F.lit(1).cast("long").alias("dist")))

    # calls with several needs, over the chains between them
    edges = wants.where("size(to) > 1").select("k", F.explode("to").alias("to"))
    behind = chain.select(F.col("k").alias("to"), F.col("to").alias("anchor"), "dist")
    edges = materialize(edges.join(behind, "to", "left").select("k", F.coalesce("anchor", "to").alias("to"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist")), "chat-edges")
    left = wants.where("size(to) > 1").select("k", F.size("to").cast("long").alias("n"), F.lit(0).cast("long").alias("level"))
    while not left.isEmpty():
        met = edges.join(newest.select(F.col("k").alias("to"), F.col("level").alias("base")), "to").groupBy("k").agg(F.count("*").alias("met"), F.max(F.col("base") + F.col("dist")).alias("top"))
        left = left.join(met, "k", "left").select("k", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n"), F.greatest("level", "top").alias("level"))
        left = materialize(left, "chat-left")
        newest = left.where("n = 0").select("k", "level")
        if newest.isEmpty():
            break
        known, left = known.unionByName(newest), left.where("n > 0")

    ends = known.select(F.col("k").alias("to"), "level")
    known = known.unionByName(chain.join(ends, "to").select("k", (F.col("level") + F.col("dist")).alias("level")))
    return nodes.join(known, "k", "left").select("conv_id", "call_id", F.coalesce("level", F.lit(-1)).cast("int").alias("level"))


def _serialise(rows: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """Validate calls and write each row's canonical JSON. A row's schema is in its column `schema`, or else in schemas."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, at long, level int, part int, turn long, call_id string, status string, verdict string, json string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, texts = [], []
            for role, text, name, call, kind, joined in zip(*(column_of(batch, c).to_pylist() for c in ("role", "text", "name", "call_id", "kind", "schema")), strict=True):
                verdict = None
                if kind == "call":
                    verdict, value = checked(text, schemas.get(name, joined))
                    body = {"role": role, "tool_call": {"id": call, "name": name, "arguments": value}}
                elif kind == "result":
                    body = {"role": role, "tool_call_id": call, "content": text}
                else:
                    body = {"role": role, "content": text}
                verdicts.append(verdict)
                texts.append(canonical(body))
            keep = [column_of(batch, c) for c in ("conv_id", "at", "level", "part", "turn", "call_id", "status")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(verdicts, pa.string()), pa.array(texts, pa.string())], names=["conv_id", "at", "level", "part", "turn", "call_id", "status", "verdict", "json"])

    return rows.mapInArrow(run, schema)


def _with_schemas(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """rows with the schema of their name; a name's rows are dealt to SALT parts, and each has the schema."""
    known = schemas.select(F.col("name").alias("__name"), "schema", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__salt"))
    salted = rows.withColumn("__part", F.when(F.col("kind") == "call", F.pmod(F.xxhash64("conv_id", "turn", "call_id"), F.lit(SALT)).cast("int")))
    return salted.join(known, (F.col("name") == F.col("__name")) & (F.col("__part") == F.col("__salt")), "left").drop("__name", "__salt", "__part")


def format_chats(plain: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, at, level, part, turn, call_id, status, verdict, json: one row a message, call or result."""
    schemas = materialize(schemas.where("name is not null and schema is not null").groupBy("name").agg(F.min("schema").alias("schema")), "chat-schemas")
    size = schemas.agg(F.sum(F.octet_length("schema") + F.octet_length("name"))).first()[0] or 0
    few = size <= SCHEMA_BYTES
    known = {r["name"]: r["schema"] for r in schemas.collect()} if few else {}
    calls = calls.select("conv_id", F.col("turn").cast("long").alias("turn"), "call_id", "name", "arguments", "needs")
    results = results.select("conv_id", F.col("turn").cast("long").alias("turn"), "call_id", "content")
    stray_calls, stray_results = calls.where("call_id is null"), results.where("call_id is null")
    calls, results = _owned(calls, "arguments", "name", "needs", name="chat-calls"), _owned(results, "content", name="chat-results")
    order = levels(calls.where("first"))
    order = calls.where("first").alias("c").join(order.alias("o"), F.col("c.conv_id").eqNullSafe(F.col("o.conv_id")) & (F.col("c.call_id") == F.col("o.call_id")))
    order = materialize(order.select("c.conv_id", "c.call_id", "c.turn", "c.name", "c.arguments", "o.level"), "chat-order")
    answer = results.where("first")
    both = order.alias("c").join(answer.alias("r"), F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("c.call_id") == F.col("r.call_id")), "full_outer")
    both = materialize(both.select(
        F.when(F.col("c.call_id").isNotNull(), F.col("c.conv_id")).otherwise(F.col("r.conv_id")).alias("conv_id"), F.coalesce("c.call_id", "r.call_id").alias("call_id"),
        F.col("c.turn").alias("call_turn"), F.col("r.turn").alias("result_turn"), "name", "arguments", "level", "content",
    ), "chat-linked")
    status = F.when(F.col("level") < 0, "cycle").when(F.col("call_turn").isNull(), "orphan").when(F.col("result_turn").isNull(), "unanswered").otherwise("linked")
    none, level = F.lit(None).cast("string"), F.coalesce(F.col("level"), F.lit(0)).cast("int").alias("level")
    at = F.coalesce("call_turn", "result_turn").alias("at")
    rows = both.where("call_turn is not null").select("conv_id", at, level, F.lit(1).alias("part"), F.col("call_turn").alias("turn"), "call_id", status.alias("status"), F.lit("assistant").alias("role"), F.col("arguments").alias("text"), "name", F.lit("call").alias("kind"))
    rows = rows.unionByName(both.where("result_turn is not null").select("conv_id", at, level, F.lit(2).alias("part"), F.col("result_turn").alias("turn"), "call_id", status.alias("status"), F.lit("tool").alias("role"), F.col("content").alias("text"), none.alias("name"), F.lit("result").alias("kind")))
    again = F.lit("duplicate").alias("status")
    zero = F.lit(0).alias("level")
    rows = rows.unionByName(calls.where("not first").select("conv_id", F.col("turn").alias("at"), zero, F.lit(3).alias("part"), "turn", "call_id", again, F.lit("assistant").alias("role"), F.col("arguments").alias("text"), "name", F.lit("call").alias("kind")))
    rows = rows.unionByName(results.where("not first").select("conv_id", F.col("turn").alias("at"), zero, F.lit(4).alias("part"), "turn", "call_id", again, F.lit("tool").alias("role"), F.col("content").alias("text"), none.alias("name"), F.lit("result").alias("kind")))
    for stray, part, role, text in ((stray_calls.withColumn("kind", F.lit("call")), 3, "assistant", "arguments"), (stray_results.withColumns({"kind": F.lit("result"), "name": none}), 4, "tool", "content")):
        rows = rows.unionByName(stray.select("conv_id", F.col("turn").alias("at"), zero, F.lit(part).alias("part"), "turn", "call_id", F.lit("no id").alias("status"), F.lit(role).alias("role"), F.col(text).alias("text"), "name", "kind"))
    turn = F.col("turn").cast("long").alias("turn")
    rows = rows.unionByName(plain.select("conv_id", turn.alias("at"), zero, F.lit(0).alias("part"), turn, none.alias("call_id"), F.lit("message").alias("status"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), none.alias("name"), F.lit("message").alias("kind")))
    return _serialise(rows.withColumn("schema", none) if few else _with_schemas(rows, schemas), known)
