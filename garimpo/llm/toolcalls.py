"""Tool-call linking: calls and results joined by identifier, topological order, arguments checked, canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garimpo.llm.common import checkpoint

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": (int, float), "number": (int, float)}
#: Needs of a conversation that are ordered in one task; larger conversations are ordered in rounds over all tasks.
CONV_NEEDS = 100_000


def _is(value: object, kind: str) -> bool:
    """Whether a value is of a JSON-schema type: no boolean is a number, and a number without fraction is an integer."""
    if not isinstance(value, _KINDS[kind]) or (isinstance(value, bool) and kind != "boolean"):
        return False
    return kind != "integer" or isinstance(value, int) or value.is_integer()


def problems(value: object, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks the schema: type, enum, properties, required, additionalProperties, items, minimum, maximum, minLength, maxLength.

    A schema that can't be applied raises KeyError (an unknown type), TypeError or AttributeError.
    """
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any([_is(value, k) for k in kinds]):
            return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(x == value and isinstance(x, bool) == isinstance(value, bool) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: length")
    elif isinstance(value, (int, float)) and not isinstance(value, bool) and (value < schema.get("minimum", value) or value > schema.get("maximum", value)):
        out.append(f"{at}: range")
    return out


def canonical(value: object) -> str:
    """Keys in order of code points, no spaces, only what must be escaped escaped; surrogates without their other half must."""
    found = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return re.sub(r"[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", found)


def _number(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise OverflowError(text)
    return value


def _constant(text: str) -> float:
    raise ValueError(text)


def _read(text: str) -> tuple[object, str | None]:
    """The value of a JSON text, or why there is none."""
    try:
        value = json.loads(text, parse_float=_number, parse_constant=_constant)
        canonical(value)
        return value, None
    except OverflowError:
        return None, "have a number out of range"
    except RecursionError:
        return None, "are nested too deep"
    except ValueError:
        return None, "aren't JSON"


def _checked(arguments: object, schema: str) -> str | None:
    try:
        return "; ".join(problems(arguments, json.loads(schema))) or None
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
        return "the tool's schema can't be applied"


def _printable(text: str | None) -> str | None:
    return text if text is None else text.encode("utf-8", "backslashreplace").decode()


def _record(frame: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in frame.itertuples(index=False):
        arguments, why = (None, None) if r.arguments is None else _read(r.arguments)
        error = "no arguments" if r.arguments is None else "unknown tool" if r.schema is None else f"arguments {why}" if why else _checked(arguments, r.schema)
        out.append((_printable(error), canonical({"arguments": arguments, "id": r.call_id, "name": r.tool, "result": r.content})))
    return pd.DataFrame(out, columns=["error", "json"])


def _parts(df: DataFrame) -> int:
    """Edges are small rows: two partitions a core hold them, however many the shuffles have."""
    return 2 * df.sparkSession.sparkContext.defaultParallelism


def levels_in_rounds(edges: DataFrame) -> DataFrame:
    """id, level of each end of the distinct ``edges(id, needs)`` that lies on no cycle nor behind one: 0 without needs, else one more than the most of its needs.

    One round for each level: the ends that the round before completed are joined with the edges, and the open needs counted down.
    """
    parts = _parts(edges)
    open_ = checkpoint(edges.groupBy("id").agg(F.count(F.lit(1)).alias("open")).coalesce(parts))
    ready = checkpoint(edges.select(F.col("needs").alias("id")).distinct().join(open_, "id", "left_anti").withColumn("level", F.lit(0)).coalesce(parts))
    done, level = ready, 0
    while ready.limit(1).count():
        level += 1
        met = edges.join(ready.select(F.col("id").alias("needs")), "needs").groupBy("id").agg(F.count(F.lit(1)).alias("met"))
        state = checkpoint(open_.join(met, "id", "left").select("id", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")).coalesce(parts))
        ready, open_ = state.where("open = 0").select("id", F.lit(level).alias("level")), state.where("open > 0")
        done = done.unionByName(ready)
    return done


def order(edges: list[tuple[str, str]]) -> dict[str, int]:
    """Level of each end of (id, needs) that lies on no cycle nor behind one."""
    open_, behind = defaultdict(int), defaultdict(list)
    for ident, needs in edges:
        open_[ident] += 1
        behind[needs].append(ident)
    ready, level, out = [x for x in behind if x not in open_], 0, {}
    while ready:
        out.update(dict.fromkeys(ready, level))
        after = []
        for x in ready:
            for y in behind.get(x, ()):
                open_[y] -= 1
                if not open_[y]:
                    after.append(y)
        ready, level = after, level + 1
    return out


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of conversation, which has CONV_NEEDS at most."""

    def made(edges: list[tuple[str, str]]) -> pa.RecordBatch:
        found = order(edges)
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int32())], names=["id", "level"])

    last, edges = None, []
    for batch in batches:
        for conv, ident, needs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != last and len(edges) >= 10_000:  # ends have their conversation in them: several can be ordered together
                yield made(edges)
                edges = []
            last = conv
            edges.append((ident, needs))
    yield made(edges)


def levels(edges: DataFrame, most: int = CONV_NEEDS) -> DataFrame:
    """id, level of each end of the distinct ``edges(conv, id, needs)`` that lies on no cycle nor behind one: 0 without needs, else one more than the most of its needs.

    No edge leads to another conversation. A conversation of up to ``most`` edges is ordered where its edges meet, a
    larger one in rounds.
    """
    large = checkpoint(edges.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("conv"))
    if not large.limit(1).count():
        return edges.repartition("conv").sortWithinPartitions("conv").mapInArrow(_ordered, "id string, level int")
    small = levels(edges.join(large, "conv", "left_anti").select("conv", "id", "needs"), most)
    return small.unionByName(levels_in_rounds(edges.join(large, "conv", "left_semi").select("id", "needs")))


def link(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """conv_id, call_id, level, place, status, valid, error and json for each call, and for each result without a call.

    ``calls(conv_id, turn, call_id, tool, arguments, needs)`` with JSON text in arguments and an array of call_ids in
    needs; ``results(conv_id, call_id, content)``; ``tools(tool, schema)``. status: ``linked``, ``unanswered``,
    ``orphan`` (a result without a call, or without call_id), ``unidentified`` (a call without call_id, which links with
    nothing). Those without call_id have a row each. Of calls
    or results that share conv_id and call_id the smallest counts, and needs are those of all of them. level counts the needs
    below a call in its conversation; needs that name no call are ignored; NULL on or behind a cycle. place numbers a
    conversation's calls by level, turn and call_id, NULL levels last. valid: the arguments are JSON that keeps to the
    tool's schema; error says what does not, be it the arguments, an unknown tool or a schema that can't be applied.
    Arguments that can't be read are null in json. Empty tables give the rows of the others; extra columns are ignored.
    """
    key = ["conv_id", "call_id"]
    named = calls.where("call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "tool", "arguments")).alias("call")).select(*key, "call.*")
    answered = results.where("call_id is not null").groupBy(*key).agg(F.min("content").alias("content"), F.lit(True).alias("answer"))
    ident = F.to_json(F.struct("conv_id", "call_id"))
    needs = calls.where("call_id is not null").select("conv_id", "call_id", F.explode("needs").alias("n")).where("n is not null")
    ids = named.select(ident.alias("needs"))
    edges = needs.select(F.to_json(F.struct("conv_id")).alias("conv"), ident.alias("id"), F.to_json(F.struct("conv_id", F.col("n").alias("call_id"))).alias("needs")).join(ids, "needs", "left_semi").select("conv", "id", "needs")
    edges = checkpoint(edges.distinct().coalesce(_parts(edges)))
    level = levels(edges)
    bound = edges.select("id").union(edges.select("needs")).distinct().withColumn("bound", F.lit(True))
    joined = named.withColumn("known", F.lit(True)).alias("c").join(answered.alias("r"), F.expr("c.conv_id <=> r.conv_id AND c.call_id = r.call_id"), "full")
    rows = joined.select(F.coalesce("c.conv_id", "r.conv_id").alias("conv_id"), F.coalesce("c.call_id", "r.call_id").alias("call_id"), "turn", "tool", "arguments", "content", F.when(F.col("known").isNull(), "orphan").when(F.col("answer"), "linked").otherwise("unanswered").alias("status"))
    rows = rows.withColumn("id", ident).join(level, "id", "left").join(bound, "id", "left").withColumn("level", F.when(F.col("status") != "orphan", F.when(F.col("bound"), F.col("level")).otherwise(F.lit(0)))).drop("id", "bound")
    lost = calls.where("call_id is null").select("conv_id", "call_id", "turn", "tool", "arguments", F.lit(None).cast("string").alias("content"), F.lit("unidentified").alias("status"), F.lit(None).cast("int").alias("level"))
    astray = results.where("call_id is null").select("conv_id", "call_id", *[F.lit(None).cast(calls.schema[c].dataType).alias(c) for c in ("turn", "tool", "arguments")], "content", F.lit("orphan").alias("status"), F.lit(None).cast("int").alias("level"))
    rows = rows.unionByName(lost).unionByName(astray).join(tools.groupBy("tool").agg(F.min("schema").alias("schema")), "tool", "left")
    w = Window.partitionBy("conv_id").orderBy(F.col("status").isin("orphan", "unidentified"), F.col("level").asc_nulls_last(), "turn", "call_id")
    made = rows.withColumn("place", F.row_number().over(w)).withColumn("record", F.pandas_udf(_record, "error string, json string")(F.struct("call_id", "tool", "arguments", "content", "schema")))
    return made.select("conv_id", "call_id", "level", "place", "status", F.when(F.col("status") != "orphan", F.col("record.error").isNull()).alias("valid"), F.when(F.col("status") != "orphan", F.col("record.error")).alias("error"), F.col("record.json").alias("json"))


#: The one tool of a plain conversation: what a user's turn asks for.
REPLY_SCHEMA = {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["prompt", "turn"], "additionalProperties": False}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and tools of plain conversations(conv_id, turn, role, text).

    A user's turn is a call of the tool ``reply``, with the turn's number as call_id, that needs the user's turn two
    before; an assistant's turn is the result of the turn before. Other roles have neither.
    """
    ident = lambda k: (F.col("turn") - k).cast("string")
    args = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"), {"ignoreNullFields": "false"})
    calls = turns.where("role = 'user'").select("conv_id", "turn", ident(0).alias("call_id"), F.lit("reply").alias("tool"), args.alias("arguments"), F.array(ident(2)).alias("needs"))
    results = turns.where("role = 'assistant'").select("conv_id", ident(1).alias("call_id"), F.col("text").alias("content"))
    tools = turns.sparkSession.range(1).select(F.lit("reply").alias("tool"), F.lit(canonical(REPLY_SCHEMA)).alias("schema"))
    return calls, results, tools
