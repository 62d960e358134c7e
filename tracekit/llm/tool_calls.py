"""Tool-call linking for chat data, on DataFrame functions alone.

Calls and results are joined by conversation and identifier. A call may depend on several others; calls are put into
topological order by the longest chain of calls before them. Stretches in which each call depends on one other are
shortened by doubling pointers, so a chain of n calls takes log(n) joins; where several dependencies then
lead to one and the same call, the longest stands for them, and so on until none is left.
Arguments are parsed and validated against the tools' schemas, nested ones too, and each call with its result
is written as canonical JSON: sorted keys, no spaces, whole numbers without a fraction.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekit.llm.shared import numbered, stored

#: JSON types of a schema and the variant types that satisfy them; whole numbers of other types are integers too.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL", "FLOAT"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"], "null": ["VOID"]}
#: What a chain that is a circle, or leads to one, counts.
ENDLESS = 1 << 40


def depths(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, call, depth) of the distinct calls (conv, call): how many calls stand before it in the longest chain of edges (conv, call, parent); null in or behind a circle.

    Edges to or from calls that don't exist count for nothing.
    """
    nodes = calls.select("conv", "call").distinct()
    known = edges.where("parent is not null").select("conv", "call", F.col("parent").alias("up")).join(nodes.withColumnRenamed("call", "up"), ["conv", "up"], "left_semi")
    # a call without any hangs on the ground, a null
    todo = nodes.join(known.withColumn("w", F.lit(1).cast("long")), ["conv", "call"], "left").select("conv", "call", "up", F.coalesce("w", F.lit(0).cast("long")).alias("w"))
    told: list[DataFrame] = []
    while True:
        todo = todo.groupBy("conv", "call", "up").agg(F.max("w").alias("w"))
        ways = todo.groupBy("conv", "call").agg(F.count("*").alias("ways"), F.max("up").alias("up"), F.max("w").alias("w"))
        # the calls with one way; of the others, ways are looked up again below
        one = stored(ways.where("ways = 1").select("conv", "call", "up", "w"), "chain")
        many = stored(todo.join(ways.where("ways > 1").select("conv", "call"), ["conv", "call"], "left_semi"), "ways")
        left = many.isEmpty()
        if one.isEmpty():
            if not left:  # only circles are left
                told.append(many.select("conv", "call").distinct().select("conv", "call", F.lit(None).cast(nodes.schema["call"].dataType).alias("up"), F.lit(ENDLESS).alias("w")))
            break
        told.append(_shortened(one))
        if left:
            break
        on = told[-1].select("conv", F.col("call").alias("up"), F.col("up").alias("next"), F.col("w").alias("more"))
        todo = many.join(on, ["conv", "up"], "left").select("conv", "call", F.when(F.col("more").isNull(), F.col("up")).otherwise(F.col("next")).alias("up"), F.least(F.col("w") + F.coalesce("more", F.lit(0)), F.lit(ENDLESS)).alias("w"))
    out = None
    for part in reversed(told):
        if out is None:
            out = part.select("conv", "call", F.col("w").alias("depth"))
            continue
        on = out.select("conv", F.col("call").alias("up"), F.col("depth").alias("more"))
        out = stored(out.union(part.join(on, ["conv", "up"], "left").select("conv", "call", (F.col("w") + F.coalesce("more", F.lit(0))).alias("depth"))), "depths")
    if out is None:
        return nodes.withColumn("depth", F.lit(None).cast("long"))
    return out.select("conv", "call", F.when(F.col("depth") < ENDLESS, F.col("depth")).alias("depth"))


def _shortened(one: DataFrame) -> DataFrame:
    """The rows (conv, call, up, w) with pointers that lead to no other row any more, and the sums of their weights; circles lead to the ground, endlessly."""
    now, reach, most = one, 1, None
    while True:
        on = now.select("conv", F.col("call").alias("up"), F.col("up").alias("next"), F.col("w").alias("more"))
        both = now.join(on, ["conv", "up"], "left")
        goes = F.col("more").isNotNull()
        now = stored(both.select("conv", "call", F.when(goes, F.col("next")).otherwise(F.col("up")).alias("up"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), (goes & F.col("next").isNotNull()).alias("live")), "chain")
        reach *= 2
        live = now.where("live")
        if live.isEmpty():
            return now.drop("live")
        if most is None:
            most = now.groupBy("conv").count().agg(F.max("count")).first()[0]
        if reach > 2 * most:  # of a chain shorter than what the pointers span, none is left; a circle never ends
            ends = now.select("conv", F.col("call").alias("up"), F.lit(True).alias("on"))
            circle = F.coalesce("on", F.lit(False))
            return now.join(ends, ["conv", "up"], "left").select("conv", "call", F.when(~circle, F.col("up")).alias("up"), F.when(circle, F.lit(ENDLESS)).otherwise(F.col("w")).alias("w"))
        now = now.drop("live")


def _kind(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit("VOID"))


def canonical(text: Column) -> Column:
    """JSON text in which whole numbers are written without a fraction (1.0 and 1.0E0 as 1); strings stay."""
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|(?<![0-9.])(-?[0-9]++)\.0++(?:E0)?(?![0-9.E])', "$1$2")


def problems(value: Column, schema: dict, path: Column) -> Column:
    """Messages about a variant: "type" (one or a list of them), "enum", "properties", "required" and "additionalProperties" (false, if not said) of objects, "items" of arrays, at all depths."""
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else list(types)
    kind = _kind(value)
    nothing = F.array().cast("array<string>")
    found: list[Column] = []
    if types:
        good = kind.isin([v for t in types for v in TYPES[t]])
        if "integer" in types:
            number = F.try_variant_get(value, "$", "double")
            good = good | (kind.isin(TYPES["number"]) & F.coalesce(number == F.floor(number), F.lit(False)))
        found.append(F.when(~good, F.array(F.concat(path, F.lit(": not " + " or ".join(types))))).otherwise(nothing))
    if "enum" in schema:
        known = [json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for x in schema["enum"]]
        found.append(F.when(~canonical(F.coalesce(F.to_json(value), F.lit("null"))).isin(known), F.array(F.concat(path, F.lit(": not one of the values")))).otherwise(nothing))
    if "properties" in schema or "required" in schema:
        fields = F.try_variant_get(value, "$", "map<string, variant>")
        props = schema.get("properties", {})
        begin = F.when(F.length(path) > 0, F.concat(path, F.lit("."))).otherwise(F.lit(""))
        inside: list[Column] = [nothing]
        for p in sorted({*props, *schema.get("required", [])}):
            at = F.concat(begin, F.lit(p))
            missing = F.array(F.concat(at, F.lit(": missing"))) if p in schema.get("required", []) else nothing
            inside.append(F.when(F.map_contains_key(fields, p), problems(fields[p], props.get(p, {}), at)).otherwise(missing))
        if not schema.get("additionalProperties", False):
            more = F.array_except(F.map_keys(fields), F.array(*[F.lit(p) for p in sorted(props)]).cast("array<string>"))
            inside.append(F.transform(more, lambda f: F.concat(begin, f, F.lit(": unknown"))))
        found.append(F.when(kind == "OBJECT", F.concat(*inside)).otherwise(nothing))
    if "items" in schema:
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda e, i: problems(e, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.when(kind == "ARRAY", F.flatten(each)).otherwise(nothing))
    return F.concat(*found) if found else nothing


def argument_errors(schemas: dict[str, dict], tool: str, arguments: Column) -> Column:
    """Messages about parsed arguments (a variant column) of the tool in column ``tool``, sorted; empty if they are valid."""
    out = F.array(F.lit("unknown tool"))
    for name, schema in sorted(schemas.items()):
        out = F.when(F.col(tool) == name, F.array_sort(problems(arguments, schema, F.lit("")))).otherwise(out)
    return F.when(arguments.isNull() | (_kind(arguments) != "OBJECT"), F.array(F.lit("no JSON object"))).otherwise(out)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], edges: DataFrame | None = None) -> DataFrame:
    """(conv, call, place, depth, tool, valid, errors, linked, json) for each call of calls (conv, call, tool, arguments string; parent, if there are no edges) with results (conv, call, content).

    ``edges`` (conv, call, parent) tell the calls that a call depends on. place numbers the calls of a conversation from 0 in topological order: by depth, then by identifier; calls in or behind a circle come last, with a null depth.
    Calls that repeat an identifier are one: the one whose arguments sort first; of several results of a call the one that sorts first is taken, and results without a call are dropped. linked tells whether there is a
    result. json has the keys arguments (the text itself if it is no JSON, as is a text that names a key twice), call, errors (if any), name, result (null without one). Calls with a null identifier
    or conversation are dropped, as they can be linked to nothing; null arguments and tools count as empty; texts are taken whole. Empty tables give an empty result. Other columns are ignored.
    """
    named = calls.where("conv is not null and call is not null")
    named = named if edges is None else named.withColumn("parent", F.lit(None).cast(calls.schema["call"].dataType))
    one = named.groupBy("conv", "call").agg(F.min(F.struct(F.coalesce("arguments", F.lit("")).alias("arguments"), F.coalesce("tool", F.lit("")).alias("tool"), "parent")).alias("c")).select("conv", "call", "c.parent", "c.tool", "c.arguments")
    got = results.where("conv is not null and call is not null").groupBy("conv", "call").agg(F.min(F.coalesce("content", F.lit(""))).alias("content"), F.lit(True).alias("linked"))
    deep = depths(one, one.select("conv", "call", "parent") if edges is None else edges.select("conv", "call", "parent"))
    # places by a sort of identifiers over all conversations, so that none is one task, and no text is moved
    at = numbered(deep, ["conv", F.coalesce("depth", F.lit(ENDLESS)), "call"], "at")
    at = at.join(at.groupBy("conv").agg(F.min("at").alias("first")), "conv").select("conv", "call", "depth", (F.col("at") - F.col("first")).alias("place"))
    both = one.drop("parent").join(at, ["conv", "call"]).join(got, ["conv", "call"], "left").withColumn("parsed", F.try_parse_json("arguments"))
    both = both.withColumn("errors", argument_errors(schemas, "tool", F.col("parsed")))
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    text = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.to_json("parsed")), quoted(F.col("arguments"))), F.lit(',"call":'), quoted(F.col("call").cast("string")),
        F.when(F.size("errors") > 0, F.concat(F.lit(',"errors":'), F.to_json("errors"))).otherwise(F.lit("")),
        F.lit(',"name":'), quoted(F.col("tool")), F.lit(',"result":'), F.coalesce(quoted(F.col("content")), F.lit("null")), F.lit("}"),
    )
    return both.select("conv", "call", "place", "depth", "tool", (F.size("errors") == 0).alias("valid"), "errors", F.coalesce("linked", F.lit(False)).alias("linked"), text.alias("json"))
