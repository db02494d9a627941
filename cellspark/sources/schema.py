"""Documents against a JSON Schema, compiled to Column expressions.

``rules`` turns a schema into a table of rules, each with one Column: the place in a parsed document (a variant) that
breaks it, or null. ``failures`` runs them over a table of documents. Nothing is collected and no document is a Python
object; arrays are walked by higher-order functions inside their row.

Keywords: type, const, enum, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minLength, maxLength,
pattern, minItems, maxItems, uniqueItems, items, required, properties, additionalProperties (false or a schema),
minProperties, maxProperties. Keywords that only describe are passed over; any other is an error when compiled, as a rule
that is not looked at would let documents through. As the standard has it, a keyword holds for values of another type than
its own, and 1.0 is an integer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DESCRIBING = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}
ITEMS, OTHERS = object(), object()


@dataclass(frozen=True)
class Rule:
    """A keyword at a place of a schema; ``broken`` gives the first place of a document that breaks it, or null."""

    path: str
    keyword: str
    argument: object
    broken: Callable[[Column], Column]


def _kind(v: Column) -> Column:
    """object, array, string, boolean, null, integer or number."""
    name = F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)
    whole = F.try_variant_get(v, "$", "double")
    return (
        F.when(name == "OBJECT", "object").when(name == "ARRAY", "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
        .when((name == "BIGINT") | (whole == F.floor(whole).cast("double")), "integer").otherwise("number")
    )


def _number(v: Column) -> Column:
    return F.when(_kind(v).isin("integer", "number"), F.try_variant_get(v, "$", "double"))


def _string(v: Column) -> Column:
    return F.when(_kind(v) == "string", F.try_variant_get(v, "$", "string"))


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _equal(v: Column, value) -> Column:
    if isinstance(value, str):
        same = _string(v) == value
    elif isinstance(value, bool):
        same = F.when(_kind(v) == "boolean", F.try_variant_get(v, "$", "boolean")) == value
    elif value is None:
        same = _kind(v) == "null"
    elif isinstance(value, (int, float)):
        same = _number(v) == float(value)
    else:
        same = F.to_json(v) == json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
    return F.coalesce(same, F.lit(False))


def _wrong(keyword: str, argument, siblings: set[str]) -> Callable[[Column], Column]:
    """Whether a value breaks a keyword; null where the keyword is not for its type."""
    if keyword == "type":
        names = [argument] if isinstance(argument, str) else list(argument)
        names += ["integer"] * ("number" in names)
        return lambda v: ~_kind(v).isin(*names)
    if keyword in ("const", "enum"):
        allowed = [argument] if keyword == "const" else list(argument)
        return lambda v: ~F.greatest(F.lit(False), *[_equal(v, a) for a in allowed], F.lit(False))
    number = {"minimum": lambda n: n < argument, "maximum": lambda n: n > argument, "exclusiveMinimum": lambda n: n <= argument, "exclusiveMaximum": lambda n: n >= argument, "multipleOf": lambda n: n % argument != 0}
    if keyword in number:
        return lambda v: number[keyword](_number(v))
    string = {"minLength": lambda s: F.length(s) < argument, "maxLength": lambda s: F.length(s) > argument, "pattern": lambda s: ~s.rlike(argument)}
    if keyword in string:
        return lambda v: string[keyword](_string(v))
    array = {"minItems": lambda a: F.size(a) < argument, "maxItems": lambda a: F.size(a) > argument}
    if keyword in array:
        return lambda v: F.when(_array(v).isNotNull(), array[keyword](_array(v)))
    if keyword == "uniqueItems":
        texts = lambda v: F.transform(_array(v), lambda x: F.to_json(x))
        return lambda v: F.when(_array(v).isNotNull() & F.lit(bool(argument)), F.size(F.array_distinct(texts(v))) < F.size(_array(v)))
    entries = {"minProperties": lambda m: F.size(m) < argument, "maxProperties": lambda m: F.size(m) > argument}
    if keyword in entries:
        return lambda v: F.when(_object(v).isNotNull(), entries[keyword](_object(v)))
    if keyword == "required":
        return lambda v: F.when(_object(v).isNotNull(), ~F.map_contains_key(_object(v), argument))
    if keyword == "additionalProperties":
        known = F.array(*map(F.lit, sorted(siblings))) if siblings else F.array().cast("array<string>")
        return lambda v: F.when(_object(v).isNotNull(), F.size(F.array_except(F.map_keys(_object(v)), known)) > 0)
    raise ValueError(f"keyword {keyword!r} is not known")


def _at(segments: tuple, siblings: set[str], wrong: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """From a value and its path to the first path at or below it that breaks a rule."""
    if not segments:
        return lambda v, path: F.when(wrong(v), path)
    below = _at(segments[1:], siblings, wrong)
    if segments[0] is ITEMS:
        return lambda v, path: F.get(F.filter(F.transform(_array(v), lambda x, i: below(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))), lambda p: p.isNotNull()), F.lit(0))
    name = segments[0]
    return lambda v, path: F.when(F.try_element_at(_object(v), F.lit(name)).isNotNull(), below(F.try_element_at(_object(v), F.lit(name)), F.concat(path, F.lit(f".{name}"))))


def rules(schema: dict, segments: tuple = (), path: str = "$") -> Iterator[Rule]:
    """The rules of a schema, those of a place before those below it."""
    properties = schema.get("properties", {})
    for keyword, argument in schema.items():
        if keyword in DESCRIBING or keyword in ("properties", "items") or keyword == "additionalProperties" and argument is True:
            continue
        if keyword == "additionalProperties" and argument is not False:
            raise ValueError("additionalProperties must be true or false")
        for one in argument if keyword == "required" else [argument]:
            find = _at(segments, set(), _wrong(keyword, one, set(properties)))
            yield Rule(path, keyword, one, lambda v, find=find: find(v, F.lit("$")))
    for name, own in properties.items():
        yield from rules(own, (*segments, name), f"{path}.{name}")
    if "items" in schema:
        yield from rules(schema["items"], (*segments, ITEMS), f"{path}[*]")


def failures(docs: DataFrame, schema: dict, column: str = "json", also: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """The columns of ``docs`` but ``column``, with path and keyword of every rule that a row's document breaks.

    A document that is no JSON, or null, breaks the rule ``json`` at ``$``, and no other. ``also`` names further rules of
    whole documents: from the variant to whether it breaks them."""
    parsed = docs.withColumn("_v", F.try_parse_json(column)).drop(column)
    v = F.col("_v")
    broken = [F.struct(F.when(v.isNull(), "$").alias("path"), F.lit("json").alias("keyword"))]
    broken += [F.struct(F.when(v.isNotNull(), r.broken(v)).alias("path"), F.lit(r.keyword).alias("keyword")) for r in rules(schema)]
    broken += [F.struct(F.when(wrong(v), "$").alias("path"), F.lit(name).alias("keyword")) for name, wrong in (also or {}).items()]
    found = F.filter(F.array(*broken), lambda b: b["path"].isNotNull())
    return parsed.select(*[c for c in parsed.columns if c != "_v"], F.inline(found))


def gold_segments(points: int = 32) -> tuple[dict, dict[str, Callable[[Column], Column]]]:
    """Schema and further rules of a segment document: rings of ``points`` pairs of numbers, and their count."""
    pair = {"type": "array", "minItems": 2, "maxItems": 2, "items": {"type": "number"}}
    ring = {"type": "array", "minItems": points, "maxItems": points, "items": pair}
    schema = {"type": "object", "required": ["cells", "cell_count"], "properties": {"cell_count": {"type": "integer"}, "cells": {"type": "array", "minItems": 1, "items": ring}}}
    count = lambda v: F.try_variant_get(v, "$.cell_count", "bigint") != F.size(F.try_variant_get(v, "$.cells", "array<variant>"))
    return schema, {"cell_count": count}
