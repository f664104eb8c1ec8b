"""Nested semi-structured records as related flat tables, by adjacency-table shredding.

``shred`` stores every value of a record as a node: number, parent, label, ordinal in its array, kind and scalar, nothing
else. Where a node is (``paths``) and which object encloses it (``links``) come from joins of that table with itself
over ``parent``: each round doubles how far up a node has looked, so the rounds grow with the logarithm of the depth.
``entity`` joins object nodes with their scalar children and pivots them into one table per kind of object.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespark.plans.cuts import cut, discard

#: Fields that hold arrays of objects, where a single object stands for its element 0.
OBJECT_ARRAYS = ("pipeline", "bands", "channels", "iterations", "warps", "gaussians")

_WRAPPED = re.compile(r'\s*[{\["]')
NODES = "node int, parent int, label string, ordinal int, kind string, scalar string"
_FIELDS = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
_BLANK = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity")


def parse(text: str):
    """The value of a JSON text, however deep; ``ValueError`` of anything else."""
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)


def _deep(text: str):
    """The same with a stack of its own, for what is nested beyond the parser's."""
    skip = lambda i: _BLANK.match(text, i).end()

    def key_at(i: int):
        if text[i : i + 1] != '"':
            raise ValueError(f"no field name at {i}")
        key, i = scanstring(text, i + 1)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(f"no colon at {i}")
        return key, skip(i + 1)

    stack: list = []
    i = skip(0)
    while True:
        c = text[i : i + 1]
        if c in ("{", "["):
            box: dict | list = {} if c == "{" else []
            i = skip(i + 1)
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                key = None
                if c == "{":
                    key, i = key_at(i)
                stack.append((box, key))
                continue
            value, i = box, i + 1
        elif c == '"':
            value, i = scanstring(text, i + 1)
        elif m := _ATOM.match(text, i):
            value, i = json.loads(m[0]), m.end()
        else:
            raise ValueError(f"no value at {i}")
        while True:
            i = skip(i)
            if not stack:
                if i != len(text):
                    raise ValueError(f"more text at {i}")
                return value
            box, key = stack[-1]
            if key is None:
                box.append(value)
            else:
                box[key] = value
            c = text[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                if key is not None:
                    key, i = key_at(i)
                    stack[-1] = (box, key)
                break
            if c != ("]" if key is None else "}"):
                raise ValueError(f"no end at {i}")
            stack.pop()
            value, i = box, i + 1


def unwrap(value):
    """A string that holds JSON of an object or array is read as that, however often it was wrapped."""
    while isinstance(value, str) and _WRAPPED.match(value):
        try:
            inner = parse(value)
        except ValueError:
            return value
        if isinstance(inner, str) and not _WRAPPED.match(inner):
            return value
        value = inner
    return value


def readable(text: str | None):
    """(True, value) of a text with JSON; (False, None) of null or broken text."""
    if text is None:
        return False, None
    try:
        return True, unwrap(parse(text))
    except ValueError:
        return False, None


def nodes_of(value, arrays: frozenset[str]):
    """Yields the nodes of one record; an explicit stack, for depth is the data's."""
    number = 0
    stack = [(value, -1, None, None)]
    while stack:
        v, parent, label, ordinal = stack.pop()
        me, number = number, number + 1
        kind, scalar = type(v), None
        if kind is dict:
            kind, inner = "object", []
            for k, x in v.items():
                if type(x) is str:
                    x = unwrap(x)
                if type(x) is dict and k in arrays:
                    x = [x]
                inner.append((x, me, k, None))
            stack += inner[::-1]
        elif kind is list:
            kind = "array"
            stack += [(unwrap(x) if type(x) is str else x, me, label, i) for i, x in enumerate(v)][::-1]
        else:
            kind = "null" if v is None else "scalar"
            scalar = v if isinstance(v, str) else None if v is None else json.dumps(v)
        yield me, parent, label, ordinal, kind, scalar


def shred(df: DataFrame, key: str, text: str, arrays: tuple[str, ...] = OBJECT_ARRAYS) -> DataFrame:
    """The adjacency table ``key, node, parent, label, ordinal, kind, scalar`` of every readable ``text``.

    The root is node 0 with parent -1; kinds are ``object``, ``array``, ``scalar`` and ``null``. An element has its array's label.
    Null, empty and broken texts have no nodes; depth has no limit. Repeated rows come out as often as they
    go in: make them one with ``records`` before joining. Of a field written twice in one object the last holds. Other columns are not read.
    """
    kind_of = df.schema[key].dataType
    named = frozenset(arrays)

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                fine, value = readable(t)
                if not fine:
                    continue
                rows += nodes_of(value, named)
                at += [i] * (len(rows) - len(at))
                if len(rows) > 50_000:
                    yield packed(batch, at, rows)
                    at, rows = [], []
            yield packed(batch, at, rows)

    def packed(batch, at, rows):
        columns = zip(*rows) if rows else ([] for _ in _FIELDS)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *map(pa.array, columns, _FIELDS)], names)

    names = [key, *(x.split()[0] for x in NODES.split(", "))]
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind_of.simpleString()}, {NODES}")


def records(df: DataFrame, key: str, text: str) -> DataFrame:
    """``record``, a struct of ``key`` and its text's hash, and ``text``, each once.

    Repeats of a record that write it differently number their nodes differently and must not be joined; those that write it alike are
    one, by partial aggregation, so a key repeated in a third of all rows is no hot key of the joins.
    """
    one = df.select(F.struct(F.col(key).alias(key), F.xxhash64(text).alias("h")).alias("record"), F.col(text).alias(text))
    return one.groupBy("record").agg(F.first(text).alias(text))


def paths(nodes: DataFrame, key: str, most_rounds: int = 40) -> DataFrame:
    """``key, node, object, element, path, owner`` of the objects and arrays: whether it is an object, and in an array; its place, and the node of the nearest enclosing object (null: none).

    ``key`` must tell records apart, and ``nodes`` be read from files. A node knows the labels up to an ancestor and that ancestor;
    a round joins it with what the ancestor knows. ``$`` is the root; it is not written before fields. Paths of a record nested
    ``d`` deep are ``d * d / 2`` long together, as is their table.
    """
    edge = F.when(F.col("parent") < 0, F.lit("")).when(F.col("ordinal").isNull(), F.concat(F.lit("."), "label")).otherwise(F.concat(F.lit("["), F.col("ordinal").cast("string"), F.lit("]")))
    # a node without ordinal is a field, so what is above it is an object
    direct = F.when((F.col("parent") >= 0) & F.col("ordinal").isNull(), F.col("parent"))
    now = nodes.where("kind in ('object', 'array')").select(key, "node", (F.col("kind") == "object").alias("object"), F.col("ordinal").isNotNull().alias("element"), F.col("parent").alias("up"), edge.alias("path"), direct.alias("owner"))
    for _ in range(most_rounds):
        above = now.select(F.col(key).alias("_key"), F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("owner").alias("_owner"))
        joined = now.where("up >= 0").join(above, F.col(key).eqNullSafe(F.col("_key")) & (F.col("up") == F.col("_node")))
        higher = joined.select(key, "node", "object", "element", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"), F.coalesce("owner", "_owner").alias("owner"))
        last, now = now, cut(now.where("up < 0").unionByName(higher), "paths")
        discard(last)
        if not now.where("up >= 0").take(1):
            break
    else:
        raise RuntimeError("paths have not settled")
    named = F.when(F.col("path") == "", F.lit("$")).when(F.col("path").startswith("."), F.substring("path", 2, 2147483647)).otherwise(F.concat(F.lit("$"), "path"))
    return now.withColumn("path", named).drop("up")


def links(placed: DataFrame, key: str) -> DataFrame:
    """``key, node, child_path, parent_path`` of the objects that are elements of arrays, from ``paths``: joined with the object that encloses them."""
    child = placed.where("object and element").select(key, "node", "owner", F.col("path").alias("child_path"))
    parent = placed.where("object").select(F.col(key).alias("_key"), F.col("node").alias("_node"), F.col("path").alias("parent_path"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("owner") == F.col("_node"))
    return child.join(parent, same, "left").select(key, "node", "child_path", F.coalesce("parent_path", F.lit("$")).alias("parent_path"))


def entity(nodes: DataFrame, linked: DataFrame, key: str, label: str, fields: dict[str, str]) -> DataFrame:
    """The flat table of the objects in arrays named ``label``: key, path, parent_path, ordinal and ``fields`` (name to SQL type); ``linked`` are the records' ``links``.

    All sides of the joins and the pivot share the partitioning by (key, node). A scalar that its type can't hold is null.
    """
    objects = nodes.where((F.col("kind") == "object") & (F.col("label") == label) & F.col("ordinal").isNotNull())
    scalars = nodes.where((F.col("kind") == "scalar") & F.col("ordinal").isNull() & F.col("label").isin(*fields))
    scalars = scalars.select(F.col(key).alias("_key"), F.col("parent").alias("_node"), F.col("label").alias("_field"), F.col("scalar").alias("_value"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("node") == F.col("_node"))
    joined = objects.select(key, "node", "ordinal").join(scalars, same, "left")
    picked = [F.max(F.when(F.col("_field") == f, F.col("_value"))).try_cast(t).alias(f) for f, t in fields.items()]
    wide = joined.groupBy(key, "node").agg(F.first("ordinal").alias("ordinal"), *picked)
    place = linked.select(F.col(key).alias("_of"), F.col("node").alias("_at"), F.col("child_path").alias("path"), "parent_path")
    return wide.join(place, F.col(key).eqNullSafe(F.col("_of")) & (F.col("node") == F.col("_at"))).select(key, "path", "parent_path", "ordinal", *fields)


def number_arrays(nodes: DataFrame, placed: DataFrame, key: str, label: str) -> DataFrame:
    """Arrays of arrays of numbers named ``label`` in long form: ``key, path, row, col, value``; ``path`` is the outer array's."""
    inner = nodes.where((F.col("kind") == "array") & (F.col("label") == label) & F.col("ordinal").isNotNull()).select(F.col(key).alias("_key"), F.col("node").alias("_node"), F.col("ordinal").alias("row"), F.col("parent").alias("_outer"))
    cells = nodes.where((F.col("kind") == "scalar") & (F.col("label") == label) & F.col("ordinal").isNotNull()).select(key, "parent", F.col("ordinal").alias("col"), F.col("scalar").try_cast("double").alias("value"))
    outer = placed.where("not object").select(F.col(key).alias("_of"), F.col("node").alias("_at"), "path")
    within = cells.join(inner, F.col(key).eqNullSafe(F.col("_key")) & (F.col("parent") == F.col("_node")))
    return within.join(outer, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_outer") == F.col("_at"))).select(key, "path", "row", "col", "value")


def field_arrays(nodes: DataFrame, linked: DataFrame, key: str, label: str, field: str, kind: str) -> DataFrame:
    """Arrays in the field ``field`` of the objects in arrays named ``label``, in long form: ``key, path, place, value``; ``path`` is the object's. A value that its type can't hold is null."""
    objects = nodes.where((F.col("kind") == "object") & (F.col("label") == label) & F.col("ordinal").isNotNull()).select(F.col(key).alias("_key"), F.col("node").alias("_object"))
    arrays = nodes.where((F.col("kind") == "array") & (F.col("label") == field) & F.col("ordinal").isNull()).select(F.col(key).alias("_of"), F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    cells = nodes.where(F.col("kind").isin("scalar", "null") & (F.col("label") == field) & F.col("ordinal").isNotNull()).select(key, "parent", F.col("ordinal").alias("place"), F.col("scalar").try_cast(kind).alias("value"))
    within = cells.join(arrays, F.col(key).eqNullSafe(F.col("_of")) & (F.col("parent") == F.col("_node")))
    within = within.join(objects, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_parent") == F.col("_object")))
    place = linked.select(F.col(key).alias("_k"), F.col("node").alias("_at"), F.col("child_path").alias("path"))
    return within.join(place, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_object") == F.col("_at"))).select(key, "path", "place", "value")
