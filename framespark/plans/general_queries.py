"""Queries of the general problems 2, 3 and 5, over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespark.functions.identity import NOBODY
from framespark.operators.plausible import flags, implausible, innovations
from framespark.operators.sessions import session_openers, speaker_totals
from framespark.operators.shred import OBJECT_ARRAYS, entity, field_arrays, links, number_arrays, paths, records, shred
from framespark.plans.cuts import cut
from framespark.sources.tables import table


def p2_found(spark, d):
    return session_openers(table(spark, d, "utterances")).distinct()


def p2_totals(spark, d):
    return speaker_totals(table(spark, d, "utterances"))


def p3_found(spark, d):
    nodes = cut(shred(records(table(spark, d, "feature_props"), "props_id", "properties"), "record", "properties"), "nodes")
    return links(paths(nodes, "record"), "record").select("record.props_id", "child_path", "parent_path").distinct()


def _nodes(spark, d):
    props = table(spark, d, "feature_props")
    one = props.groupBy("props_id").agg(F.max_by("properties", F.struct("written_at", "properties")).alias("properties"))
    return cut(shred(one, "props_id", "properties"), "nodes")


def _linked(nodes):
    return links(paths(nodes, "props_id"), "props_id")


def _entity(label, **fields):
    def query(spark, d):
        nodes = _nodes(spark, d)
        return entity(nodes, _linked(nodes), "props_id", label, fields)

    return query


def p3_stats(spark, d):
    nodes = _nodes(spark, d)
    return number_arrays(nodes, paths(nodes, "props_id"), "props_id", "stats")


def p3_step_columns(spark, d):
    """The columns of the steps in ``p3_steps``, by the step's path."""
    nodes = _nodes(spark, d)
    return field_arrays(nodes, _linked(nodes), "props_id", "pipeline", "columns", "int")


def p3_nodes(spark, d):
    """Every value, by the path of the object or array that holds it: the root has none."""
    nodes = _nodes(spark, d)
    above = paths(nodes, "props_id").select(F.col("props_id").alias("_of"), F.col("node").alias("_at"), F.col("path").alias("holder"))
    same = F.col("props_id").eqNullSafe(F.col("_of")) & (F.col("parent") == F.col("_at"))
    return nodes.join(above, same, "left").select("props_id", "holder", "label", "ordinal", "kind", "scalar")


def p5_method(spark, d):
    """The filter alone over the whole table: withheld readings and vanishing innovations, without exact checks, ranges and grid."""
    return innovations(table(spark, d, "features"))


def p5_found(spark, d):
    return implausible(table(spark, d, "features")).distinct()


def p5_flags(spark, d):
    return flags(table(spark, d, "features"))


#: Tables of objects: the arrays' label and the fields with their types.
ENTITIES = {
    "p3_steps": ("pipeline", {"name": "string"}),
    "p3_bands": ("bands", {"low": "double", "high": "double"}),
    "p3_channels": ("channels", {"index": "int", "gain": "double"}),
    "p3_iterations": ("iterations", {"iter": "int"}),
    "p3_warps": ("warps", {"speaker": "string", "warp": "double"}),
    "p3_gaussians": ("gaussians", {"g": "int", "weight": "double", "mean": "double"}),
    "p3_candidates": ("candidates", {"lag": "int", "score": "double"}),
}

QUERIES = {
    "p2_found": p2_found,
    "p2_totals": p2_totals,
    "p3_found": p3_found,
    "p3_nodes": p3_nodes,
    **{name: _entity(label, **fields) for name, (label, fields) in ENTITIES.items()},
    "p3_step_columns": p3_step_columns,
    "p3_stats": p3_stats,
    "p5_method": p5_method,
    "p5_found": p5_found,
    "p5_flags": p5_flags,
}

def _read(x: str) -> str:
    """A string that holds JSON is read as that."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({x} ->> '$', '^\\s*[{{\\[]') AND json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) ELSE {x} END"


_FIELD, _ELEMENT = "json_extract(j, '$.\"' || k || '\"')", "json_extract(j, '$[' || CAST(i AS VARCHAR) || ']')"
_BOXED = f"CASE WHEN k IN {OBJECT_ARRAYS!r} AND json_type({_read(_FIELD)}) = 'OBJECT' THEN CAST('[' || CAST({_read(_FIELD)} AS VARCHAR) || ']' AS JSON) ELSE {_read(_FIELD)} END"


def _tree(rows: str) -> str:
    """All values of the records of ``rows``: their path, what holds them, the nearest object, label, ordinal."""
    return f"""
WITH RECURSIVE src AS ({rows}),
t AS (SELECT props_id, '$' AS path, NULL::VARCHAR AS holder, NULL::VARCHAR AS owner, NULL::VARCHAR AS label, NULL::INT AS ordinal, {_read("CAST(properties AS JSON)")} AS j FROM src WHERE json_valid(properties)
UNION ALL
SELECT props_id, CASE WHEN c.i IS NOT NULL THEN path || '[' || CAST(c.i AS VARCHAR) || ']' WHEN path = '$' THEN c.k ELSE path || '.' || c.k END, path, CASE WHEN json_type(j) = 'OBJECT' THEN path ELSE owner END, coalesce(c.k, label), CAST(c.i AS INT), c.v
FROM (SELECT *, unnest(CASE json_type(j) WHEN 'OBJECT' THEN list_transform(json_keys(j), lambda k: {{'k': k, 'i': NULL::BIGINT, 'v': {_BOXED}}})
  WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(j) AS BIGINT)), lambda i: {{'k': NULL::VARCHAR, 'i': i, 'v': {_read(_ELEMENT)}}}) END) AS c FROM t WHERE json_type(j) IN ('OBJECT', 'ARRAY')))
"""


_HELD = _tree("SELECT props_id, properties FROM (SELECT *, row_number() OVER (PARTITION BY props_id ORDER BY written_at DESC, properties DESC) AS r FROM feature_props) WHERE r = 1")


def _entity_sql(label: str, **fields: str) -> str:
    types = {"string": "VARCHAR", "double": "DOUBLE", "int": "INT"}
    atom = lambda f: f"CASE WHEN json_type(json_extract(j, '$.{f}')) NOT IN ('OBJECT', 'ARRAY') THEN TRY_CAST(json_extract_string(j, '$.{f}') AS {types[fields[f]]}) END AS {f}"
    return f"{_HELD} SELECT props_id, path, owner AS parent_path, ordinal, {', '.join(map(atom, fields))} FROM t WHERE label = '{label}' AND ordinal IS NOT NULL AND json_type(j) = 'OBJECT'"


_SPOKEN = rf"""
WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY ingested_at DESC) AS r FROM utterances) WHERE r = 1),
k AS (SELECT utt_id, duration, recorded_at, regexp_replace(lower(speaker), '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g') AS spk FROM h WHERE speaker IS NOT NULL),
l AS (SELECT *, lag(recorded_at) OVER (PARTITION BY spk ORDER BY recorded_at NULLS LAST, utt_id) AS p FROM k WHERE spk NOT IN {NOBODY!r}),
o AS (SELECT *, recorded_at IS NOT NULL AND (p IS NULL OR recorded_at - p > INTERVAL 30 MINUTE) AS opens FROM l)
"""

ORACLE = {
    "p2_found": _SPOKEN + "SELECT DISTINCT utt_id FROM o WHERE opens",
    "p2_totals": _SPOKEN
    + """SELECT spk AS speaker_key, min(utt_id) AS first_utt, count(*) AS n_utts, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) AS BIGINT) AS n_sessions,
    CAST(round(sum(CAST(duration AS DECIMAL(18,4))), 2) AS DOUBLE) AS total_s, max(duration) AS longest_s FROM o GROUP BY spk""",
    "p3_found": _tree("SELECT props_id, properties FROM feature_props") + "SELECT DISTINCT props_id, path AS child_path, coalesce(owner, '$') AS parent_path FROM t WHERE ordinal IS NOT NULL AND json_type(j) = 'OBJECT'",
    "p3_nodes": _HELD
    + """SELECT props_id, holder, label, ordinal, CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'scalar' END AS kind,
    CASE WHEN json_type(j) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN j ->> '$' END AS scalar FROM t""",
    **{name: _entity_sql(label, **fields) for name, (label, fields) in ENTITIES.items()},
    "p3_step_columns": _HELD
    + """SELECT c.props_id, o.path, c.ordinal AS place, TRY_CAST(c.j ->> '$' AS INT) AS value FROM t c JOIN t a ON c.props_id = a.props_id AND c.holder = a.path JOIN t o ON a.props_id = o.props_id AND a.holder = o.path
    WHERE c.label = 'columns' AND c.ordinal IS NOT NULL AND json_type(c.j) NOT IN ('OBJECT', 'ARRAY') AND a.label = 'columns' AND a.ordinal IS NULL AND o.label = 'pipeline' AND o.ordinal IS NOT NULL AND json_type(o.j) = 'OBJECT'""",
    "p3_stats": _HELD
    + """SELECT c.props_id, a.holder AS path, a.ordinal AS row, c.ordinal AS col, TRY_CAST(c.j ->> '$' AS DOUBLE) AS value FROM t c JOIN t a ON c.props_id = a.props_id AND c.holder = a.path
    WHERE c.label = 'stats' AND c.ordinal IS NOT NULL AND json_type(c.j) NOT IN ('OBJECT', 'ARRAY', 'NULL') AND a.label = 'stats' AND a.ordinal IS NOT NULL AND json_type(a.j) = 'ARRAY'""",
}
