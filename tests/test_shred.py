import json

import pytest

from framespark.operators.shred import entity, links, number_arrays, parse, paths, records, shred
from framespark.plans.cuts import cut

SCHEMA = "props_id bigint, properties string, node string, owner int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t if t is None or isinstance(t, str) else json.dumps(t), "clash", 1) for i, t in texts], SCHEMA)


def found(df):
    nodes = cut(shred(df, "props_id", "properties"), "nodes")
    return sorted((r.props_id if r.props_id is not None else -1, r.child_path, r.parent_path) for r in links(paths(nodes, "props_id"), "props_id").collect())


def test_paths(spark):
    nested = {"pipeline": {"name": "x"}, "a": {"b": [None, {"c": [{"d": 1}, 2]}]}, "candidates": [[{"lag": 1}], [], [{"lag": 2}, {"lag": 3}]], "q": {"warps": {"w": 1}}, "not_array": {"x": {}}}
    want = [
        ("a.b[1]", "a"), ("a.b[1].c[0]", "a.b[1]"), ("candidates[0][0]", "$"), ("candidates[2][0]", "$"), ("candidates[2][1]", "$"), ("pipeline[0]", "$"), ("q.warps[0]", "q"),
    ]
    assert found(frame(spark, [(1, nested)])) == sorted((1, *w) for w in want)


def test_wrapped_and_unreadable(spark):
    inner = {"bands": json.dumps([{"low": 1}]), "audio": json.dumps({"channels": {"gain": 2}}), "note": "[not json", "s": '"[1]"'}
    rows = [(1, json.dumps(json.dumps(inner))), (2, "{"), (3, None), (4, ""), (5, "null"), (6, "[]"), (7, '"text"'), (8, "[" * 100_000), (None, inner)]
    want = [("audio.channels[0]", "audio"), ("bands[0]", "$")]
    assert found(frame(spark, rows)) == sorted((i, *w) for i in (1, -1) for w in want)
    assert found(frame(spark, [])) == []


def test_entities(spark):
    p = {"pipeline": [{"name": "mfcc", "columns": [0, 12]}, None, {"name": 3}], "cmvn": {"stats": [[1.5, 2], [], [3]]}, "gaussians": [{"weight": "x"}]}
    nodes = cut(shred(frame(spark, [(1, p), (2, {}), (None, p)]), "props_id", "properties"), "nodes")
    placed = paths(nodes, "props_id")
    linked = links(placed, "props_id")
    steps = {(r.props_id, r.ordinal): (r.name, r.path, r.parent_path) for r in entity(nodes, linked, "props_id", "pipeline", {"name": "string"}).collect()}
    assert steps == {(k, i): (n, f"pipeline[{i}]", "$") for k in (1, None) for i, n in ((0, "mfcc"), (2, "3"))}
    assert [r.weight for r in entity(nodes, linked, "props_id", "gaussians", {"weight": "double"}).collect()] == [None, None]
    cells = sorted((r.path, r.row, r.col, r.value) for r in number_arrays(nodes, placed, "props_id", "stats").where("props_id = 1").collect())
    assert cells == [("cmvn.stats", 0, 0, 1.5), ("cmvn.stats", 0, 1, 2.0), ("cmvn.stats", 2, 0, 3.0)]


def test_depth(spark):
    """Deeper than the parser's own stack: read, numbered and linked; broken at depth is unreadable."""
    deep = 300
    nested = '{"a":[' * deep + "1" + "]}" * deep
    got = found(frame(spark, [(1, nested), (2, nested[:-1])]))
    assert len(got) == deep - 1 and max(got, key=lambda r: len(r[1]))[1:] == ("a[0]" + ".a[0]" * (deep - 2), ("a[0]" + ".a[0]" * (deep - 3)))
    very = 200_000
    value = parse("[" * very + '{"x": [1, -2.5e3, "q\\"]", null, true, {}, []]}' + "]" * very)
    for _ in range(very):
        (value,) = value
    assert value == {"x": [1, -2500.0, 'q"]', None, True, {}, []]}
    for wrong in ("]", ',"x"]', '{"a" 1}', "{1: 2}", "[1 2]", "[tru]", ""):
        with pytest.raises(ValueError):
            parse("[" * very + wrong)
    assert shred(frame(spark, [(1, "[" * very + "]" * very)]), "props_id", "properties").count() == very


def test_nodes_rebuild_the_record(spark):
    p = {"a": [1, {"b": None, "c": [[], {}]}], "d": {"e": "x"}}
    rows = shred(frame(spark, [(1, p)]), "props_id", "properties").collect()
    made = {}
    for r in sorted(rows, key=lambda r: r.node):
        v = {} if r.kind == "object" else [] if r.kind == "array" else None if r.kind == "null" else (json.loads(r.scalar) if r.scalar.isdigit() else r.scalar)
        made[r.node] = v
        if r.parent >= 0:
            up = made[r.parent]
            up.append(v) if isinstance(up, list) else up.__setitem__(r.label, v)
    assert made[0] == p


def test_repeats(spark):
    """A record written in two ways, each many times: numbered apart, joined once."""
    a = {"x": {"y": 1}, "bands": [{"low": 1}], "q": {"warps": [{"w": 2}]}}
    b = dict(reversed(a.items()))
    d = records(frame(spark, [(1, a), (1, b)] * 300 + [(None, None)] * 5), "props_id", "properties")
    assert d.count() == 3
    nodes = cut(shred(d, "record", "properties"), "nodes")
    got = links(paths(nodes, "record"), "record").select("record.props_id", "child_path", "parent_path").collect()
    assert sorted(map(tuple, got)) == [(1, "bands[0]", "$")] * 2 + [(1, "q.warps[0]", "q")] * 2


def test_root_arrays(spark):
    assert found(frame(spark, [(1, [{"a": [{}]}, [{}]])])) == [(1, "$[0]", "$"), (1, "$[0].a[0]", "$[0]"), (1, "$[1][0]", "$")]
