import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirestack.operators.nested import index_objects, nested_objects


def brute(text):
    def bad(_):
        raise ValueError

    try:
        o = json.loads(text, parse_constant=bad)
        while isinstance(o, str):
            o = json.loads(o, parse_constant=bad)
    except ValueError:
        return []
    out = []

    def walk(x, path, par):
        if isinstance(x, dict):
            if path is not o:
                out.append((par, path))
            for k, v in x.items():
                walk(v, path + "/" + k.replace("~", "~0").replace("/", "~1"), path)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(v, f"{path}/{i}", par)

    if isinstance(o, dict):
        for k, v in o.items():
            walk(v, "/" + k.replace("~", "~0").replace("/", "~1"), "")
    return out


DAMAGED = ["", " ", "{", "{}", '{"a":{},}', '{"a":[{},]}', '{"a" {}}', "[{}]", '{"a":{}}{"b":{}}', '{"a":tru,"b":{}}', '{"a":01,"b":{}}', '{"a":{"x":"\\u12g4"}}', '{"a":{"x":"\\q"}}', '{"a":{"x":"\t"}}', '{"a":{"x":1 2}}', '{"a":{]}', '{"a":[}]}', '{"a":NaN,"b":{}}', '{"a":1:2,"b":{}}', '{"a","b":{}}', "{:{}}", '{"a":-,"b":{}}', '{"a":{"b":{}}', '{"a":"x" "b":{}}', '{"a":{}} ,', '{"a":"\\', "null", '"x"', '"\\"', '{,"a":{}}', '{"a":{}}]', '{"a":{}}}']
WHOLE = ['{"a":{}}', ' {"a":\n{"b":[{},[{"c\\n~/":{}}]]}}\r\n', '"{\\"a\\":{}}" ', '{"a":[[],[[{}]],{}]}', '{"":{"":{}}}', '{"é":{"b":{}},"x":"{\\"}"}', '{"a":{"b":"\\\\\\""},"\\u00e9":[1,null,{}]}', '{"a":[1.5e-3,true,{"q":[{}]}]}']


def test_damaged_and_whole():
    texts = DAMAGED + WHOLE
    got = index_objects(pa.array(texts), True)
    rows = list(zip(got["row"].tolist(), got["parent"].to_pylist(), got["path"].to_pylist(), strict=True))
    assert sorted(rows) == sorted((i, *x) for i, t in enumerate(texts) for x in brute(t))
    assert all(isinstance(json.loads(x), dict) for x in got["text"].to_pylist())


JSON = st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=4), c, max_size=4), max_leaves=20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(JSON, st.integers(0, 2), st.integers(0, 400), st.booleans()), max_size=6))
def test_any_json(values):
    texts = []
    for v, wraps, keep, ascii_only in values:
        t = json.dumps(v, ensure_ascii=ascii_only)
        for _ in range(wraps):
            t = json.dumps(t)
        texts.append(t[:keep])
    got = index_objects(pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()))
    rows = list(zip(got["row"].tolist(), got["parent"].to_pylist(), got["path"].to_pylist(), strict=True))
    assert sorted(rows) == sorted((i, *x) for i, t in enumerate(texts) for x in brute(t.encode("utf-8", "replace").decode()))


def test_operator(spark):
    rows = [(1, '{"a":{"b":[null,{"c":1}]}}', "x"), (1, '{"a":{"b":[null,{"c":1}]}}', "x"), (2, None, "y"), (None, '{"k":{}}', None)]
    df = spark.createDataFrame(rows, "object_path int, payload string, extra string")
    got = nested_objects(df, "payload", ["object_path"], with_text=True)
    assert got.columns == ["in_object_path", "parent_path", "object_path", "object_depth", "array_position", "object_text"]
    assert {tuple(r) for r in got.collect()} == {(1, "", "/a", 1, None, '{"b":[null,{"c":1}]}'), (1, "/a", "/a/b/1", 2, 1, '{"c":1}'), (None, "", "/k", 1, None, "{}")}
    assert got.count() == 5
    assert nested_objects(df.limit(0), "payload", ["object_path"]).count() == 0


@pytest.mark.parametrize("depth", [300])
def test_deep_and_long(depth):
    text = '{"a":' * depth + "{}" + "}" * depth
    got = index_objects(pa.array([text, '{"t":"' + "x" * 3_000_000 + '","o":{}}']))
    assert (got["row"] == 0).sum() == depth and (got["row"] == 1).sum() == 1
