"""JSON in the texts of models, against Python's own parser."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.functions.loosejson import json_items, json_object, salvaged

OBJECTS = [
    ('{"a": 1}', {"a": 1}), ("  \n{\"a\": [1, 2]}\t", {"a": [1, 2]}), ('```json\n{"a": 1}\n```', {"a": 1}), ('```\n{"a": 1}\n```', {"a": 1}), ('Here:\n```json\n{"a": 2}\n```\nDone.', {"a": 2}), ('so {"a": {"b": "}"}} it is', {"a": {"b": "}"}}),
    ('{"a": [1, 2,], "b": 3,\n}', {"a": [1, 2], "b": 3}), ('{\n"a": 1,\n- b: 2,\n  - "c": 3\n}', {"a": 1, "b": 2, "c": 3}), ('```json\n[1]\n```\n```json\n{"z": 0}\n```', {"z": 0}), ('```json\n{"a": 1,}\n```', {"a": 1}), ('{"a": 1', None), ("[1, 2]", None), ("7", None), ("", None), (None, None), ("} {", None), ('{"a": "x, ]"}', {"a": "x, ]"}), ('{"답": "예"}', {"답": "예"}),
]


def test_objects(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(OBJECTS)], "i int, t string")
    got = {r["i"]: json.loads(r["o"]) if r["o"] else None for r in df.select("i", json_object(df["t"]).cast("string").alias("o")).collect()}
    assert [got[i] for i in range(len(OBJECTS))] == [want for _, want in OBJECTS]


ITEMS = [
    ('[{"a": 1}, {"b": "]"}] and [1]', [{"a": 1}, {"b": "]"}]), ('x [{"a": 1}, {"b": {"c": [2]}}, {"d":', [{"a": 1}, {"b": {"c": [2]}}]), ("[1, \"x\", null]", [1, "x", None]), ("[1, 2", []), ('[{"a": 1}, {"b": bad}, {"c": 3}]', [{"a": 1}]), ("no array", []), ("", []), (None, []),
    ('[{"a": "cut \\" [', []), ('[{"a": 1}, {"b": "open]', [{"a": 1}]), ('[{"a": 1}} {"b": 2}]', [{"a": 1}]), ("[]", []), ('[[{"n": 1}], {"a": 2}, ', [{"a": 2}]), ("]" * 5 + "[" + '{"a": 1},' * 3, [{"a": 1}] * 3),
]


def test_items(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ITEMS)], "i int, t string")
    got = {r["i"]: [json.loads(x) for x in r["x"]] for r in df.select("i", json_items("t").alias("x")).collect()}
    assert [got[i] for i in range(len(ITEMS))] == [want for _, want in ITEMS]


leaf = st.none() | st.booleans() | st.integers(-99, 99) | st.text('ab"\\[]{},: é\n', max_size=6)
obj = st.dictionaries(st.text('k"]}', max_size=3), st.recursive(leaf, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab", max_size=2), x, max_size=3), max_leaves=6), max_size=3)


@settings(max_examples=300, deadline=None)
@given(st.lists(obj, max_size=5), st.integers(0, 400))
def test_any_cut_keeps_the_whole_objects_before_it(items, at):
    text = json.dumps(items)
    ends = [len(json.dumps(items[: k + 1])) - 1 for k in range(len(items))]
    want = items if at >= len(text) else [x for x, e in zip(items, ends, strict=True) if e <= at]
    assert [json.loads(x) for x in salvaged("Answer: " + text[:at])] == want


@pytest.mark.parametrize("text", ["[" * 100_000, '[{"a": "' + "x\\" * 200_000, "[" + '{"a": 1},' * 50_000])
def test_long_texts(text):
    assert len(salvaged(text)) in (0, 50_000)
