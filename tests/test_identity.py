import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlake.functions import identity as i

EXAMPLE = {
    "schema_version": "1.0",
    "tool": {"family": "codex", "surface": "cli", "profile": "default"},
    "native_session_id": "s",
    "sequence": 1,
    "timestamp": "2026-07-20T14:31:22.192Z",
    "timestamp_precision": "millisecond",
    "kind": "user_message",
    "workspace": None,
    "payload": {"b": 1, "a": {"d": [1.5, None], "c": "ü"}},
    "provenance": {"source_path": "/x", "original_path": None, "source_offset": 7, "source_generation": "g", "adapter_version": "1", "ingestion_sequence": 1, "ordering_confidence": 1.0},
}


def test_identity_ignores_who_read_it_and_key_order():
    moved = EXAMPLE | {"provenance": EXAMPLE["provenance"] | {"source_path": "/y", "adapter_version": "2", "ingestion_sequence": 9}, "payload": {"a": {"c": "ü", "d": [1.5, None]}, "b": 1}}
    assert i.event_id(moved) == i.event_id(EXAMPLE)
    for change in ({"sequence": 2}, {"kind": "error"}, {"payload": {}}, {"provenance": EXAMPLE["provenance"] | {"source_offset": 8}}, {"workspace": {"cwd": "/w"}}):
        assert i.event_id(EXAMPLE | change) != i.event_id(EXAMPLE)


@pytest.mark.parametrize(("value", "text"), [(1.0, "1.0"), (0.1, "0.1"), (1e16, "1e16"), (1e21, "1e21"), (1.5e-7, "1.5e-7"), (-2.5, "-2.5"), (10**20, "100000000000000000000"), ("\x1f\n\"é", '"\\u001f\\n\\"é"'), (True, "true"), (None, "null")])
def test_canonical_values(value, text):
    assert i.canonical_json(value) == text


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda c: st.lists(c) | st.dictionaries(st.text(), c), max_leaves=20))
def test_canonical_json_reads_back(value):
    text = i.canonical_json(i.sorted_keys(value))
    assert json.loads(text) == value
    assert text == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_column_and_plain_ids_agree(spark):
    row = spark.createDataFrame([("b", "a")], "l string, r string").select(i.candidate_id(F.col("l"), F.col("r")).alias("c"), i.global_id(F.col("l")).alias("g")).first()
    assert row["c"] == i.candidate_id("a", "b") == i.candidate_id("b", "a")
    assert row["g"] == i.global_id("b")


def test_other_ids():
    assert i.raw_id("g", 1, b"x") != i.raw_id("g", 1, b"x", external=True)
    assert i.raw_id("g", 1, b"x", external=True).startswith("raw_")
    assert 0 <= i.stable_offset("part") < 1 << 63
    assert i.length_prefixed(["a", "bc"]) != i.length_prefixed(["ab", "c"])


def test_ids_of_columns(spark):
    frame = spark.createDataFrame([(json.dumps(EXAMPLE),), (json.dumps(EXAMPLE | {"sequence": 5}),)], "d string")
    assert [r[0] for r in frame.select(i.event_ids(F.col("d"))).collect()] == [i.event_id(EXAMPLE), i.event_id(EXAMPLE | {"sequence": 5})]
    assert frame.select(i.canonical_payload(F.lit('{"b": 1, "a": 1e16}'))).first()[0] == '{"a":1e16,"b":1}'
