import json

import pyarrow as pa
from pyspark.sql import functions as F

from barloom.operators.schemas import flood, schema_changes, unify

SCHEMA = "record_id bigint, stream_id string, file_no int, line_no int, payload string, field string, value int"


def frame(spark, files):
    rows, n = [], 0
    for stream, no, records in files:
        for line, r in enumerate(records):
            n += 1
            rows.append((n, stream, no, line, r if r is None or isinstance(r, str) else json.dumps(r), "clash", 1))
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return {tuple(r) for r in schema_changes(frame(spark, files)).select("stream_id", "file_no", "change", "field", "new_field").collect()}


def rec(i, **names):
    base = {"t": 1000 + i, "rate": i * 0.001 + 0.0001, "note": f"n{i}", "ok": i % 2 == 0}
    return {names.get(k, k): v for k, v in base.items() if names.get(k, k)}


def test_changes(spark):
    a = [rec(i) for i in range(10)]
    b = [rec(i, rate="fundingRate", ok="") | {"extra": [i]} for i in range(7, 17)]
    c = [{**rec(i, rate="fundingRate", ok=""), "extra": {"x": i}, "t": str(1000 + i)} for i in range(14, 24)]
    dirty = [None, "", "{", "[1]", '"x"', "null"]
    assert changes(spark, [("s", 1, a + dirty), ("s", 2, dirty + b), ("s", 3, c), ("s", 5, a), ("u", 2, b)]) == {
        ("s", 2, "renamed", "rate", "fundingRate"), ("s", 2, "removed", "ok", ""), ("s", 2, "added", "extra", ""), ("s", 3, "retyped", "extra", ""), ("s", 3, "retyped", "t", ""),
    }


def test_same_name_in_other_case_and_unlike_values(spark):
    a = [rec(i) for i in range(10)]
    b = [rec(i, rate="RATE", note="") | {"memo": "other"} for i in range(6, 16)]
    assert changes(spark, [("s", 1, a), ("s", 2, b)]) == {("s", 2, "renamed", "rate", "RATE"), ("s", 2, "removed", "note", ""), ("s", 2, "added", "memo", "")}


def test_half_and_empty(spark):
    a = [{"x": 1, "y": 2}, {"x": 1}]  # y in half of the records: no field
    assert changes(spark, [("s", 1, a), ("s", 2, [{"x": None}, {"x": 3}, {}])]) == set()
    assert changes(spark, [("s", 1, [{"x": 1}]), ("s", 2, ["oops"])]) == {("s", 2, "removed", "x", "")}
    assert changes(spark, []) == set()


def test_repeated_rows_do_not_matter(spark):
    a, b = [rec(i) for i in range(10)], [rec(i, rate="r2") for i in range(6, 16)]
    assert ("s", 2, "renamed", "rate", "r2") in changes(spark, [("s", 1, a + a[:1]), ("s", 2, b + b[-1:])])


def test_unify(spark):
    files = frame(spark, [("s", 1, [rec(i) for i in range(10)] + ["{"]), ("s", 2, [rec(i, rate="fundingRate", note="") for i in range(6, 16)])])
    out = unify(files, schema_changes(files), {"funding_rate": ("double", ("fundingrate", "rate"))}).orderBy("record_id").collect()
    assert len(out) == 21 and out[10].funding_rate is None and out[10].fields == {}
    assert abs(out[3].funding_rate - 0.0031) < 1e-12 and abs(out[-1].funding_rate - 0.0151) < 1e-12 and out[3].fields["note"] == "n3"


def test_records_with_few_single_values(spark):
    a = [{"t": i, "rate": 0.0001} for i in range(6)]
    b = [{"t": i, "fundingRate": 0.0001} for i in range(6)]
    assert changes(spark, [("s", 1, a), ("s", 2, b)]) == {("s", 2, "renamed", "rate", "fundingRate")}


def test_files_without_common_fields(spark):
    a = [{"t": 100 + i, "rate": i * 0.5 + 0.25} for i in range(8)]
    b = [{"time": 100 + i, "fundingRate": i * 0.5 + 0.25} for i in range(5, 13)]
    assert changes(spark, [("s", 1, a), ("s", 2, b)]) == {("s", 2, "renamed", "rate", "fundingRate"), ("s", 2, "renamed", "t", "time")}


def test_common_fields_that_tell_nothing(spark):
    a = [{"s": "X", "t": 100 + i, "rate": i * 0.5 + 0.25} for i in range(20)]
    b = [{"s": "X", "time": 100 + i, "funding": i * 0.5 + 0.25} for i in range(16, 36)]
    assert changes(spark, [("s", 1, a), ("s", 2, b)]) == {("s", 2, "renamed", "rate", "funding"), ("s", 2, "renamed", "t", "time")}


def test_a_name_used_again_is_another_field(spark):
    one = [{"t": i, "rate": i * 0.1} for i in range(8)]
    two = [{"t": i, "fundingRate": i * 0.1} for i in range(5, 13)]
    three = [{"t": i, "fundingRate": i * 0.1, "rate": f"x{i}"} for i in range(10, 18)]
    files = frame(spark, [("s", 1, one), ("s", 2, two), ("s", 3, three)])
    out = {r.record_id: r for r in unify(files, schema_changes(files), {"at": ("int", ("t",))}).collect()}
    assert out[2].fields == {"rate": "0.1"} and out[9].at == 5 and out[9].fields == {"rate": "0.5"}
    assert set(out[17].fields) == {"rate", "rate@3"} and out[17].fields["rate@3"] == "x10" and float(out[17].fields["rate"]) == 1.0


def test_flooding_prefers_agreeing_values():
    g = lambda *names: {n: ("number", {}) for n in names}
    s = flood(g("a", "b", "t"), g("x", "y", "t"), {("a", "y"): 1.0, ("b", "x"): 1.0})
    assert s["a", "y"] > s["a", "x"] and s["b", "x"] > s["b", "y"] and set(s) == {(a, b) for a in "ab" for b in "xy"}


def test_flooding_sees_kinds_and_nesting():
    old = {"a": ("object", {"value": "number", "ccy": "text"}), "b": ("number", {}), "t": ("number", {})}
    new = {"x": ("number", {}), "y": ("object", {"value": "number", "ccy": "text"}), "t": ("number", {})}
    s = flood(old, new, {})
    assert s["a", "y"] > s["a", "x"] and s["b", "x"] > s["b", "y"]
    plain = {"a": ("object", {}), "t": ("number", {})}, {"y": ("object", {}), "z": ("object", {"k": "text"}), "t": ("number", {})}
    s = flood({"a": ("object", {"k": "text"}), "t": ("number", {})}, plain[1], {})
    assert s["a", "z"] > s["a", "y"]


def test_choice_comes_from_converged_scores(spark, monkeypatch):
    """Ablation: without flooding the pairs of two renames are chosen by name, and the exact check lets none of them through."""
    a = [rec(i) for i in range(10)]
    b = [rec(i, rate="zeta", note="alpha") for i in range(6, 16)]
    files = [("s", 1, a), ("s", 2, b)]
    assert changes(spark, files) == {("s", 2, "renamed", "rate", "zeta"), ("s", 2, "renamed", "note", "alpha")}
    import barloom.operators.schemas as m

    flat = {("note", "alpha"): 0.5, ("rate", "zeta"): 0.5, ("note", "zeta"): 0.5, ("rate", "alpha"): 0.5}
    assert m.choose(flat) == [("note", "alpha"), ("rate", "zeta")]
    monkeypatch.setattr(m, "flood", lambda old, new, agree: {})
    rows = pa.Table.from_pylist([{"stream_id": "s", "file_no": 2, "what": w, "field": f, "new_field": g, "kind": k, "n_both": n, "n_same": n} for w, f, g, k, n in (("old", "rate", None, "number", None), ("new", "zeta", None, "number", None), ("same", "rate", "zeta", None, 4))])
    assert m._match(rows).num_rows == 0
    monkeypatch.undo()
    assert m._match(rows).num_rows == 1
