import json

from conftest import rows

from linelore.operators import drift

SCHEMA = "line_id long, origin string, file_name string, file_no int, line_no int, raw_line string, field string, path string"


def lines(spark, files):
    data, n = [], 0
    for (origin, no), recs in files.items():
        for k, r in enumerate(recs):
            n += 1
            data.append((n, origin, f"{origin}-{no}", no, k + 1, r if r is None or isinstance(r, str) else json.dumps(r), "clash", None))
    return spark.createDataFrame(data, SCHEMA)


def test_changes(spark):
    base = {"command": "ls", "filtered_bytes": 0}
    files = {
        ("a", 1): [base | {"session_scope": "s1"}, base | {"session_scope": "s2"}, "{broken", "", None, "null", "[1]"],
        ("a", 2): [base | {"context": {"scope": "s1"}}, base | {"session_scope": None}],
        ("a", 3): [base | {"context": {"scope": ["s1"]}, "is_empty": 1}, base],
        ("a", 5): [base | {"tool_session": 7, "is_empty": 1}, base | {"tool_session": 8}, base | {"context": {"scope": "old"}}],
        ("b", 1): [base | {"delta_ref": "abc"}],
        ("b", 2): ["", "garbage"],
    }
    got = drift.schema_changes(lines(spark, files), only=list(drift.ALIASES)).select("file_name", "field", "change")
    assert rows(got) == sorted(
        [
            ("a-2", "session_scope", "renamed"),
            ("a-3", "session_scope", "retyped"),
            ("a-3", "empty_result", "added"),
            ("a-5", "session_scope", "renamed"),
            ("a-5", "session_scope", "retyped"),
            ("b-2", "delta_ref", "removed"),
        ],
        key=repr,
    )


def test_one_table(spark):
    files = {
        ("a", 1): [{"filtered_bytes": 0, "deltaRef": int("9610d9224a2e", 16)}, {"filtered_bytes": 5, "no_output": "false", "delta_base": ["aff2bc01f2a3", 3]}],
        ("b", 1): [{"emptyResult": 1, "scope": ["s9"], "x": {"y": {"z": 1}}}, {"tool_session": 42}],
    }
    got = drift.unified_records(lines(spark, files)).select("session_scope", "empty_result", "delta_ref")
    assert rows(got) == sorted([(None, True, "9610d9224a2e"), (None, False, "aff2bc01f2a3"), ("s9", True, None), ("42", None, None)], key=repr)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert drift.schema_changes(empty).count() == 0
    assert drift.unified_records(empty).count() == 0
