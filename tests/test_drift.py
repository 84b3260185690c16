import json

from folioscope.operators import drift
from folioscope.schema import REPORT

LAYOUT = "file_id bigint, scanner string, seq_no int, line_no int, url string, md5 string, report_json string, leaf string, path string"


def records(spark, files):
    """files: file id to (scanner, position, list of reports or texts)."""
    rows = []
    for f, (scanner, pos, reports) in files.items():
        for i, r in enumerate(reports):
            rows.append((f, scanner, pos, i, f"u{i}", None if i == 1 else f"m{i}", r if isinstance(r, str) or r is None else json.dumps(r), "clash", "clash"))
    return spark.createDataFrame(rows, LAYOUT)


def changes(df):
    return {tuple(r) for r in drift.field_changes(df).collect()}


def test_added_removed_retyped_and_renamed(spark):
    old = [{"Pages": i, "Creator": "x", "gone": 1, "v": {"e": f"t{i}"}} for i in range(4)]
    new = [{"n_pages": i, "Creator": 1.5, "came": True, "err": f"t{i}"} for i in range(4)]
    df = records(spark, {1: ("s", 1, old), 2: ("s", 5, new), 3: ("other", 1, new)})
    assert changes(df) == {
        (2, "renamed", "Pages", "n_pages"), (2, "renamed", "v.e", "err"), (2, "retyped", "Creator", "Creator"), (2, "removed", "gone", ""), (2, "added", "", "came"),
    }


def test_types_and_case(spark):
    df = records(spark, {1: ("s", 1, [{"a": 1, "b": [1], "C": "x"}]), 2: ("s", 2, [{"a": 1.0, "b": "1", "c": "y"}, {"a": 1, "b": [2]}])})
    assert changes(df) == {(2, "retyped", "a", "a"), (2, "retyped", "b", "b"), (2, "renamed", "C", "c")} or changes(df) == {(2, "retyped", "a", "a"), (2, "retyped", "b", "b"), (2, "removed", "C", ""), (2, "added", "", "c")}


def test_losing_one_of_two_types_is_no_change(spark):
    df = records(spark, {1: ("s", 1, [{"a": 1}, {"a": "x"}]), 2: ("s", 2, [{"a": "x"}])})
    assert changes(df) == set()


def test_dirt(spark):
    good = {"a": 1, "b": None, "o": {}}
    df = records(spark, {1: ("s", 1, [good, good, None, "", "{", "[1]", '{"a":' * 5000]), 2: ("s", 2, [good, "{broken"]), 3: ("s", 3, [None])})
    df = df.union(df).union(spark.createDataFrame([(None, "s", 4, 0, None, None, "{}", "", ""), (9, None, 4, 0, None, None, '{"z":1}', "", "")], LAYOUT))
    assert changes(df) == {(3, "removed", "a", "")}


def test_empty_table(spark):
    df = spark.createDataFrame([], LAYOUT)
    assert drift.field_changes(df).count() == 0
    assert drift.schema_versions(df).count() == 0
    assert drift.consistent_reports(df, REPORT).count() == 0


def test_versions_follow_fingerprints(spark):
    df = records(spark, {1: ("s", 1, [{"a": 1}]), 2: ("s", 2, [{"a": 2}]), 3: ("s", 1030, [{"b": 2}]), 4: ("s", 1031, [{"a": 1}])})
    assert {(r["file_id"], r["version"]) for r in drift.schema_versions(df).collect()} == {(1, 1), (2, 1), (3, 2), (4, 3)}


def test_consistent_table(spark):
    old = [{"Pages": i, "hasTitle": True, "TitleTest": "Pass", "veraPDF": {"failed_rules": ["7.1-1"]}} for i in range(4)]
    new = [{"howLong": str(i), "has_title": 1, "TitleTest": 0, "veraPDF": {"failed_rules": "7.1-1; 7.2-2"}, "Extra": [1]} for i in range(4)]
    for r in new:
        r["howLong"] = int(r["howLong"])
    df = records(spark, {1: ("s", 1, [*old, "{"]), 2: ("s", 2, new)})
    rows = {(r["file_id"], r["line_no"]): r for r in drift.consistent_reports(df.union(df), REPORT).collect()}
    assert len(rows) == 8
    last = rows[2, 3]
    assert (last["report"]["Pages"], last["report"]["hasTitle"], last["report"]["TitleTest"]) == (3, True, "Fail")
    assert last["report"]["veraPDF"]["failed_rules"] == ["7.1-1", "7.2-2"]
    assert last["other_fields"] == {"Extra": "[1]"} and last["n_uncast"] == 0
    assert rows[1, 0]["report"]["Accessible"] is None


def test_a_displaced_value_is_kept(spark):
    both = [{"Pages": 3, "pages": 4}, {"Pages": 3, "pages": "3"}, {"Pages": None, "pages": 5}]
    rows = {r["line_no"]: r for r in drift.consistent_reports(records(spark, {1: ("s", 1, both)}), REPORT).collect()}
    assert [(rows[i]["report"]["Pages"], rows[i]["other_fields"]) for i in range(3)] == [(3, {"pages": "4"}), (3, {}), (5, {})]


def test_predecessor_crosses_blocks(spark):
    from folioscope.operators.neighbours import with_previous

    df = spark.createDataFrame([("a", p, f"f{p}") for p in (1, 3, 5000, 5001, 90000)] + [("b", 7, "g")], "s string, p int, f string")
    got = {(r["s"], r["p"]): r["was"] for r in with_previous(df, "s", "p", "f", "was", block=10).collect()}
    assert got == {("a", 1): None, ("a", 3): "f1", ("a", 5000): "f3", ("a", 5001): "f5000", ("a", 90000): "f5001", ("b", 7): None}


def test_letters_in_another_order_are_another_name(spark):
    df = records(spark, {1: ("s", 1, [{"tested": 1}, {"lastSeen": 7}]), 2: ("s", 2, [{"detest": 2}, {"seen_last": 8}, {"seen_last": 9}])})
    df = df.where("NOT (file_id = 2 AND line_no = 1)")  # no document in common
    assert changes(df) == {(2, "removed", "tested", ""), (2, "added", "", "detest"), (2, "renamed", "lastSeen", "seen_last")}


def test_each_source_has_its_own_chain(spark, monkeypatch):
    monkeypatch.setattr(drift, "BLOCK", 2)
    reports = lambda name, value=lambda i: 7 + i: [{name: value(i), "Images": i} for i in range(4)]
    said = lambda i: f"t{i}"
    df = records(spark, {
        11: ("one", 1, reports("size")), 12: ("one", 2, reports("extent")), 13: ("one", 5, reports("Pages")),
        21: ("two", 1, reports("Producer", said)), 22: ("two", 4, reports("size", said)), 23: ("two", 9, reports("size", said)),
        31: ("three", 1, reports("size")), 41: ("four", 1, reports("extent")), 42: ("four", 2, reports("unheard", lambda i: 300 + i)),
    })
    rows = {(r["file_id"], r["line_no"]): r for r in drift.consistent_reports(df, REPORT).collect()}
    assert [rows[f, 0]["report"]["Pages"] for f in (11, 12, 13)] == [7, 7, 7]
    assert [rows[f, 0]["report"]["Producer"] for f in (21, 22, 23)] == ["t0", "t0", "t0"] and rows[22, 0]["report"]["Pages"] is None
    assert rows[31, 0]["other_fields"] == {"size": "7"}  # other sources disagree about the name
    assert rows[41, 0]["report"]["Pages"] == 7 and rows[42, 1]["other_fields"] == {"unheard": "301"}
    rules = {(r["file_id"], r["field"], r["target"]): (r["rule"], r["cast"]) for r in drift.migrations(df, REPORT).collect()}
    assert rules[12, "extent", "Pages"] == ("rename", None) and rules[22, "size", "Producer"] == ("rename", None) and rules[41, "extent", "Pages"] == ("borrow", None)
    assert rules[31, "size", None] == ("other", None) and rules[13, None, "Creator"] == ("default", None)


def test_values_that_cannot_be_cast_are_kept(spark):
    df = records(spark, {1: ("s", 1, [{"Pages": "many", "Images": "3", "hasXmp": 1}])})
    row = drift.consistent_reports(df, REPORT, defaults={"Creator": "unknown", "veraPDF.profile": "none"}).first()
    assert (row["report"]["Pages"], row["report"]["Images"], row["report"]["hasXmp"]) == (None, 3, True)
    assert row["other_fields"] == {"Pages": '"many"'} and row["n_uncast"] == 1
    assert (row["report"]["Creator"], row["report"]["veraPDF"]["profile"]) == ("unknown", "none")
    assert {(r["field"], r["cast"]) for r in drift.migrations(df, REPORT).where("field IS NOT NULL").collect()} == {("Pages", "string>integer"), ("Images", "string>integer"), ("hasXmp", "integer>boolean")}


def test_a_registry_reads_each_file_once(spark, tmp_path, monkeypatch):
    files = {1: ("s", 1, [{"a": 1}]), 2: ("s", 3, [{"a": "x"}]), 3: ("s", 2, [{"a": 1, "b": 2}])}
    path, read = f"file://{tmp_path}/registry", []
    inner = drift.file_fields
    monkeypatch.setattr(drift, "file_fields", lambda r, f: read.append({x[0] for x in r.select("file_id").distinct().collect()}) or inner(r, f))
    first = records(spark, {k: files[k] for k in (1, 2)})
    assert {tuple(r) for r in drift.field_changes(first, registry=drift.SchemaRegistry(spark, path)).collect()} == {(2, "retyped", "a", "a")}
    later = {tuple(r) for r in drift.field_changes(records(spark, files), registry=drift.SchemaRegistry(spark, path)).collect()}
    assert later == {(3, "added", "", "b"), (2, "removed", "b", ""), (2, "retyped", "a", "a")}
    assert read == [{1, 2}, {3}]
