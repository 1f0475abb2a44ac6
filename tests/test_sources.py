"""Scans and sinks on files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import runs, validate
from attestry.sources import evidence, exports, lcov


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_strict_scan_fails_on_a_torn_line(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", '{"testId":"t","retry":0,"status":"passed"}')
    assert evidence.strict_records(spark, good).first().testId == "t"
    bad = write(tmp_path / "b.jsonl", '{"testId":"t"}', '{"testId":')
    with pytest.raises(Exception):
        evidence.strict_records(spark, bad).collect()


def test_tolerant_scan_counts(spark, tmp_path):
    write(tmp_path / "a.jsonl", '{"type":"hit","id":"p1"}', '{"type":"hi')
    write(tmp_path / "b.jsonl", '{"type":"hit","id":"p2"}')
    good, corrupt = evidence.tolerant(evidence.text_lines(spark, str(tmp_path)))
    assert {r.record.id for r in good.collect()} == {"p1", "p2"}
    assert tuple(corrupt.first()) == (1, 1)


def test_scope_carries_forward_within_a_file(spark, tmp_path):
    write(tmp_path / "a.jsonl", '{"type":"hit","id":"p0"}', '{"type":"hit","id":"p1","scope":{"attemptId":"x"}}', '{"type":"hit","id":"p2"}')
    write(tmp_path / "b.jsonl", '{"type":"hit","id":"p3"}')
    rows = evidence.scoped_server_records(evidence.numbered_lines(spark, str(tmp_path))).collect()
    assert {r.id: r.scope.attemptId if r.scope else None for r in rows} == {"p0": None, "p1": "x", "p2": "x", "p3": None}


def test_run_catalogue(spark, tmp_path):
    for name, text in {"a": '{"id":"r1","startedAt":"2026-01-01"}', "b": '{"id":"r2","startedAt":"2026-01-02"}', "c": "{torn", "d": '{"startedAt":"2026-01-03"}'}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text(text)
    valid, rejected = runs.catalogue(evidence.runs(spark, f"{tmp_path}/*/run.json").select("run_id", "started_at", "corrupt"))
    assert [r.run_id for r in valid.collect()] == ["r2", "r1"]
    assert sorted(r.reason for r in rejected.collect()) == ["run metadata has no id", "run metadata is not valid JSON"]
    assert runs.select_run(valid, "latest", "started_at").first().run_id == "r2"
    assert runs.select_run(valid, "r", "started_at").first().run_id == "r2"
    with pytest.raises(ValueError):
        runs.require_mergeable(["r1"])
    with pytest.raises(ValueError):
        runs.require_mergeable(["r1", "r1"])


def test_manifest_tables(spark, tmp_path):
    manifest = {
        "runId": "r", "unmeasured": ["p2", "b1"], "points": [{"id": "p1", "kind": "statement", "file": "a", "line": 1, "column": 0, "source": "x"}, {"id": "p2", "kind": "function", "file": "a", "line": 2, "column": 0, "source": "y"}],
        "branches": [{"id": "b1", "kind": "if", "file": "a", "line": 1, "column": 2, "source": "z", "alternatives": [{"id": "b1:t", "label": "true"}]}],
        "decisions": [{"id": "d1", "file": "a", "line": 1, "column": 2, "source": "q", "conditions": ["u", "v"], "kind": "if"}], "limitations": [], "scope": {"entries": [{"file": "a", "status": "included"}]}}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    tables = evidence.manifest_tables(evidence.manifests(spark, str(tmp_path)))
    assert {r.id: r.declined for r in tables["points"].collect()} == {"p1": False, "p2": True}
    assert tables["branches"].first().declined and tables["decisions"].first().conditions == 2 and tables["scope_entries"].first().status == "included"


def test_event_columns_refuse_ragged_and_stray(spark):
    shape = "s string, hits array<string>, events struct<types:array<string>,phases:array<string>,environments:array<string>,id:array<string>,type:array<int>,phase:array<int>,environment:array<int>,t:array<bigint>,vector:map<int,struct<values:array<boolean>,outcome:boolean>>>"

    def decode(**changed):
        events = {"types": ["hit", "decision"], "phases": ["ph"], "environments": ["browser"], "id": ["0", "d1"], "type": [0, 1], "phase": [-1, 0], "environment": [0, 0], "t": [100, 5], "vector": {1: ([True, None], False)}, **changed}
        return evidence.decode_events(spark.createDataFrame([("s", ["p9"], tuple(events.values()))], shape), ["s"]).orderBy("pos").collect()

    first, second = decode()
    assert (first.id, first.type, first.phase_id, first.timestamp_ms, first.vector) == ("p9", "hit", None, 100, None)
    assert (second.id, second.phase_id, second.timestamp_ms, second.vector.outcome) == ("d1", "ph", 105, False)
    for changed in ({"t": [1]}, {"type": [0, 7]}, {"id": ["3", "d1"]}, {"phase": [-1, 4]}, {"vector": {9: ([True], True)}}):
        with pytest.raises(Exception):
            decode(**changed)


def numbered(spark, *lines):
    return spark.createDataFrame([("f", i + 1, line) for i, line in enumerate(lines)], "file string, pos int, text string")


def test_lcov_forms(spark):
    text = numbered(spark, "TN:", "SF:a.c", "FN:3,main", "FN:9,12,other", "FNDA:4,main", "FNDA:0,other", "DA:3,2", "DA:4,0.5", "DA:5,-1", "DA:6,0", "end_of_record", "SF:a.c", "DA:3,1", "end_of_record")
    assert {r.line: r["count"] for r in lcov.read_lines(text).collect()} == {3: 3, 4: 1, 5: 1, 6: 0}
    assert {r.line: r["count"] for r in lcov.read_functions(text).collect()} == {3: 4, 9: 0}
    with pytest.raises(Exception, match="before any SF"):
        lcov.read_lines(numbered(spark, "DA:1,1")).collect()


def test_unified_diff(spark):
    lines = numbered(spark, "--- a/x.ts", "+++ b/x.ts", "@@ -1 +2,3 @@ fn", "@@ -9,2 +20,0 @@", "@@ -9,2 +30 @@", "+++ /dev/null", "@@ -1,3 +1,3 @@")
    assert {(r.file, r.line) for r in lcov.changed_lines(lines).collect()} == {("x.ts", 2), ("x.ts", 3), ("x.ts", 4), ("x.ts", 30)}


def view(spark):
    lines = spark.createDataFrame([("r", "src/a.ts", 1, True), ("r", "src/a.ts", 4, False)], "run_id string, file string, line int, covered boolean")
    functions = spark.createDataFrame([("r", "src/a.ts", 1, "f<x>", True)], "run_id string, file string, line int, name string, covered boolean")
    branches = spark.createDataFrame([("r", "src/a.ts", 2, 0, 0, True), ("r", "src/a.ts", 2, 0, 1, False)], "run_id string, file string, line int, block int, index int, taken boolean")
    conditions = spark.createDataFrame([("r", "src/a.ts", 2, 3, 0, " a  b ", True), ("r", "src/a.ts", 2, 3, 1, "", False)], "run_id string, file string, line int, col int, condition int, source string, covered boolean")
    counts = "covered_lines int, total_lines int, covered_statements int, total_statements int, covered_functions int, total_functions int, covered_branches int, total_branches int"
    files = spark.createDataFrame([("r", "src/a.ts", 1, 2, 1, 2, 1, 1, 1, 2)], f"run_id string, file string, {counts}")
    return exports.RunView(lines, functions, branches, conditions, files, files.drop("file").withColumn("files", F.lit(1)))


def test_lcov_document_and_round_trip(spark, tmp_path):
    exports.write(exports.lcov(view(spark)), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "run_id=r").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text.splitlines() == [
        "TN:", "SF:src/a.ts", "FN:1,f<x>", "FNDA:1,f<x>", "FNF:1", "FNH:1", "BRDA:2,0,0,1", "BRDA:2,0,1,-", "BRF:2", "BRH:1", "MCDC:2,2,t,1,0,a b", "MCDC:2,2,f,1,0,a b",
        "MCDC:2,2,t,0,1,condition 1", "MCDC:2,2,f,0,1,condition 1", "MCF:4", "MCH:2", "DA:1,1", "DA:4,0", "LF:2", "LH:1", "end_of_record"]
    read = lcov.read_lines(numbered(spark, *text.splitlines()))
    assert {(r.line, r["count"]) for r in read.collect()} == {(1, 1), (4, 0)}


@pytest.mark.parametrize("build", [lambda v: exports.cobertura(v, 5), lambda v: exports.clover(v, 5), lambda v: exports.jacoco(v, 5), exports.sonar])
def test_xml_documents_parse(spark, build):
    import xml.dom.minidom

    rows = build(view(spark)).orderBy("run_id", "part", "file", "section", "a", "b").collect()
    document = xml.dom.minidom.parseString("\n".join(r.text for r in rows))
    # A branch off a measured line is stated on the nearest one above.
    assert "branch" in document.toxml() or "BRANCH" in document.toxml() or "cond" in document.toxml()


def test_istanbul(spark):
    lines = spark.createDataFrame([("a.ts", 1, "  call(x,"), ("a.ts", 2, "    y)"), ("b.py", 1, "é = run()")], "file string, line int, text string")
    points = spark.createDataFrame(
        [("a.ts", "p1", "statement", 1, None, 3, "call(x,\n    y)", True), ("b.py", "p2", "function", 1, None, 5, "run()", False)],
        "file string, id string, kind string, line int, label string, col int, source string, covered boolean")
    placed = {r.id: r for r in exports.placed_points(points, lines).collect()}
    assert (placed["p1"].start_col, placed["p1"].end_line, placed["p1"].end_col, placed["p1"].stale) == (2, 2, 6, False)
    assert (placed["p2"].start_col, placed["p2"].end_col) == (4, 9)
    branches = spark.createDataFrame([("a.ts", 1, 2, "logical-value", [True, False])], "file string, line int, col int, kind string, taken array<boolean>")
    text = {r.file: json.loads(r.text) for r in exports.istanbul_files(exports.placed_points(points, lines), branches, "/repo").collect()}
    assert text["a.ts"]["s"] == {"0": 1} and text["a.ts"]["b"] == {"0": [1, 0]} and text["a.ts"]["branchMap"]["0"]["type"] == "binary-expr"
    assert text["b.py"]["fnMap"]["0"]["name"] == "(anonymous_0)"
    moved = lines.withColumn("text", F.lit("gone"))
    with pytest.raises(Exception, match="no longer holds"):
        exports.istanbul_files(exports.placed_points(points, moved), branches, "/repo").collect()


def test_snapshot_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("s1", "a", "completed", 9.5), ("s1", "b", "failed", None)], "snapshot string, path string, status string, health double")
    exports.save_snapshot(files, files.groupBy("snapshot").count(), str(tmp_path))
    done, failed = exports.load_snapshot(spark, str(tmp_path), "s1")
    assert [r.path for r in done.collect()] == ["a"] and [r.path for r in failed.collect()] == ["b"]


def test_cycles_of_causes(spark):
    rows = spark.createDataFrame([("r", "x", "a", "b"), ("r", "x", "b", "a"), ("r", "x", "c", None), ("r", "x", "d", "c"), ("r", "y", "a", "b"), ("r", "y", "b", None)],
                                 "run_id string, record_id string, id string, cause string")
    assert sorted(r.key for r in validate.cyclic_causes(rows).collect()) == ["a", "b"]


def test_a_journal_is_read_by_many_tasks_in_its_order(spark, tmp_path):
    rng, wanted = random.Random(6), []
    for name in ("a.jsonl", "b.jsonl"):
        lines, scope = [], None
        for n in range(1, 1500):
            if rng.random() < 0.01:
                scope = f"w{n}"
                lines.append(json.dumps({"type": "hit", "id": f"h{n}", "scope": {"workerId": scope, "runId": "r"}}))
            elif rng.random() < 0.05:
                lines.append("" if rng.random() < 0.5 else '{"type": "hi')
                continue
            else:
                lines.append(json.dumps({"type": "hit", "id": f"h{n}", "pad": "é" * rng.randint(0, 40)}))
            wanted.append((name, n, f"h{n}", scope))
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name == "a.jsonl" else ""))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = evidence.numbered_lines(spark, str(tmp_path))
        assert evidence.text_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20
        got = evidence.scoped_server_records(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert sorted((r.file.rsplit("/", 1)[1], r.pos, r.id, r.scope and r.scope.workerId) for r in got) == sorted(wanted)


def test_files_of_one_hash_keep_their_lines_apart(spark, tmp_path):
    """These two names have one xxhash64 modulo 1,000,000,007, by which lines were once placed."""
    from types import SimpleNamespace

    from attestry.plans.source_queries import tracefile

    names = ["src/f82190.ts", "src/f125052.ts"]
    points = spark.createDataFrame([("r", f"p{i}", name, 3 + i, "function", None) for i, name in enumerate(names)], "run_id string, id string, file string, line int, kind string, label string")
    hits = spark.createDataFrame([("r", "t", "p0"), ("r", "t", "p1"), ("r", "u", "p1")], "run_id string, test_id string, hit_id string")
    trace = tracefile(SimpleNamespace(spark=spark, sf_dir=str(tmp_path), points=points, hits=hits))
    expected = {(names[0], 3, 1), (names[1], 4, 2)}
    assert {tuple(r) for r in lcov.read_lines(trace).collect()} == expected
    assert {tuple(r) for r in lcov.read_functions(trace).collect()} == expected


def test_condition_records_of_like_decisions_keep_one_order(spark):
    from attestry.sources import exports

    # Ten decisions at one place, in whatever order: each text's place is that of its decision's id.
    rows = [("r", "a.ts", 3, 8, f"d{i}", 0, "x c0", i % 3 == 0) for i in range(10)]
    schema = "run_id string, file string, line int, col int, decision_id string, condition int, source string, covered boolean"
    expected = sorted(f"MCDC:3,10,{s},{int(i % 3 == 0)},{i},x c0" for i in range(10) for s in "tf")
    for given in (rows, rows[::-1], rows[5:] + rows[:5]):
        told = exports.mcdc_rows(spark.createDataFrame(given, schema))
        assert sorted(row["text"] for row in told.collect()) == expected
