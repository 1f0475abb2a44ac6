"""Answers are whole however deep, wide or many their inputs are."""

import pytest
from pyspark.sql import functions as F

from attestry.functions import text
from attestry.operators import compare_runs, gaps, impact, scan, selection, validate
from attestry.sources import lcov


def test_ancestors_of_a_deep_tree(spark):
    units = spark.createDataFrame([("f", i, i - 1 if i else None) for i in range(150)], "file string, idx int, parent int")
    found = impact.ancestors(units)
    assert found.count() == 150 * 151 // 2
    with pytest.raises(ValueError):
        impact.ancestors(spark.createDataFrame([("f", 1, 2), ("f", 2, 1)], "file string, idx int, parent int"))


def test_annotations_and_pages_are_per_run(spark):
    ranges = spark.createDataFrame([(run, "f", i, i) for run in ("a", "b") for i in range(60)], "run_id string, file string, start int, end int")
    count = lambda df: {r.run_id: r["count"] for r in df.groupBy("run_id").count().collect()}
    assert count(compare_runs.annotations(ranges)) == {"a": 60, "b": 60}
    assert count(compare_runs.annotations(ranges, 50)) == {"a": 50, "b": 50}
    assert count(gaps.page(ranges, ["start"], 50, 20)) == {"a": 10, "b": 10}
    facts = gaps.page_facts(ranges, 20, 20).orderBy("run_id").collect()
    assert [(r.run_id, r.returned, r.total, r.has_more, r.next_offset) for r in facts] == [("a", 20, 60, True, 40), ("b", 20, 60, True, 40)]


def test_imports_in_order_and_at_any_depth(spark):
    files = ["src/a/index.ts", "src/a.js", "src/b.ts", "src/b/index.ts", "app/m.py", "app/m/__init__.py", "app/__init__.py", "root.py", "x/deep.js"]
    cases = {
        ("src/main.ts", "./a"): "src/a/index.ts", ("src/main.ts", "./b"): "src/b.ts", ("src/b.ts", "./b"): None, ("src/main.ts", "package"): None,
        ("1/2/3/4/5/6/7/8/9/10/y.js", "../../../../../../../../../../x/deep"): "x/deep.js", ("app/n.py", ".m"): "app/m.py", ("app/m.py", ".m"): "app/m/__init__.py",
        ("app/n.py", "..root.thing"): "root.py", ("app/n.py", "app.m.Name"): "app/m.py", ("app/n.py", "...root"): None, ("app/n.py", "os"): None, ("app/n.py", "app"): "app/__init__.py",
    }
    found = scan.resolve_imports(spark.createDataFrame(list(cases), "file string, specifier string"), spark.createDataFrame([(f,) for f in files], "path string")).collect()
    assert {(r.file, r.specifier): r.target for r in found} == {k: v for k, v in cases.items() if v}


def test_braces_of_any_depth(spark):
    body = "'before it all ${a{b{c{d{e{f}}}}}} and after'"
    got = spark.createDataFrame([(body,), ("'open at the end { never shut'",)], "t string").select(text.quoted_fragments(F.col("t")).alias("x")).collect()
    assert got[0].x == ["and after", "before it all"] and got[1].x == ["never shut", "open at the end"]


def test_counts_hold_at_the_largest_number(spark):
    lines = ["SF:a.js", f"DA:1,{2**63 - 2}", "DA:1,5", "DA:2,99999999999999999999999", "end_of_record"]
    frame = spark.createDataFrame([("t", i, x) for i, x in enumerate(lines)], "file string, pos int, text string")
    assert {r.line: r["count"] for r in lcov.read_lines(frame).collect()} == {1: 2**63 - 1, 2: 2**63 - 1}


def test_every_candidate_is_named(spark):
    with pytest.raises(selection.Ambiguous) as told:
        selection.select_source_file(spark.createDataFrame([(f"src/f{i:02d}.js",) for i in range(30)], "file string"), ".js")
    assert len(told.value.candidates) == 30


def test_a_long_chain_of_causes_is_no_cycle(spark):
    rows = [("r", "x", str(i), str(i - 1) if i else None) for i in range(40)] + [("r", "y", "a", "b"), ("r", "y", "b", "a")]
    found = validate.cyclic_causes(spark.createDataFrame(rows, "run_id string, record_id string, id string, cause string"))
    assert found.count() == 2
