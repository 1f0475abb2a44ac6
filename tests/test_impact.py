"""Reasons for which a change reaches a test, on tables small enough to check by hand."""

from attestry.operators import impact


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_loads_are_followed_through_cycles(spark):
    imports = spark.createDataFrame([("t", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("u", "u"), ("x", "y")], "file string, target string")
    seeds = spark.createDataFrame([("t",), ("u",), ("w",)], "test_file string")
    assert rows(impact.load_closure(seeds, imports)) == [("t", "a"), ("t", "b"), ("t", "c"), ("u", "u")]
    assert rows(impact.load_closure(seeds, imports.limit(0))) == []


def test_names_of_changed_jvm_declarations(spark):
    units = spark.createDataFrame(
        [("before", "src/Pool.java", 0, "Pool", None), ("before", "src/Pool.java", 1, "Pool.take", 0), ("before", "src/Pool.java", 2, "Io", None),
         ("before", "src/index.kt", 0, "", None), ("before", "src/index.kt", 1, "pkg.Kept", 0), ("before", "src/index.kt", 2, "pkg.Kept.inner", 1),
         ("before", "src/pool.py", 0, "Pool", None), ("before", "src/Narrow.java", 0, "Narrow", None), ("after", "src/Pool.java", 0, "Fresh", None)],
        "version string, file string, idx int, path string, parent int")
    changes = spark.createDataFrame([("src/Pool.java", "code", False), ("src/index.kt", "code", False), ("src/pool.py", "code", False), ("src/Narrow.java", "code", True)], "file string, change string, narrow boolean")
    names = impact.declared_names(units, changes)
    assert rows(names) == [("src/Pool.java", "Pool"), ("src/index.kt", "Kept")]
    more = names.union(spark.createDataFrame([("src/odd.java", "a-b"), ("src/odd.java", "zeta"), ("src/odd.java", "beta")], "file string, word string"))
    sources = spark.createDataFrame(
        [("t1", "new Pool();"), ("t2", "Pool_ PoolX myPool"), ("t3", "x.Kept"), ("t4", "say a-b or zeta, beta"), ("t5", "xa-b a-bc"), ("t6", "(a-b)"), ("t7", None)], "test_file string, text string")
    assert rows(impact.naming_tests(sources, more)) == [
        ("t1", "src/Pool.java", "Pool"), ("t3", "src/index.kt", "Kept"), ("t4", "src/odd.java", "a-b"), ("t6", "src/odd.java", "a-b")]


def test_helper_reasons_by_import_server_and_the_unknown(spark):
    tests = spark.createDataFrame([("t1", "one"), ("t2", "two"), ("t3", "three"), ("open", "four")], "test_file string, name string")
    helpers = spark.createDataFrame([("lib", "code"), ("mock", "bytes"), ("lost", "removed")], "file string, change string")
    loads = spark.createDataFrame([("t1", "lib"), ("t2", "mock"), ("open", "lib")], "test_file string, file string")
    followed = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "test_file string")
    served = spark.createDataFrame([("mock", "three"), ("mock", "two")], "file string, name string")
    got = rows(impact.helper_reasons(tests, helpers, loads, followed, served))
    any_ = [(t, n, "lost removed (a file tests may load)") for t, n in [("t1", "one"), ("t2", "two"), ("t3", "three"), ("open", "four")]]
    assert got == sorted([
        ("t1", "one", "lib changed (this test's file loads it)"), ("t2", "two", "mock changed (this test's file loads it)"),
        ("t3", "three", "mock changed (a server that served this test loaded it)"), ("open", "four", "lib changed (a file tests may load)"), *any_])


def test_what_lies_beyond_the_run_is_judged_by_declarations(spark):
    changes = spark.createDataFrame([("a", "code", False), ("b", "code", False), ("c", "removed", False), ("d", "added", False), ("e", "same", False)], "file string, change string, narrow boolean")
    difference = spark.createDataFrame([("a", 2, "changed"), ("b", 3, "changed"), ("b", None, "added")], "file string, old_idx int, change string")
    covered = spark.createDataFrame([("a", 5), ("b", 4)], "file string, idx int")
    closure = spark.createDataFrame([("a", 5, 5), ("a", 5, 2), ("b", 4, 4)], "file string, idx int, ancestor int")
    got = rows(impact.beyond_the_run(changes, difference, covered, closure))
    assert got == [("a", "code", 2, "a: changed (the run covered it)"), ("c", "removed", 0, "c removed (the run covered code in it)")]
