"""What a change reaches: declarations, files, tests.

``units`` hold version (``before``/``after``), file, idx, path, digest, parent,
inert, line and end_line; ``files`` version, file, bytes, semantic, structure
(the last two null where nothing parses the file). Tests' records hold
test_file, name, passed, attribution; ``executions`` test_file, name, file, idx.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as words
from attestry.functions.paths import configuration_file, dependency_file
from attestry.operators.attempts import coverage_is_complete
from attestry.session import checkpointed

TEST = ["test_file", "name"]


def _side(rows: DataFrame, version: str) -> DataFrame:
    return rows.filter(F.col("version") == version).drop("version")


def declaration_diff(units: DataFrame) -> DataFrame:
    """Declarations by path: changed, removed or added; equal ones left out."""
    old = _side(units, "before").select("file", "path", F.col("idx").alias("old_idx"), F.col("digest").alias("_old"), "inert")
    new = _side(units, "after").select("file", "path", F.col("idx").alias("new_idx"), F.col("digest").alias("_new"))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return old.join(new, ["file", "path"], "full_outer").withColumn("change", state).filter("change is not null").select(
        "file", "path", "old_idx", "new_idx", "inert", "change")


def file_changes(files: DataFrame, difference: DataFrame, probed: DataFrame) -> DataFrame:
    """Per file: same, comments only, added, removed, bytes, code; and whether a
    code change is narrow: bodies alone, each of running code with a probe."""
    old, new = _side(files, "before"), _side(files, "after")
    key = ["file"]
    joined = old.select("file", *[F.col(n).alias(f"_o{n}") for n in ("bytes", "semantic", "structure")]).join(
        new.select("file", *[F.col(n).alias(f"_n{n}") for n in ("bytes", "semantic", "structure")]), key, "full_outer")
    known = probed.select("file", F.col("idx").alias("old_idx")).distinct().withColumn("_probed", F.lit(True))
    bodies = difference.join(known, ["file", "old_idx"], "left").groupBy("file").agg(
        F.bool_and((F.col("change") == "changed") & ~F.coalesce("inert", F.lit(False)) & F.coalesce("_probed", F.lit(False))).alias("_bodies"))
    probes = probed.select("file").distinct().withColumn("_any", F.lit(True))
    change = (
        F.when(F.col("_obytes").isNull(), "added").when(F.col("_nbytes").isNull(), "removed").when(F.col("_obytes") == F.col("_nbytes"), "same")
        .when(F.col("_osemantic").isNull() | F.col("_nsemantic").isNull(), "bytes").when(F.col("_osemantic") == F.col("_nsemantic"), "comments only").otherwise("code")
    )
    told = joined.join(bodies, "file", "left").join(probes, "file", "left").withColumn("change", change)
    narrow = (
        (F.col("change") == "code") & F.col("_ostructure").eqNullSafe(F.col("_nstructure"))
        & F.coalesce("_bodies", F.lit(True)) & F.coalesce("_any", F.lit(False))
    )
    return told.select("file", "change", narrow.alias("narrow"))


def ancestors(units: DataFrame) -> DataFrame:
    """Each declaration with itself and all it sits inside: (file, idx, ancestor).

    Steps double: after k joins 2^k levels are reached, and rounds go on until no
    declaration has a level left, however deep it nests. Each round's rows are
    cut from their lineage. A declaration inside itself is an error."""
    links = units.select("file", "idx", "parent")
    closed = links.select("file", "idx", F.col("idx").alias("ancestor"))
    jump = checkpointed(links.filter("parent is not null").select("file", "idx", F.col("parent").alias("ancestor")))
    while not jump.isEmpty():
        if not jump.filter("idx = ancestor").isEmpty():
            raise ValueError("a declaration sits inside itself")
        onward = jump.select("file", F.col("idx").alias("ancestor"), F.col("ancestor").alias("_up"))
        further = closed.join(onward, ["file", "ancestor"]).select("file", "idx", F.col("_up").alias("ancestor"))
        following = jump.join(onward, ["file", "ancestor"]).select("file", "idx", F.col("_up").alias("ancestor"))
        closed, jump = checkpointed(closed.unionByName(further)), checkpointed(following)
    return closed


def innermost_unit(places: DataFrame, units: DataFrame) -> DataFrame:
    """The innermost declaration containing each (file, line, col).

    Spans are filed under the line buckets they touch, so the containment join
    is an equi-join on (file, bucket)."""
    size = 64
    spans = units.select(
        "file", "idx", "line", "col", "end_line", "end_col",
        F.explode(F.sequence(F.floor(F.col("line") / size), F.floor(F.col("end_line") / size))).alias("_bucket"),
    ).select("file", "_bucket", *[F.col(n).alias(f"_{n}") for n in ("idx", "line", "col", "end_line", "end_col")])
    here = places.withColumn("_bucket", F.floor(F.col("line") / size))
    starts = F.struct("_line", "_col") <= F.struct(F.col("line").alias("_line"), F.col("col").alias("_col"))
    ends = F.struct(F.col("line").alias("_end_line"), F.col("col").alias("_end_col")) <= F.struct("_end_line", "_end_col")
    inside = here.join(spans, ["file", "_bucket"]).filter(starts & ends)
    found = inside.groupBy("file", "line", "col").agg(F.max_by("_idx", F.struct("_line", "_col", "_idx")).alias("unit"))
    return places.join(found, ["file", "line", "col"], "left")


def own_lines(units: DataFrame) -> DataFrame:
    """A declaration's lines less those of the declarations nested in it, as ranges."""
    parts = units.select("file", "idx", F.explode(F.sequence("line", "end_line")).alias("line"))
    nested = units.filter("parent is not null").select("file", F.col("parent").alias("idx"), F.explode(F.sequence("line", "end_line")).alias("line"))
    from attestry.operators.ordered import ranges

    return ranges(parts.join(nested.distinct(), ["file", "idx", "line"], "left_anti"), ["file", "idx"], "line")


def helpers(changes: DataFrame, known_tests: DataFrame, measured: DataFrame, difference: DataFrame) -> DataFrame:
    """Changed files that are no test, not measured, no configuration and no dependency, and how each
    changed. A change that only adds declarations reaches no test written before."""
    moved = changes.filter(F.col("change").isin("removed", "bytes", "code"))
    only = difference.groupBy("file").agg(F.bool_and(F.col("change") == "added").alias("_only")).filter("_only").select("file")
    added = changes.filter("change = 'code'").join(only, "file", "left_semi").select("file")
    return (
        moved.filter(~configuration_file(F.col("file")) & ~dependency_file(F.col("file"))).join(added, "file", "left_anti")
        .join(known_tests.select(F.col("test_file").alias("file")).distinct(), "file", "left_anti")
        .join(measured.select("file").distinct(), "file", "left_anti")
    )


def reached_units(executions: DataFrame, closure: DataFrame) -> DataFrame:
    """Units tests ran, with all that contain them."""
    up = closure.withColumnRenamed("ancestor", "_up")
    return executions.join(up, ["file", "idx"], "left").select(*TEST, "file", F.coalesce("_up", "idx").alias("idx")).distinct()


# Files of the JVM, and file names that say nothing about what a file declares.
JVM_ENDINGS = (".java", ".kt", ".kts", ".groovy", ".scala")
NAMELESS_STEMS = ("mod", "lib", "main", "index", "__init__")


def load_closure(seeds: DataFrame, imports: DataFrame) -> DataFrame:
    """(test_file, file): all that test files load, through any number of imports.

    Semi-naive: a round joins only the pairs the last round found new, so a cycle ends and
    nothing is derived twice from the same pair. ``seeds`` holds test_file, ``imports`` file and target."""
    edges = imports.select("file", "target").distinct()
    fresh = checkpointed(seeds.select("test_file").distinct().join(edges.withColumnRenamed("file", "test_file"), "test_file").select("test_file", F.col("target").alias("file")))
    rounds = []
    while not fresh.isEmpty():
        rounds.append(fresh)
        known = reduce(DataFrame.unionByName, rounds)
        onward = fresh.join(edges, "file").select("test_file", F.col("target").alias("file")).distinct()
        fresh = checkpointed(onward.join(known, ["test_file", "file"], "left_anti"))
    return reduce(DataFrame.unionByName, rounds) if rounds else fresh


def declared_names(units: DataFrame, changes: DataFrame) -> DataFrame:
    """(file, word): for each JVM file whose declarations changed, what a test file may call it by: its
    top-level declarations before the change and its own name."""
    ends = reduce(lambda x, y: x | y, [F.col("file").endswith(e) for e in JVM_ENDINGS])
    moved = changes.filter("change = 'code' and not narrow").filter(ends).select("file")
    old = _side(units, "before").join(moved, "file", "left_semi")
    nameless = old.filter("path = ''").select("file", F.col("idx").alias("parent"), F.lit(True).alias("_top"))
    top = old.join(nameless, ["file", "parent"], "left").filter("parent is null or _top")
    stem = F.element_at(F.split(F.element_at(F.split("file", "/"), -1), r"\."), 1)
    said = top.select("file", F.element_at(F.split("path", r"\."), -1).alias("word")).unionByName(
        moved.select("file", stem.alias("word")).filter(~F.col("word").isin(*NAMELESS_STEMS)))
    return said.filter(F.octet_length("word") > 2).distinct()


def naming_tests(sources: DataFrame, names: DataFrame) -> DataFrame:
    """(test_file, file, word): test files whose text holds a name as a whole identifier; the first
    name of several.

    The texts are indexed by their identifiers, so names are found by equality. A name that is no
    identifier is found by the first one in it and then looked for as a whole."""
    index = sources.select("test_file", F.explode(F.array_distinct(words.identifiers(F.col("text")))).alias("_token"))
    keyed = names.withColumn("_token", F.regexp_extract("word", words.IDENTIFIER, 0)).filter("_token <> ''")
    met = keyed.join(index, "_token")
    plain = met.filter("word = _token").select("test_file", "file", "word")
    odd = met.filter("word <> _token").join(sources, "test_file").filter(words.names_word(F.col("text"), F.col("word"))).select("test_file", "file", "word")
    return plain.unionByName(odd).groupBy("test_file", "file").agg(F.min("word").alias("word"))


def helper_reasons(tests: DataFrame, helper_files: DataFrame, loads: DataFrame, followed: DataFrame, served: DataFrame) -> DataFrame:
    """Reasons for which changed files that nothing probes may have reached a test.

    ``loads`` (test_file, file): what the test files of ``followed`` load, all of whose imports are known; of other
    test files nothing is known. ``served`` (file, name): files that processes serving tests of that name
    loaded. A file a serving process loaded reached the tests it served and those that import it; any other reached
    those that import it, and, if no test is seen to import it, all of them; and all of whose loads nothing is known."""
    told = helper_files.select("file", F.concat("file", F.when(F.col("change") == "removed", " removed").otherwise(" changed")).alias("_what"))
    known = followed.select("test_file").distinct().withColumn("_known", F.lit(True))
    marked = tests.select(*TEST).join(known, "test_file", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    own = loads.join(known, "test_file", "left_semi").select("test_file", "file").distinct()
    imported = marked.filter("_known").join(own, "test_file").join(told, "file").select(*TEST, "file", "_what")
    by_server = told.join(served.select("file", "name").distinct(), "file").join(marked, "name").join(imported.select(*TEST, "file"), [*TEST, "file"], "left_anti")
    loose = told.join(served.select("file").distinct(), "file", "left_anti")
    unplaced = loose.join(own.select("file").distinct(), "file", "left_anti")
    # What any test may load, told to every test it concerns.
    wide = unplaced.withColumn("_known", F.lit(True)).unionByName(loose.withColumn("_known", F.lit(False)))
    may = marked.join(wide, "_known")
    said = [(imported, " (this test's file loads it)"), (by_server, " (a server that served this test loaded it)"), (may, " (a file tests may load)")]
    return reduce(DataFrame.unionByName, [rows.select(*TEST, F.concat("_what", F.lit(why)).alias("reason")) for rows, why in said]).distinct()


def affected_tests(
    tests: DataFrame, executions: DataFrame, closure: DataFrame, changes: DataFrame, difference: DataFrame,
    helper_files: DataFrame, loads: DataFrame, covered: DataFrame, followed: DataFrame, served: DataFrame, naming: DataFrame,
) -> DataFrame:
    """Tests sorted into affected, undetermined and unaffected, one row per reason.

    ``loads``, ``followed`` and ``served`` as in ``helper_reasons``; ``naming`` (test_file, file, word) which test files
    name a changed declaration; ``covered`` (file, idx) what the run as a whole reached. Tests whose silence
    proves nothing are undetermined wherever the change lies inside that, and tell the foremost reason of those.
    """
    moved = changes.filter(F.col("change").isin("removed", "bytes", "code"))
    ran_files = executions.select(*TEST, "file").distinct()
    hit_units = reached_units(executions, closure).join(
        difference.filter("change = 'changed'").select("file", F.col("old_idx").alias("idx")), ["file", "idx"])
    narrow_hits = hit_units.select(*TEST, "file").distinct().join(changes.filter("change = 'code' and narrow").select("file"), "file")
    named = tests.select(*TEST).join(naming.filter("file <> test_file"), "test_file").join(ran_files, [*TEST, "file"], "left_anti")
    own = F.col("file")
    parts = [
        tests.filter("not passed").select(*TEST, F.lit("did not pass in the run").alias("reason")),
        tests.join(moved.withColumnRenamed("file", "test_file"), "test_file").select(
            *TEST, F.when(F.col("change") == "removed", "test file removed").otherwise("test file changed").alias("reason")),
        ran_files.join(moved.filter("change in ('removed', 'bytes')"), "file").select(
            *TEST, F.concat(own, F.when(F.col("change") == "removed", " removed").otherwise(" changed"), F.lit(" (this test ran code in it)")).alias("reason")),
        narrow_hits.select(*TEST, F.concat(own, F.lit(": changed (this test ran it)")).alias("reason")),
        ran_files.join(moved.filter("change = 'code' and not narrow"), "file").select(
            *TEST, F.concat(own, F.lit(": changed (this test ran code in this file)")).alias("reason")),
        helper_reasons(tests, helper_files, loads, followed, served),
        named.select(*TEST, F.concat(own, F.lit(": declarations changed, and the test file names "), "word").alias("reason")),
    ]
    reasons = reduce(DataFrame.unionByName, parts).distinct()
    # One row for the whole run: the foremost reason why the change lies inside what it covered.
    inside = beyond_the_run(changes, difference, covered, closure).agg(F.min_by("reason", F.struct("rank", "reason")).alias("_inside"))
    loose = tests.filter(~coverage_is_complete(F.col("attribution"))).join(reasons.select(*TEST).distinct(), TEST, "left_anti")
    unclear = loose.select(*TEST, F.lit(1).alias("_k")).join(inside.withColumn("_k", F.lit(1)), "_k").filter("_inside is not null").select(*TEST, "_inside")
    return tests.select(*TEST, "attribution").join(reasons, TEST, "left").join(unclear, TEST, "left").select(
        *TEST, "attribution", F.coalesce("reason", "_inside").alias("reason"),
        F.when(F.col("reason").isNotNull(), "affected").when(F.col("_inside").isNotNull(), "undetermined").otherwise("unaffected").alias("bucket"))


def beyond_the_run(changes: DataFrame, difference: DataFrame, covered: DataFrame, closure: DataFrame) -> DataFrame:
    """Changed files whose change lies inside what the run covered: (file, why, rank, reason).

    A file that went or cannot be read apart counts whole; of code only declarations that hold something
    covered, so a change to what no test ran, or what was only added, is outside."""
    gone = changes.filter("change in ('removed', 'bytes')").select("file", F.col("change").alias("why"))
    up = closure.select("file", "idx", "ancestor")
    reached = covered.join(up, ["file", "idx"], "left").select("file", F.coalesce("ancestor", "idx").alias("old_idx")).distinct()
    hit = difference.filter("change = 'changed'").join(reached, ["file", "old_idx"], "left_semi").select("file").distinct()
    code = changes.filter("change = 'code'").join(hit, "file", "left_semi").select("file", F.lit("code").alias("why"))
    rank = F.when(F.col("why") == "removed", 0).when(F.col("why") == "bytes", 1).otherwise(2)
    told = F.when(F.col("why") == "removed", " removed (the run covered code in it)").when(F.col("why") == "bytes", " changed (the run covered code in it)").otherwise(": changed (the run covered it)")
    return gone.unionByName(code).select("file", "why", rank.alias("rank"), F.concat("file", told).alias("reason"))


def merged_affected(rows: DataFrame) -> DataFrame:
    """Answers of a merge's parents as one: the strongest bucket per test, its reasons united."""
    rank = F.when(F.col("bucket") == "affected", 0).when(F.col("bucket") == "undetermined", 1).otherwise(2)
    best = rows.withColumn("_rank", rank).groupBy(*TEST).agg(F.min("_rank").alias("_best"))
    kept = rows.withColumn("_rank", rank).join(best, TEST).filter("_rank = _best")
    return kept.select(*TEST, "bucket", "reason").distinct()


def changed_words(changes: DataFrame) -> DataFrame:
    """One row: the words of all changed files' names."""
    moved = changes.filter(~F.col("change").isin("same", "comments only"))
    return moved.select(F.explode(words.path_words(F.col("file"))).alias("w")).select("w").distinct()


def matched_words(tests: DataFrame, changed: DataFrame) -> DataFrame:
    """How many of the changed files' words each test shares."""
    mine = tests.select(*TEST, F.explode(words.test_words(F.col("test_file"), F.col("name"))).alias("w"))
    return mine.join(changed, "w").groupBy(*TEST).agg(F.count(F.lit(1)).alias("name_match"))


VERDICT_RANKS = {"must run": 0, "catches": 1, "unassessed": 2, "runs": 3, "misses": 4}


def assertion_verdicts(buckets: DataFrame, statements: DataFrame, threshold: float = 0.5) -> DataFrame:
    """What an affected test is judged to do about the change.

    ``statements``: test_file, name, file, line, p (null where it was not asked)
    and complete, the changed statements each test ran."""
    tests = buckets.filter("bucket = 'affected'").groupBy(*TEST).agg(
        F.bool_or(F.col("reason").startswith("test file") | (F.col("reason") == "did not pass in the run")).alias("_own"))
    answered = statements.groupBy(*TEST).agg(
        F.max("p").alias("best"), F.count(F.lit(1)).alias("_in_play"), F.bool_and("complete").alias("_complete"))
    joined = tests.join(answered, TEST, "left")
    verdict = (
        F.when(F.col("_own"), "must run").when(F.col("best") >= threshold, "catches").when(F.col("best").isNotNull(), "runs")
        .when((F.col("_in_play") > 0) & F.col("_complete"), "misses").otherwise("unassessed")
    )
    return joined.select(*TEST, verdict.alias("verdict"), "best")


def order_affected(verdicts: DataFrame, matches: DataFrame) -> DataFrame:
    """Must-run tests first, then those sharing most words, by verdict, best answer, file, name."""
    rank = F.lit(9)
    for name, value in VERDICT_RANKS.items():
        rank = F.when(F.col("verdict") == name, value).otherwise(rank)
    told = verdicts.join(matches, TEST, "left").withColumn("name_match", F.coalesce("name_match", F.lit(0))).withColumn("rank", rank)
    return told.orderBy(F.col("rank") != 0, F.desc("name_match"), "rank", F.desc(F.floor(F.coalesce("best", F.lit(0.0)) * 1000)), *TEST)
