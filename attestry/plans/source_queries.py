"""Scans, exports, minimisation and needed vectors."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from attestry import schemas
from attestry.operators import coverage, gaps, minimize
from attestry.plans.catalog import query
from attestry.plans.coverage_queries import BASE, O_KEY, O_STATES, evidence, o_totals
from attestry.plans.model import Model
from attestry.session import shared_folder, stored
from attestry.sources import evidence as scans
from attestry.sources import exports, lcov

# --- scans of journals that the tables are written out as ---------------------------------


def files_of(m: Model, name: str, lines):
    """Text files in the shared folder, a folder for each ``run_id`` and its lines in order of ``pos``: written
    once in an application, then scanned like any others."""
    path = f"{shared_folder(m.spark)}/journals-{m.spark.sparkContext.applicationId}-{hashlib.sha256(m.sf_dir.encode()).hexdigest()[:12]}/{name}"
    if path not in _written:
        rows = lines().select("run_id", "pos", "text").repartition("run_id").sortWithinPartitions("run_id", "pos")
        rows.select("run_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("run_id").text(path)
        _written.add(path)
    return f"{path}/*/*.txt"


_written: set[str] = set()
RUN_OF_FILE = r"regexp_extract(file, '/run_id=([^/]+)/', 1)"


def journal(m: Model):
    """Server records as JSON lines, a folder for each run; every eleventh line torn."""
    def lines():
        scope = F.when(F.col("request").isNull() | (F.col("record_id") % 4 == 0), F.struct(F.col("process").alias("workerId"), F.col("run_id").alias("runId")))
        body = F.to_json(F.struct(F.lit("hit").alias("type"), F.col("hit_id").alias("id"), F.col("timestamp_ms").alias("timestampMs"), F.col("request"), scope.alias("scope")))
        text = F.when(F.col("record_id") % 11 == 0, F.expr("substring(body, 1, length(body) - 3)")).otherwise(F.col("body"))
        return m.background.withColumn("body", body).select("run_id", F.col("record_id").alias("pos"), text.alias("text"))

    return files_of(m, "server", lines)


@query("strict_scan", "SELECT run_id, test_id, retry, count(*) AS records FROM records GROUP BY ALL")
def strict_scan(m: Model):
    def lines():
        body = F.to_json(F.struct(F.col("test_id").alias("testId"), F.col("retry"), F.col("status"), F.col("expected_status").alias("expectedStatus"), F.struct(F.col("run_id").alias("runId")).alias("scope")))
        return m.records.select("run_id", F.col("seq").alias("pos"), body.alias("text"))

    read = scans.strict_records(m.spark, files_of(m, "records", lines))
    return read.groupBy(F.col("scope.runId").alias("run_id"), F.col("testId").alias("test_id"), "retry").agg(F.count(F.lit(1)).alias("records"))


@query("tolerant_scan", """
  SELECT count(*) FILTER (record_id % 11 <> 0) AS records, count(*) FILTER (record_id % 11 = 0) AS corrupt_records, count(DISTINCT run_id) FILTER (record_id % 11 = 0) AS corrupt_files FROM background""")
def tolerant_scan(m: Model):
    good, corrupt = scans.tolerant(scans.text_lines(m.spark, journal(m)))
    counted = good.agg(F.count(F.lit(1)).alias("records")).withColumn("_k", F.lit(1))
    return counted.join(corrupt.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("scoped_server_records", """
  WITH n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY record_id) AS pos FROM background),
  g AS (SELECT run_id AS file, pos, hit_id AS id, CASE WHEN request IS NULL OR record_id % 4 = 0 THEN process END AS w FROM n WHERE record_id % 11 <> 0)
  SELECT file, pos, id, last_value(w IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos) AS worker FROM g""")
def scoped_server_records(m: Model):
    read = scans.scoped_server_records(scans.numbered_lines(m.spark, journal(m)))
    return read.select(F.expr(RUN_OF_FILE).alias("file"), "pos", "id", F.col("scope.workerId").alias("worker"))


@query("event_columns", "SELECT run_id, test_id, event_id, hour_ms, event_type AS type, CASE WHEN event_id % 2 = 0 THEN 'browser' ELSE 'server' END AS environment, CASE WHEN event_id % 3 = 0 THEN 'ph1' END AS phase_id, ms AS timestamp_ms FROM event_times")
def event_columns(m: Model):
    # Each test's events of an hour written as one snapshot of columns, then decoded.
    types = ["view", "click", "signup", "purchase", "error"]
    kind = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("event_type")).cast("int") - 1
    item = F.struct("ms", F.col("event_id").cast("string").alias("id"), kind.alias("type"), (F.col("event_id") % 2).cast("int").alias("environment"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(-1).alias("phase"))
    packed = m.event_times.groupBy("run_id", "test_id", "hour_ms").agg(F.array_sort(F.collect_list(item)).alias("x"))
    deltas = F.transform("x", lambda e, i: e.ms - F.when(i == 0, F.lit(0)).otherwise(F.get("x", i - 1).ms))
    hits = F.transform("x", lambda e: F.concat(F.lit("h"), e.id))
    columns = F.struct(
        F.array(*[F.lit(t) for t in types]).alias("types"), F.array(F.lit("ph1")).alias("phases"), F.array(F.lit("browser"), F.lit("server")).alias("environments"),
        F.transform("x", lambda e, i: i.cast("string")).alias("id"), F.transform("x", lambda e: e.type).alias("type"), F.transform("x", lambda e: e.phase).alias("phase"),
        F.transform("x", lambda e: e.environment).alias("environment"), deltas.alias("t"), F.lit(None).cast("map<int,struct<values:array<boolean>,outcome:boolean>>").alias("vector"))
    decoded = scans.decode_events(packed.select("run_id", "test_id", "hour_ms", hits.alias("hits"), columns.alias("events")), ["run_id", "test_id", "hour_ms"])
    return decoded.select("run_id", "test_id", F.substring("id", 2, 20).cast("long").alias("event_id"), "hour_ms", "type", "environment", "phase_id", "timestamp_ms")


@query("manifest_scan", """
  SELECT run_id, count(*) AS points, count(*) FILTER (declined) AS declined, count(DISTINCT file) AS files FROM points GROUP BY run_id""")
def manifest_scan(m: Model):
    # One manifest per file of a run, as shards write them.
    point = F.struct("id", "kind", "file", "line", F.col("col").alias("column"), "source", "label")
    written = m.points.groupBy("run_id", "file").agg(F.collect_list(point).alias("points"), F.array_compact(F.collect_list(F.when(F.col("declined"), F.col("id")))).alias("unmeasured"))
    text = F.to_json(F.struct(F.col("run_id").alias("runId"), "points", "unmeasured"))
    read = written.select(F.from_json(text, schemas.MANIFEST).alias("m")).select("m.*")
    return scans.manifest_tables(read)["points"].groupBy("run_id").agg(F.count(F.lit(1)).alias("points"), F.count_if("declined").alias("declined"), F.count_distinct("file").alias("files"))


def tracefile(m: Model):
    """LCOV lines, one file per run: a DA per hit, FN and FNDA per function hit."""
    hit = m.hits.join(m.points.select("run_id", F.col("id").alias("hit_id"), "file", "line", "kind", "label"), ["run_id", "hit_id"])
    # A file's lines lie together, so each file has a number of its own: a hash of its name can be another's, too.
    numbers = stored(m.spark, m.sf_dir, "file_numbers", lambda: m.points.select("file").distinct().withColumn("_file", F.monotonically_increasing_id()))
    hit = hit.join(numbers, "file")
    base = F.col("_file") * 100_000
    files = hit.select("run_id", "file", "_file").distinct()
    rows = [
        files.select("run_id", base.alias("pos"), F.concat(F.lit("SF:"), "file").alias("text")),
        files.select("run_id", (base + 99_999).alias("pos"), F.lit("end_of_record").alias("text")),
        hit.groupBy("run_id", "file", "_file", "line").agg(F.count(F.lit(1)).alias("n")).select("run_id", (base + 50_000 + F.col("line")).alias("pos"), F.format_string("DA:%d,%s", "line", F.when(F.col("line") % 7 == 0, "0.5").otherwise(F.col("n").cast("string"))).alias("text")),
    ]
    functions = hit.filter("kind = 'function'").groupBy("run_id", "file", "_file", "line").agg(F.count(F.lit(1)).alias("n"))
    rows.append(functions.select("run_id", (base + 10_000 + F.col("line")).alias("pos"), F.when(F.col("line") % 2 == 0, F.format_string("FN:%d,%d,fn%d", "line", F.col("line") + 3, "line")).otherwise(F.format_string("FN:%d,fn%d", "line", "line")).alias("text")))
    rows.append(functions.select("run_id", (base + 20_000 + F.col("line")).alias("pos"), F.format_string("FNDA:%d,fn%d", "n", "line").alias("text")))
    union = rows[0]
    for other in rows[1:]:
        union = union.unionByName(other)
    return union.withColumnRenamed("run_id", "file")


O_HIT = "ht AS (SELECT h.run_id, p.file, p.line, p.kind FROM hits h JOIN points p ON p.run_id = h.run_id AND p.id = h.hit_id)"


@query("lcov_lines", f"WITH {O_HIT}, d AS (SELECT run_id, file, line, CASE WHEN line % 7 = 0 THEN 1 ELSE count(*) END AS n FROM ht GROUP BY run_id, file, line) SELECT file, line, CAST(sum(n) AS BIGINT) AS count FROM d GROUP BY ALL")
def lcov_lines(m: Model):
    return lcov.read_lines(tracefile(m))


@query("lcov_functions", f"WITH {O_HIT} SELECT file, line, count(*) AS count FROM ht WHERE kind = 'function' GROUP BY ALL")
def lcov_functions(m: Model):
    return lcov.read_functions(tracefile(m))


@query("line_evidence_import", f"""WITH {O_HIT}, l AS (SELECT DISTINCT file, line FROM ht WHERE run_id = 'run_N1996'), f AS (SELECT DISTINCT file, line FROM ht WHERE run_id = 'run_N1996' AND kind = 'function')
  SELECT p.run_id, 'imported' AS test_id, p.id AS hit_id FROM points p WHERE p.run_id = 'run_A1996' AND ((kind = 'statement' AND (file, line) IN (SELECT (file, line) FROM l)) OR (kind = 'function' AND (file, line) IN (SELECT (file, line) FROM f)))""")
def line_evidence_import(m: Model):
    trace = tracefile(m).filter("file = 'run_N1996'")
    return lcov.import_hits(lcov.read_lines(trace), lcov.read_functions(trace), m.points, "run_A1996", "imported")


@query("line_evidence_unmeasured", f"""WITH {O_HIT}, d AS (SELECT DISTINCT file, line FROM ht WHERE run_id = 'run_N1996') SELECT 'run_A1996' AS run_id, 'line:' || file || ':' || line AS id, 'statement' AS kind, file, line, TRUE AS covered
  FROM d WHERE file NOT IN (SELECT file FROM points WHERE run_id = 'run_A1996' AND line % 50 = 3)""")
def line_evidence_unmeasured(m: Model):
    known = m.points.filter("line % 50 = 3")
    return lcov.import_unmeasured(lcov.read_lines(tracefile(m).filter("file = 'run_N1996'")), known, "run_A1996")


@query("line_evidence_past_end", f"""WITH {O_HIT}, d AS (SELECT DISTINCT file, line FROM ht), e AS (SELECT file, max(line) - 1 AS lines FROM sites GROUP BY file) SELECT d.file, d.line, e.lines FROM d JOIN e ON e.file = d.file WHERE d.line > e.lines""")
def line_evidence_past_end(m: Model):
    lengths = m.sites.groupBy("file").agg((F.max("line") - 1).alias("lines"))
    return lcov.past_the_end(lcov.read_lines(tracefile(m)), lengths)


@query("path_suffix_match", """
  SELECT DISTINCT 'C:\\work\\repo\\' || replace(file, '/', '\\') AS recorded, file FROM sites UNION SELECT DISTINCT './' || file, file FROM sites""")
def path_suffix_match(m: Model):
    files = m.sites.select("file").distinct()
    recorded = files.select(F.concat(F.lit("C:\\work\\repo\\"), F.translate("file", "/", "\\")).alias("recorded")).unionByName(files.select(F.concat(F.lit("./"), "file").alias("recorded")))
    return lcov.match_paths(recorded, files)


@query("unified_diff_lines", """
  WITH d AS (SELECT doc_id, path, 1 + n_chars % 90 AS a, n_chars % 4 AS n FROM paths WHERE doc_id % 13 <> 0) SELECT DISTINCT path AS file, CAST(unnest(range(a, a + CASE WHEN n = 3 THEN 1 ELSE n END)) AS INT) AS line FROM d""")
def unified_diff_lines(m: Model):
    n, start = F.col("n_chars") % 4, 1 + F.col("n_chars") % 90
    hunk = F.concat(F.lit("@@ -1,2 +"), start.cast("string"), F.when(n != 3, F.concat(F.lit(","), n.cast("string"))).otherwise(F.lit("")), F.lit(" @@ def f"))
    lines = F.array(F.lit("diff --git"), F.concat(F.lit("--- a/"), "path"), F.when(F.col("doc_id") % 13 == 0, F.lit("+++ /dev/null")).otherwise(F.concat(F.lit("+++ b/"), "path")), hunk, F.lit("+added"))
    patch = m.paths.select(F.lit("one.diff").alias("file"), "doc_id", F.posexplode(lines).alias("i", "text"), ).withColumn("pos", F.col("doc_id") * 10 + F.col("i")).select("file", "pos", "text")
    return lcov.changed_lines(patch)


@query("assessment_scan", "SELECT snapshot, path, max(value) AS worst, count(*) AS checks FROM answers GROUP BY ALL")
def assessment_scan(m: Model):
    body = F.to_json(F.struct("snapshot", "path", F.map_from_entries(F.collect_list(F.struct(F.concat_ws("#", "check_id", F.col("window_no").cast("string")), "value"))).alias("checks")))
    read = m.answers.groupBy("snapshot", "path").agg(body.alias("text")).select(F.from_json("text", schemas.ASSESSED_FILE).alias("f"))
    return read.select("f.snapshot", "f.path", F.array_max(F.map_values("f.checks")).alias("worst"), F.size("f.checks").alias("checks"))


# --- exports ------------------------------------------------------------------------

def view(m: Model):
    return exports.run_view(*evidence(m))


O_VIEW = f"""{O_STATES}, {o_totals("run_id, file")},
  vl AS (SELECT run_id, file, line, covered FROM states WHERE metric = 'lines'),
  vf AS (SELECT p.run_id, p.file, p.line, p.label AS name, s.covered FROM points p JOIN states s ON s.run_id = p.run_id AND s.id = p.id AND s.metric = 'functions'),
  vb AS (SELECT b.run_id, b.file, b.line, b.branch_id, b.id, s.covered AS taken, dense_rank() OVER (PARTITION BY b.run_id, b.file ORDER BY b.line, b.col, b.branch_id) - 1 AS block,
     row_number() OVER (PARTITION BY b.run_id, b.branch_id ORDER BY b.id) - 1 AS i FROM o_branches b JOIN states s ON s.run_id = b.run_id AND s.id = b.id AND s.metric = 'branches'),
  vn AS (SELECT run_id, file, metric, count(*) AS t, count(*) FILTER (covered) AS c FROM states GROUP BY ALL),
  vw AS (SELECT f.run_id, f.file, {', '.join(f"coalesce(max(t) FILTER (metric = '{n}'), 0) AS t_{n}, coalesce(max(c) FILTER (metric = '{n}'), 0) AS c_{n}" for n in ('lines', 'statements', 'functions', 'branches'))}
     FROM (SELECT DISTINCT run_id, file FROM points) f LEFT JOIN vn ON vn.run_id = f.run_id AND vn.file = f.file GROUP BY ALL),
  vm AS (SELECT d.run_id, d.file, d.line, d.col, CAST(right(s.id, 1) AS INT) AS condition, d.source || ' c' || right(s.id, 1) AS source, s.covered FROM decisions d JOIN states s ON s.run_id = d.run_id AND s.metric = 'conditions' AND s.id = d.id || '#' || right(s.id, 1)),
  ml AS (SELECT run_id, file, line, count(DISTINCT col) = count(DISTINCT n) AS apart FROM (SELECT run_id, file, line, col, count(*) AS n FROM vm GROUP BY ALL) GROUP BY ALL),
  mg AS (SELECT vm.*, CASE WHEN apart THEN vm.col ELSE -1 END AS g FROM vm JOIN ml USING (run_id, file, line)),
  mr AS (SELECT *, count(*) OVER (PARTITION BY run_id, file, line, g) AS n, row_number() OVER (PARTITION BY run_id, file, line, g ORDER BY col, condition, source) - 1 AS i FROM mg),
  bl AS (SELECT vb.run_id, vb.file, coalesce(max(l.line) FILTER (l.line <= vb.line), min(l.line)) AS line, vb.taken, vb.id FROM vb JOIN vl l ON l.run_id = vb.run_id AND l.file = vb.file GROUP BY vb.run_id, vb.file, vb.id, vb.taken, vb.line),
  bn AS (SELECT run_id, file, line, count(*) FILTER (taken) AS y, count(*) FILTER (NOT taken) AS n FROM bl GROUP BY ALL),
  le AS (SELECT vl.*, CAST(covered AS INT) AS k, bn.y, bn.n FROM vl LEFT JOIN bn ON bn.run_id = vl.run_id AND bn.file = vl.file AND bn.line = vl.line)"""


@query("mcdc_records", f"""{O_VIEW} SELECT run_id, file, 'MCDC:' || line || ',' || n || ',' || s || ',' || CAST(covered AS INT) || ',' || i || ',' || source AS text FROM mr, (VALUES ('t'), ('f')) v(s)""")
def mcdc_records(m: Model):
    return exports.mcdc_rows(exports.stated_conditions(m.decisions_, m.vectors_)).select("run_id", "file", "text")


@query("branches_on_lines", f"{O_VIEW} SELECT run_id, file, line, y AS taken, n AS untaken FROM bn")
def branches_on_lines(m: Model):
    return exports.branches_by_line(view(m))


@query("lcov_export", f"""{O_VIEW}
  SELECT run_id, file, 'TN:' AS text FROM vw UNION ALL SELECT run_id, file, 'SF:' || file FROM vw UNION ALL SELECT run_id, file, 'FN:' || line || ',' || name FROM vf
  UNION ALL SELECT run_id, file, 'FNDA:' || CAST(covered AS INT) || ',' || name FROM vf UNION ALL SELECT run_id, file, 'FNF:' || t_functions FROM vw UNION ALL SELECT run_id, file, 'FNH:' || c_functions FROM vw
  UNION ALL SELECT run_id, file, 'BRDA:' || line || ',' || block || ',' || i || ',' || CASE WHEN taken THEN '1' ELSE '-' END FROM vb UNION ALL SELECT run_id, file, 'BRF:' || t_branches FROM vw UNION ALL SELECT run_id, file, 'BRH:' || c_branches FROM vw
  UNION ALL SELECT run_id, file, 'MCDC:' || line || ',' || n || ',' || s || ',' || CAST(covered AS INT) || ',' || i || ',' || source FROM mr, (VALUES ('t'), ('f')) v(s)
  UNION ALL SELECT run_id, file, 'MCF:' || 2 * count(*) FROM mr GROUP BY run_id, file UNION ALL SELECT run_id, file, 'MCH:' || 2 * count(*) FILTER (covered) FROM mr GROUP BY run_id, file
  UNION ALL SELECT run_id, file, 'DA:' || line || ',' || k FROM le UNION ALL SELECT run_id, file, 'LF:' || t_lines FROM vw UNION ALL SELECT run_id, file, 'LH:' || c_lines FROM vw UNION ALL SELECT run_id, file, 'end_of_record' FROM vw""")
def lcov_export(m: Model):
    return exports.lcov(view(m)).select("run_id", "file", "text")


def _rate(metric: str) -> str:
    return "printf('%.4f', CASE WHEN t_{m} = 0 THEN 1.0::DOUBLE ELSE c_{m} / t_{m} END)".format(m=metric)


@query("cobertura_export", f"""{O_VIEW}
  SELECT run_id, file, '        <class name="' || file || '" filename="' || file || '" line-rate="' || {_rate('lines')} || '" branch-rate="' || {_rate('branches')} || '" complexity="0">' AS text FROM vw
  UNION ALL SELECT run_id, file, '            <line number="' || line || '" hits="' || k || CASE WHEN y IS NULL THEN '"/>' ELSE '" branch="true" condition-coverage="' || CAST(round(y * 100.0::DOUBLE / (y + n)) AS INT) || '% (' || y || '/' || y + n || ')"/>' END FROM le""")
def cobertura_export(m: Model):
    return exports.cobertura(view(m), 0).filter("part = 1 and section in (0, 2)").select("run_id", "file", "text")


@query("clover_export", f"""{O_VIEW} SELECT run_id, file, '      <line num="' || line || '" count="' || k || CASE WHEN y IS NULL THEN '" type="stmt"/>' ELSE '" type="cond" truecount="' || y || '" falsecount="' || n || '"/>' END AS text FROM le
  UNION ALL SELECT run_id, file, '    <file name="' || regexp_extract(file, '[^/]*$') || '" path="' || file || '">' || chr(10) || '      <metrics statements="' || t_statements || '" coveredstatements="' || c_statements || '" conditionals="' || t_branches || '" coveredconditionals="' || c_branches
    || '" methods="' || t_functions || '" coveredmethods="' || c_functions || '" elements="' || t_statements + t_branches + t_functions || '" coveredelements="' || c_statements + c_branches + c_functions || '" complexity="0" loc="' || t_lines || '" ncloc="' || t_lines || '"/>' FROM vw""")
def clover_export(m: Model):
    return exports.clover(view(m), 0).filter("part = 1 and section in (0, 1)").select("run_id", "file", "text")


@query("sonar_export", f"""{O_VIEW} SELECT run_id, file, '    <lineToCover lineNumber="' || line || '" covered="' || covered || CASE WHEN y IS NULL THEN '"/>' ELSE '" branchesToCover="' || y + n || '" coveredBranches="' || y || '"/>' END AS text FROM le
  UNION ALL SELECT run_id, file, '  <file path="' || file || '">' FROM vw UNION ALL SELECT run_id, file, '  </file>' FROM vw""")
def sonar_export(m: Model):
    return exports.sonar(view(m)).filter("part = 1").select("run_id", "file", "text")


@query("jacoco_export", f"""{O_VIEW} SELECT run_id, '      <line nr="' || line || '" mi="' || 1 - k || '" ci="' || k || '" mb="' || coalesce(n, 0) || '" cb="' || coalesce(y, 0) || '"/>' AS text FROM le
  UNION ALL SELECT run_id, '  <package name="' || d || '">' FROM (SELECT DISTINCT run_id, regexp_replace(file, '/[^/]*$', '') AS d FROM vw)
  UNION ALL SELECT run_id, '    <class name="' || regexp_replace(file, '\\.[^.]*$', '') || '" sourcefilename="' || regexp_extract(file, '[^/]*$') || '">' FROM vw
  UNION ALL SELECT run_id, '    <sourcefile name="' || regexp_extract(file, '[^/]*$') || '">' FROM vw
  UNION ALL SELECT run_id, '    <counter type="INSTRUCTION" missed="' || sum(t_lines - c_lines) || '" covered="' || sum(c_lines) || '"/>' || chr(10) || '    <counter type="BRANCH" missed="' || sum(t_branches - c_branches) || '" covered="' || sum(c_branches) || '"/>' || chr(10)
    || '    <counter type="LINE" missed="' || sum(t_lines - c_lines) || '" covered="' || sum(c_lines) || '"/>' || chr(10) || '    <counter type="METHOD" missed="' || sum(t_functions - c_functions) || '" covered="' || sum(c_functions) || '"/>' || chr(10) || '  </package>'
    FROM vw GROUP BY run_id, regexp_replace(file, '/[^/]*$', '')""")
def jacoco_export(m: Model):
    rows = exports.jacoco(view(m), 0).filter("part = 1")
    kept = F.col("text").startswith("      <line ") | F.col("text").startswith("  <package") | F.col("text").startswith("    <class") | F.col("text").startswith("    <sourcefile") | F.col("text").startswith("    <counter")
    return rows.filter(kept).select("run_id", "text")


@query("istanbul_summary_export", f"""{O_VIEW},
  e AS (SELECT run_id, '/repo/' || file AS key, t_lines, c_lines, t_branches, c_branches FROM vw UNION ALL SELECT run_id, 'total', sum(t_lines), sum(c_lines), sum(t_branches), sum(c_branches) FROM vw GROUP BY run_id)
  SELECT run_id, key, CAST(t_lines AS BIGINT) AS lines, CASE WHEN t_lines = 0 THEN 100.0 ELSE round(c_lines * 10000.0::DOUBLE / t_lines) / 100 END AS lines_pct, CASE WHEN t_branches = 0 THEN 100.0 ELSE round(c_branches * 10000.0::DOUBLE / t_branches) / 100 END AS branches_pct FROM e""")
def istanbul_summary_export(m: Model):
    text = exports.istanbul_summary(view(m), "/repo")
    number = lambda path, kind: F.get_json_object("text", path).cast(kind)
    return text.select("run_id", "key", number("$.lines.total", "long").alias("lines"), number("$.lines.pct", "double").alias("lines_pct"), number("$.branches.pct", "double").alias("branches_pct"))


@query("istanbul_places", """
  WITH l AS (SELECT path AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM paths)
  SELECT file, CAST(line AS INT) AS line, CAST(CASE WHEN file LIKE '%.py' THEN length(text) - length(ltrim(text)) ELSE length(text) - length(ltrim(text)) END AS INT) AS start_col, CAST(line AS INT) AS end_line, CAST(length(rtrim(text)) AS INT) AS end_col FROM l WHERE trim(text) <> ''""")
def istanbul_places(m: Model):
    lines = m.paths.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("line", F.col("i") + 1)
    blank = F.char_length("text") - F.char_length(F.ltrim("text"))
    column = F.when(F.col("file").like("%.py"), blank).otherwise(blank + 1)
    points = lines.filter(F.trim("text") != "").select(
        "file", F.concat_ws(":", "file", F.col("line").cast("string")).alias("id"), F.lit("statement").alias("kind"), "line", F.lit(None).cast("string").alias("label"), column.alias("col"),
        F.trim("text").alias("source"), (F.col("line") % 2 == 0).alias("covered"))
    placed = exports.placed_points(points, lines.select("file", "line", "text"))
    return placed.filter("not stale").select("file", "line", "start_col", "end_line", "end_col")


@query("istanbul_export", """
  WITH l AS (SELECT path AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM paths)
  SELECT '/repo/' || file AS path, count(*) AS statements, count(*) FILTER (line % 2 = 0) AS hits FROM l WHERE trim(text) <> '' GROUP BY file""")
def istanbul_export(m: Model):
    lines = m.paths.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("line", F.col("i") + 1)
    blank = F.char_length("text") - F.char_length(F.ltrim("text"))
    column = F.when(F.col("file").like("%.py"), blank).otherwise(blank + 1)
    points = lines.filter(F.trim("text") != "").select(
        "file", F.concat_ws(":", "file", F.col("line").cast("string")).alias("id"), F.lit("statement").alias("kind"), "line", F.lit(None).cast("string").alias("label"), column.alias("col"),
        F.trim("text").alias("source"), (F.col("line") % 2 == 0).alias("covered"))
    branches = m.paths.select(F.col("path").alias("file"), F.lit(1).alias("line"), F.lit(0).alias("col"), F.lit("if").alias("kind"), F.array(F.lit(True), F.lit(False)).alias("taken"))
    text = exports.istanbul_files(exports.placed_points(points, lines.select("file", "line", "text")), branches, "/repo")
    hits = F.map_values(F.from_json(F.get_json_object("text", "$.s"), "map<string,int>"))
    return text.select(F.get_json_object("text", "$.path").alias("path"), F.size(hits).alias("statements"), F.size(F.filter(hits, lambda h: h == 1)).alias("hits"))


@query("open_obligation_export", f"""{O_STATES} SELECT run_id, file, line, metric AS kind, id FROM states WHERE NOT covered""")
def open_obligation_export(m: Model):
    written = exports.open_obligations(gaps.obligation_states(*evidence(m)))
    return written.select("run_id", F.from_json("text", "file string, line int, kind string, id string").alias("o")).select("run_id", "o.*")


@query("assessment_snapshot", "SELECT snapshot, path, max(bytes) AS bytes, count(*) AS checks FROM answers GROUP BY ALL")
def assessment_snapshot(m: Model):
    # What a snapshot saves of each file; writing and reading it back is tested on disk.
    return m.answers.groupBy("snapshot", "path").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("checks"))


# --- minimisation ---------------------------------------------------------------------

O_OWNERS = """
  ow AS (SELECT run_id, test_id, test_id AS owner FROM tests WHERE role = 'test' UNION SELECT s.run_id, s.test_id, t.test_id FROM tests s JOIN tests t ON t.run_id = s.run_id AND t.test_file = s.test_file WHERE s.role = 'setup' AND t.role = 'test')"""
O_OPTIONS = f"""{BASE}, {O_OWNERS},
  rx AS (SELECT DISTINCT h.run_id, h.hit_id AS id, ow.owner AS test_id FROM o_hits h JOIN ow ON ow.run_id = h.run_id AND ow.test_id = h.test_id),
  op AS (SELECT p.run_id, CASE p.kind WHEN 'function' THEN 'functions' ELSE 'statements' END AS metric, p.id, '' AS pair, 0 AS side, rx.test_id FROM points p JOIN rx ON rx.run_id = p.run_id AND rx.id = p.id WHERE NOT declined
    UNION ALL SELECT DISTINCT p.run_id, 'lines', p.file || ':' || p.line, '', 0, rx.test_id FROM points p JOIN rx ON rx.run_id = p.run_id AND rx.id = p.id WHERE NOT declined
    UNION ALL SELECT b.run_id, 'branches', b.id, '', 0, rx.test_id FROM o_branches b JOIN rx ON rx.run_id = b.run_id AND rx.id = b.id WHERE NOT declined),
  mv AS (SELECT v.run_id, v.decision_id, v.a, v.b, v.c, v.outcome, {O_KEY.replace('width', 'v.width')} AS k, v.seq, ow.owner FROM vectors v JOIN decisions d ON d.run_id = v.run_id AND d.id = v.decision_id LEFT JOIN ow ON ow.run_id = v.run_id AND ow.test_id = v.test_id WHERE NOT d.declined),
  dv AS (SELECT run_id, decision_id, a, b, c, outcome, k, min(seq) AS seq FROM mv GROUP BY ALL), vo AS (SELECT DISTINCT run_id, decision_id, k, owner FROM mv WHERE owner IS NOT NULL),
  ip AS (SELECT l.run_id, l.decision_id, l.decision_id || '#' || CASE WHEN coalesce(l.a <> r.a, FALSE) THEN 0 WHEN coalesce(l.b <> r.b, FALSE) THEN 1 ELSE 2 END AS id, l.k AS lk, r.k AS rk FROM dv l JOIN dv r ON l.run_id = r.run_id AND l.decision_id = r.decision_id
     AND l.outcome <> r.outcome AND (l.seq, l.k) < (r.seq, r.k) AND CAST(coalesce(l.a <> r.a, FALSE) AS INT) + CAST(coalesce(l.b <> r.b, FALSE) AS INT) + CAST(coalesce(l.c <> r.c, FALSE) AS INT) = 1),
  oc AS (SELECT ip.run_id, 'conditions' AS metric, ip.id, lk || '|' || rk AS pair, 0 AS side, vo.owner AS test_id FROM ip JOIN vo ON vo.run_id = ip.run_id AND vo.decision_id = ip.decision_id AND vo.k = ip.lk
    UNION ALL SELECT ip.run_id, 'conditions', ip.id, lk || '|' || rk, 1, vo.owner FROM ip JOIN vo ON vo.run_id = ip.run_id AND vo.decision_id = ip.decision_id AND vo.k = ip.rk)"""


def choices(m: Model):
    return minimize.options(*evidence(m), m.tests)


@query("obligation_options", f"{O_OPTIONS} SELECT * FROM op UNION ALL SELECT * FROM oc")
def obligation_options(m: Model):
    return choices(m)


@query("forced_tests", f"""{O_OPTIONS}, al AS MATERIALIZED (SELECT * FROM op UNION ALL SELECT * FROM oc),
  sd AS MATERIALIZED (SELECT run_id, metric, id, pair, side, count(*) AS t FROM al GROUP BY ALL),
  so AS MATERIALIZED (SELECT run_id || metric || id AS k FROM sd GROUP BY run_id, metric, id HAVING count(DISTINCT pair) = 1 AND max(t) = 1)
  SELECT run_id, test_id, count(DISTINCT metric || id) AS obligations FROM al WHERE run_id || metric || id IN (SELECT k FROM so) GROUP BY run_id, test_id""")
def forced_tests(m: Model):
    return minimize.forced_tests(minimize.held_options(*evidence(m), m.tests), minimize.holders(m.tests))


@query("attributed_runs", """
  SELECT DISTINCT run_id FROM tests t WHERE NOT EXISTS (SELECT 1 FROM tests x WHERE x.run_id = t.run_id AND x.kind = 'unit' AND x.role = 'test' AND x.attribution = 'partial' AND x.test_id > 't98')""")
def attributed_runs(m: Model):
    told = m.tests.withColumn("attribution", F.when((F.col("kind") == "unit") & (F.col("test_id") > "t98"), F.col("attribution")).otherwise("exact")).withColumn(
        "attribution", F.when(F.col("attribution") == "run-wide", "exact").otherwise(F.col("attribution"))).withColumn("role", F.when(F.col("role") == "background", "setup").otherwise(F.col("role")))
    return minimize.attributed_runs(told, m.hits)


def minimised(m: Model):
    """Every run's tests that keep all its obligations, of every metric; written once in an application."""
    held = stored(m.spark, m.sf_dir, "minimise-options", lambda: minimize.held_options(*evidence(m), m.tests))
    who = stored(m.spark, m.sf_dir, "minimise-holders", lambda: minimize.holders(m.tests))
    return held, stored(m.spark, m.sf_dir, "minimised", lambda: minimize.minimise(held, None, who=who)), who


@query("minimised_tests")
def minimised_tests(m: Model):
    return minimised(m)[1]


@query("minimised_keep_everything", f"""{O_OPTIONS}, al AS (SELECT run_id, metric, id FROM op UNION ALL SELECT run_id, metric, id FROM oc)
  SELECT run_id, metric, count(DISTINCT id) AS obligations FROM al GROUP BY ALL""")
def minimised_keep_everything(m: Model):
    return minimize.kept_obligations(*minimised(m))


# --- needed vectors ---------------------------------------------------------------------

def shapes(m: Model):
    wide = F.col("width") == 3
    return m.decisions.filter("not declined").select("run_id", "id", F.when(wide, "(a && b) || c").otherwise("a && b").alias("source"),
                                                    F.when(wide, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("names"))


@query("possible_vectors", """
  SELECT '(a && b) || c' AS source, r AS rank, k AS vector_key FROM (VALUES (0, 'F-F:F'), (1, 'TFF:F'), (2, 'TT-:T'), (3, 'F-T:T'), (4, 'TFT:T')) v(r, k) WHERE EXISTS (SELECT 1 FROM decisions WHERE width = 3)
  UNION ALL SELECT 'a && b', r, k FROM (VALUES (0, 'F-:F'), (1, 'TF:F'), (2, 'TT:T')) v(r, k) WHERE EXISTS (SELECT 1 FROM decisions WHERE width = 2)""")
def possible_vectors(m: Model):
    return minimize.possible_vectors(shapes(m)).select("source", "rank", "vector_key")


O_NEEDED = f"""
  dw AS (SELECT run_id, id AS decision_id, width FROM decisions WHERE NOT declined),
  sv AS (SELECT DISTINCT v.run_id, v.decision_id, v.a, v.b, v.c, v.outcome, {O_KEY.replace('width', 'v.width')} AS k FROM vectors v JOIN dw USING (run_id, decision_id)),
  pv(w, r, a, b, c, o, k) AS (VALUES (3, 0, FALSE, NULL, FALSE, FALSE, 'F-F:F'), (3, 1, TRUE, FALSE, FALSE, FALSE, 'TFF:F'), (3, 2, TRUE, TRUE, NULL, TRUE, 'TT-:T'), (3, 3, FALSE, NULL, TRUE, TRUE, 'F-T:T'), (3, 4, TRUE, FALSE, TRUE, TRUE, 'TFT:T'),
     (2, 0, FALSE, NULL, NULL, FALSE, 'F-:F'), (2, 1, TRUE, FALSE, NULL, FALSE, 'TF:F'), (2, 2, TRUE, TRUE, NULL, TRUE, 'TT:T')),
  pp AS (SELECT x.w, x.k AS xk, y.k AS yk, x.r AS xr, y.r AS yr, CASE WHEN coalesce(x.a <> y.a, FALSE) THEN 0 WHEN coalesce(x.b <> y.b, FALSE) THEN 1 ELSE 2 END AS condition FROM pv x JOIN pv y ON x.w = y.w AND x.o <> y.o
     AND CAST(coalesce(x.a <> y.a, FALSE) AS INT) + CAST(coalesce(x.b <> y.b, FALSE) AS INT) + CAST(coalesce(x.c <> y.c, FALSE) AS INT) = 1),
  sh AS (SELECT DISTINCT d.run_id, d.decision_id, p.condition FROM dw d JOIN sv l ON l.run_id = d.run_id AND l.decision_id = d.decision_id JOIN pp p ON p.w = d.width AND p.xk = l.k JOIN sv r ON r.run_id = l.run_id AND r.decision_id = l.decision_id AND r.k = p.yk),
  opn AS (SELECT d.*, s.i AS condition FROM dw d, (VALUES (0), (1), (2)) s(i) WHERE s.i < d.width AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.run_id = d.run_id AND sh.decision_id = d.decision_id AND sh.condition = s.i)),
  us AS (SELECT d.run_id, d.decision_id, d.width, pv.k, pv.r FROM dw d JOIN pv ON pv.w = d.width WHERE NOT EXISTS (SELECT 1 FROM sv WHERE sv.run_id = d.run_id AND sv.decision_id = d.decision_id AND sv.k = pv.k)),
  ga AS (SELECT DISTINCT us.run_id, us.decision_id, us.k, us.r, p.condition FROM us JOIN pp p ON p.w = us.width AND p.xk = us.k JOIN sv ON sv.run_id = us.run_id AND sv.decision_id = us.decision_id AND sv.k = p.yk),
  gn AS (SELECT ga.run_id, ga.decision_id, k, count(*) FILTER (NOT EXISTS (SELECT 1 FROM sh WHERE sh.run_id = ga.run_id AND sh.decision_id = ga.decision_id AND sh.condition = ga.condition)) AS fresh FROM ga GROUP BY ALL),
  be AS (SELECT ga.run_id, ga.decision_id, ga.condition, arg_max(ga.k, (gn.fresh, -length(replace(string_split(ga.k, ':')[1], '-', '')), ga.r)) AS k FROM ga JOIN gn USING (run_id, decision_id, k) JOIN opn USING (run_id, decision_id, condition) GROUP BY ALL),
  tw AS (SELECT x.run_id, x.decision_id, p.condition, min((p.xr, p.yr, x.k, y.k)) AS t FROM us x JOIN us y ON y.run_id = x.run_id AND y.decision_id = x.decision_id AND x.r < y.r JOIN pp p ON p.w = x.width AND p.xk = x.k AND p.yk = y.k GROUP BY ALL)"""


@query("needed_vectors", f"""WITH {O_NEEDED}
  SELECT o.run_id, o.decision_id, o.condition, CASE WHEN be.k IS NOT NULL THEN array_to_string(string_split(string_split(be.k, ':')[1], ''), ' ')
    WHEN tw.t IS NOT NULL THEN array_to_string(string_split(string_split(tw.t[3], ':')[1], ''), ' ') || ' and ' || array_to_string(string_split(string_split(tw.t[4], ':')[1], ''), ' ') END AS needed
  FROM opn o LEFT JOIN be USING (run_id, decision_id, condition) LEFT JOIN tw USING (run_id, decision_id, condition)""")
def needed_vectors(m: Model):
    return minimize.needed_vectors(shapes(m), m.vectors_).drop("words")
