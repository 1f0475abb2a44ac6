"""Detail queries, run diffs, patches and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import compare_runs, coverage, detail, gaps, selection
from attestry.operators.selection import TestFilter
from attestry.plans.catalog import query
from attestry.plans.coverage_queries import BASE, O_STATES, SUMMARY_ROW, evidence, o_counts, o_totals
from attestry.plans.model import Model

OLD, NEW = "run_A1996", "run_N1996"


@query("line_tests", """
  SELECT DISTINCT p.run_id, p.file, p.line, h.test_id, t.name, t.kind, t.runner FROM points p JOIN hits h ON h.run_id = p.run_id AND h.hit_id = p.id
  JOIN tests t ON t.run_id = h.run_id AND t.test_id = h.test_id WHERE NOT p.declined""")
def line_tests(m: Model):
    return detail.line_tests(m.points, m.hits, m.tests)


@query("line_first_tests", """
  WITH d AS (SELECT DISTINCT p.run_id, p.file, p.line, h.test_id, t.name FROM points p JOIN hits h ON h.run_id = p.run_id AND h.hit_id = p.id
    JOIN tests t ON t.run_id = h.run_id AND t.test_id = h.test_id WHERE NOT p.declined)
  SELECT run_id, file, line, test_id, place FROM (SELECT *, row_number() OVER (PARTITION BY run_id, file, line ORDER BY name, test_id) AS place FROM d) WHERE place <= 3""")
def line_first_tests(m: Model):
    return detail.line_tests(m.points, m.hits, m.tests, first=3).select("run_id", "file", "line", "test_id", "place")


@query("line_limitations", f"""
  WITH w AS (SELECT DISTINCT run_id, file, line FROM points)
  SELECT w.run_id, w.file, w.line, l.id FROM w JOIN limitations l ON l.run_id = w.run_id AND l.file = w.file
   AND (l.line = w.line OR (l.kind = 'source-scope' AND (coalesce(l.source, '') = '' OR l.source = l.file)))""")
def line_limitations(m: Model):
    return detail.limitations_of_lines(m.points, m.limitations)


@query("line_detail", f"""{O_STATES},
  w AS (SELECT run_id, file, line, bool_or(NOT declined) AS measured FROM points GROUP BY ALL),
  t AS (SELECT p.run_id, p.file, p.line, count(DISTINCT h.test_id) AS tests, count(DISTINCT t.kind) AS kinds FROM points p JOIN o_hits h ON h.run_id = p.run_id AND h.hit_id = p.id
     JOIN tests t ON t.run_id = h.run_id AND t.test_id = h.test_id WHERE NOT p.declined GROUP BY ALL),
  o AS (SELECT run_id, file, line, count(*) AS open FROM states WHERE metric <> 'lines' AND NOT covered GROUP BY ALL),
  n AS (SELECT w.run_id, w.file, w.line, count(*) AS limitations FROM w JOIN limitations l ON l.run_id = w.run_id AND l.file = w.file
     AND (l.line = w.line OR (l.kind = 'source-scope' AND (coalesce(l.source, '') = '' OR l.source = l.file))) GROUP BY ALL)
  SELECT w.run_id, w.file, w.line, w.measured, coalesce(tests, 0) AS tests, coalesce(kinds, 0) AS kinds, coalesce(limitations, 0) AS limitations, coalesce(open, 0) AS open
  FROM w LEFT JOIN t USING (run_id, file, line) LEFT JOIN n USING (run_id, file, line) LEFT JOIN o USING (run_id, file, line)""")
def line_detail(m: Model):
    points, branches, decisions, hits, vectors = evidence(m)
    states = gaps.obligation_states(points, branches, decisions, hits, vectors)
    # Hits on branches name no point.
    return detail.line_detail(points, m.hits, m.tests, m.limitations, states)


@query("test_detail", """
  SELECT t.run_id, t.test_id, t.name, t.role,
    (SELECT count(DISTINCT hit_id) FROM hits h WHERE h.run_id = t.run_id AND h.test_id = t.test_id) AS hits,
    (SELECT count(DISTINCT hit_id) FROM hits h WHERE h.run_id = t.run_id AND h.test_id = t.test_id AND NOT EXISTS (SELECT 1 FROM points p WHERE p.run_id = h.run_id AND p.id = h.hit_id)) AS unknown_hits,
    (SELECT count(DISTINCT (p.file, p.line)) FROM hits h JOIN points p ON p.run_id = h.run_id AND p.id = h.hit_id WHERE h.run_id = t.run_id AND h.test_id = t.test_id) AS lines,
    (SELECT count(DISTINCT decision_id) FROM vectors v WHERE v.run_id = t.run_id AND v.test_id = t.test_id) AS decisions,
    (SELECT count(*) FROM vectors v WHERE v.run_id = t.run_id AND v.test_id = t.test_id) AS vectors,
    (SELECT count(*) FROM records r WHERE r.run_id = t.run_id AND 't' || substr(r.test_id, 2) = t.test_id) AS phases
  FROM tests t""")
def test_detail(m: Model):
    phases = m.records.select("run_id", F.concat(F.lit("t"), F.substring("test_id", 2, 20)).alias("test_id"))
    return detail.test_detail(m.tests, m.points, m.hits, m.vectors_, phases)


@query("decision_detail", f"""
  WITH pick AS (SELECT run_id, test_id FROM tests WHERE role = 'test' AND kind IN ('unit')),
  v AS (SELECT DISTINCT v.run_id, v.decision_id, v.a, v.b, v.c, v.outcome, v.width FROM vectors v JOIN pick USING (run_id, test_id)),
  e AS (SELECT d.run_id, d.id AS decision_id, s.i AS condition FROM decisions d, (VALUES (0), (1), (2)) s(i) WHERE NOT d.declined AND s.i < d.width),
  val AS (SELECT run_id, decision_id, 0 AS condition, bool_or(a) AS t, bool_or(NOT a) AS f FROM v GROUP BY ALL
    UNION ALL SELECT run_id, decision_id, 1, bool_or(b), bool_or(NOT b) FROM v GROUP BY ALL
    UNION ALL SELECT run_id, decision_id, 2, bool_or(c), bool_or(NOT c) FROM v GROUP BY ALL),
  sh AS (SELECT DISTINCT l.run_id, l.decision_id, CASE WHEN coalesce(l.a <> r.a, FALSE) THEN 0 WHEN coalesce(l.b <> r.b, FALSE) THEN 1 ELSE 2 END AS condition
    FROM v l JOIN v r ON l.run_id = r.run_id AND l.decision_id = r.decision_id AND l.outcome AND NOT r.outcome
     AND CAST(coalesce(l.a <> r.a, FALSE) AS INT) + CAST(coalesce(l.b <> r.b, FALSE) AS INT) + CAST(coalesce(l.c <> r.c, FALSE) AS INT) = 1),
  j AS (SELECT e.*, coalesce(t, FALSE) AS t, coalesce(f, FALSE) AS f, sh.condition IS NOT NULL AS covered FROM e LEFT JOIN val USING (run_id, decision_id, condition) LEFT JOIN sh USING (run_id, decision_id, condition))
  SELECT run_id, decision_id, condition, covered, CASE WHEN t AND f THEN '' WHEN t THEN 'false' WHEN f THEN 'true' ELSE 'true,false' END AS missing,
    CASE WHEN t AND f THEN '`c' || condition || '` was seen both ways but never deciding the result alone' WHEN t THEN '`c' || condition || '` was never false'
      WHEN f THEN '`c' || condition || '` was never true' ELSE '`c' || condition || '` was never evaluated' END AS words FROM j""")
def decision_detail(m: Model):
    picked = selection.picked_tests(m.tests_, TestFilter(kind="unit"))
    return detail.decision_detail(m.decisions_, m.vectors_, picked).drop("first_vector", "second_vector")


@query("covered_elsewhere", """
  WITH pick AS (SELECT run_id, test_id FROM tests WHERE role = 'test' AND kind = 'e2e'),
  h AS (SELECT DISTINCT h.run_id, h.test_id, h.hit_id, EXISTS (SELECT 1 FROM pick p WHERE p.run_id = h.run_id AND p.test_id = h.test_id) AS mine FROM hits h)
  SELECT p.run_id, p.id, p.file, p.line, count(*) AS tests, string_agg(DISTINCT t.kind, ',' ORDER BY t.kind) AS kinds, string_agg(DISTINCT t.runner, ',' ORDER BY t.runner) AS runners
  FROM points p JOIN h ON h.run_id = p.run_id AND h.hit_id = p.id JOIN tests t ON t.run_id = h.run_id AND t.test_id = h.test_id
  WHERE NOT p.declined GROUP BY p.run_id, p.id, p.file, p.line HAVING NOT bool_or(h.mine)""")
def covered_elsewhere(m: Model):
    return detail.covered_elsewhere(m.points, m.hits, m.tests, selection.picked_tests(m.tests_, TestFilter(kind="e2e")))


@query("selected_inclusion", """
  SELECT p.run_id, p.id, EXISTS (SELECT 1 FROM hits h JOIN tests t ON t.run_id = h.run_id AND t.test_id = h.test_id WHERE t.kind = 'unit' AND h.run_id = p.run_id AND h.hit_id = p.id) AS covered
  FROM points p WHERE NOT declined""")
def selected_inclusion(m: Model):
    chosen = m.tests.filter("kind = 'unit'").select("run_id", "test_id")
    met = coverage.covered_ids(m.hits.join(chosen, ["run_id", "test_id"], "left_semi"), ["run_id"]).withColumn("covered", F.lit(True))
    return m.points.filter("not declined").join(met, ["run_id", "id"], "left").select("run_id", "id", F.coalesce("covered", F.lit(False)).alias("covered"))


@query("compact_source", r"""
  WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\r?\n'), lambda t: regexp_matches(t, '\S'))[1] AS l FROM documents),
  s AS (SELECT doc_id, trim(regexp_replace(l, '\s+', ' ', 'g')) AS l FROM d)
  SELECT doc_id, CASE WHEN length(l) > 120 THEN substr(l, 1, 119) || '…' ELSE l END AS shown FROM s""")
def compact_source(m: Model):
    return m.documents.select("doc_id", detail.compact_source(F.col("text")).alias("shown"))


# --- diff -----------------------------------------------------------------------

def facts(m: Model):
    states = compare_runs.covered_facts(gaps.obligation_states(*evidence(m)))
    return states.filter(F.col("run_id") == OLD), states.filter(F.col("run_id") == NEW)


O_DIFF = f"""{O_STATES},
  f AS (SELECT run_id, metric, id, file, line FROM states WHERE covered AND metric IN ('lines', 'branches', 'conditions')),
  df AS (SELECT metric, id, file, line, 'lost' AS side FROM f o WHERE run_id = '{OLD}' AND NOT EXISTS (SELECT 1 FROM f n WHERE n.run_id = '{NEW}' AND n.metric = o.metric AND n.id = o.id)
    UNION ALL SELECT metric, id, file, line, 'gained' FROM f n WHERE run_id = '{NEW}' AND NOT EXISTS (SELECT 1 FROM f o WHERE o.run_id = '{OLD}' AND n.metric = o.metric AND n.id = o.id))"""


@query("run_diff", f"{O_DIFF} SELECT * FROM df")
def run_diff(m: Model):
    return compare_runs.diff(*facts(m))


@query("run_diff_files", f"""{O_DIFF} SELECT file, {', '.join(f"count(*) FILTER (side = '{s}' AND metric = '{k}') AS {s}_{k}" for s in ('lost', 'gained') for k in ('lines', 'branches', 'conditions'))},
  count(*) FILTER (side = 'lost') AS lost, count(*) FILTER (side = 'gained') AS gained FROM df GROUP BY file ORDER BY lost DESC, gained DESC, file LIMIT 20""")
def run_diff_files(m: Model):
    return compare_runs.diff_files(compare_runs.diff(*facts(m)))


@query("run_diff_delta", f"""{BASE}, {o_counts("run_id")}, {o_totals("run_id")},
  s AS (SELECT t.run_id, t.metric, {SUMMARY_ROW} FROM t_totals t LEFT JOIN c_counts c ON c.run_id = t.run_id AND c.metric = t.metric)
  SELECT o.metric, o.pct AS older_pct, n.pct AS newer_pct, round((n.pct - o.pct) * 100) / 100 AS delta FROM s o JOIN s n ON n.metric = o.metric WHERE o.run_id = '{OLD}' AND n.run_id = '{NEW}'""")
def run_diff_delta(m: Model):
    rows = coverage.summary(*evidence(m), ["run_id"])
    return compare_runs.diff_delta(rows.filter(F.col("run_id") == OLD), rows.filter(F.col("run_id") == NEW))


# --- patch ----------------------------------------------------------------------

O_LINES = """
  ml AS (SELECT p.run_id, p.file, p.line, bool_or(NOT p.declined) AS measured, bool_or(NOT p.declined AND h.hit_id IS NOT NULL) AS covered
    FROM points p LEFT JOIN (SELECT DISTINCT run_id, hit_id FROM hits) h ON h.run_id = p.run_id AND h.hit_id = p.id GROUP BY ALL),
  pa AS (SELECT ml.run_id, ml.file, ml.line, ml.covered FROM ml JOIN changed c ON c.file = ml.file AND c.line = ml.line WHERE ml.measured)"""


def patched(m: Model):
    return compare_runs.patch(m.changed, coverage.line_fold(m.points, m.hits, m.tests))


@query("patch_lines", f"WITH {O_LINES} SELECT * FROM pa")
def patch_lines(m: Model):
    return patched(m)


O_NEAR = """regexp_replace({f}, '/?[^/]*$', '') || '|' || regexp_extract({f}, '\\.([^./]*)$', 1)"""


@query("patch_missing", f"""WITH {O_LINES}
  SELECT DISTINCT m.run_id, c.file FROM changed c, (SELECT DISTINCT run_id, {O_NEAR.format(f='file')} AS k FROM ml) m
  WHERE m.k = {O_NEAR.format(f='c.file')} AND NOT regexp_matches(lower(c.file), '(^|[/_.-])(test|spec)([_.-][^/]*)?$')
    AND NOT EXISTS (SELECT 1 FROM ml x WHERE x.run_id = m.run_id AND x.file = c.file)""")
def patch_missing(m: Model):
    return compare_runs.patch_missing(m.changed, coverage.line_fold(m.points, m.hits, m.tests))


@query("patch_check", f"""WITH {O_LINES}
  SELECT r.run_id, count(pa.line) AS eligible, count(*) FILTER (pa.covered) AS covered,
    CASE WHEN CAST(count(*) FILTER (pa.covered) AS HUGEINT) * 1000000 >= 600000 * count(pa.line) THEN 'pass' ELSE 'fail' END AS verdict, count(pa.line) = 0 AS empty
  FROM (SELECT DISTINCT run_id FROM points) r LEFT JOIN pa ON pa.run_id = r.run_id GROUP BY r.run_id""")
def patch_check(m: Model):
    return compare_runs.patch_check(patched(m), m.points.select("run_id").distinct(), 600_000)


O_RANGES = O_LINES + """,
  isl AS (SELECT run_id, file, line, line - row_number() OVER (PARTITION BY run_id, file ORDER BY line) AS g FROM (SELECT DISTINCT run_id, file, line FROM pa WHERE NOT covered)),
  rg AS (SELECT run_id, file, min(line) AS "start", max(line) AS "end" FROM isl GROUP BY run_id, file, g)"""


@query("uncovered_ranges", f"WITH {O_RANGES} SELECT * FROM rg")
def uncovered_ranges(m: Model):
    return compare_runs.uncovered_ranges(patched(m))


@query("uncovered_line_ranges", """
  WITH ml AS (SELECT p.run_id, p.file, p.line, bool_or(h.hit_id IS NOT NULL) AS covered
    FROM points p LEFT JOIN (SELECT DISTINCT run_id, hit_id FROM hits) h ON h.run_id = p.run_id AND h.hit_id = p.id WHERE NOT p.declined GROUP BY ALL),
  isl AS (SELECT run_id, file, line, line - row_number() OVER (PARTITION BY run_id, file ORDER BY line) AS g FROM ml WHERE NOT covered)
  SELECT run_id, file, min(line) AS "start", max(line) AS "end" FROM isl GROUP BY run_id, file, g""")
def uncovered_line_ranges(m: Model):
    lines = coverage.line_fold(m.points, m.hits, m.tests).filter("measured")
    return compare_runs.uncovered_ranges(lines)


@query("annotations", f"""WITH {O_RANGES}
  SELECT run_id, file, "start", "end", '::warning file=web/' || file || ',line=' || "start" || ',endLine=' || "end" || '::Changed ' ||
    CASE WHEN "start" = "end" THEN 'line ' || "start" ELSE 'lines ' || "start" || ' to ' || "end" END || ' not covered by the selected tests.' AS text
  FROM rg""")
def annotations(m: Model):
    return compare_runs.annotations(compare_runs.uncovered_ranges(patched(m)), prefix="web/")


@query("annotations_capped", f"""WITH {O_RANGES}
  SELECT run_id, file, "start", "end" FROM rg QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY file, "start") <= 50""")
def annotations_capped(m: Model):
    return compare_runs.annotations(compare_runs.uncovered_ranges(patched(m)), 50, "web/").drop("text")


@query("workflow_escape", """
  SELECT doc_id, md5(replace(replace(replace(text, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')) AS message,
    md5(replace(replace(replace(replace(replace(text, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C')) AS property FROM documents""")
def workflow_escape(m: Model):
    return m.documents.select("doc_id", F.md5(compare_runs.workflow_escape(F.col("text"), False)).alias("message"),
                              F.md5(compare_runs.workflow_escape(F.col("text"), True)).alias("property"))


# --- gates ----------------------------------------------------------------------

FLOORS = {"lines": 450_000, "functions": 500_000, "branches": 500_000}


@query("floor_check", f"""{BASE}, {o_counts("run_id")}, {o_totals("run_id")},
  s AS (SELECT t.run_id, t.metric, coalesce(c.covered, 0) AS covered, t.total, CASE t.metric WHEN 'lines' THEN 450000 ELSE 500000 END AS ppm
    FROM t_totals t LEFT JOIN c_counts c ON c.run_id = t.run_id AND c.metric = t.metric WHERE t.metric IN ('lines', 'functions', 'branches')),
  lines AS (SELECT p.run_id, p.file, count(DISTINCT p.line) AS total, count(DISTINCT p.line) FILTER (h.hit_id IS NOT NULL) AS covered FROM points p
    LEFT JOIN (SELECT DISTINCT run_id, hit_id FROM hits) h ON h.run_id = p.run_id AND h.hit_id = p.id WHERE NOT p.declined GROUP BY ALL),
  blocked AS (SELECT run_id, 'suite failed' AS reason FROM records GROUP BY run_id HAVING bool_or(run_id LIKE 'run_R%'))
  SELECT run_id, 'error' AS verdict, NULL AS metric, NULL AS file, reason, CAST(NULL AS BIGINT) AS covered, CAST(NULL AS BIGINT) AS total FROM blocked
  UNION ALL SELECT run_id, 'fail', metric, NULL, 'below floor', covered, total FROM s WHERE covered * 1000000 < ppm * total AND run_id NOT IN (SELECT run_id FROM blocked)
  UNION ALL SELECT run_id, 'fail', 'lines', file, 'below floor', covered, total FROM lines WHERE covered * 1000000 < 450000 * total AND run_id NOT IN (SELECT run_id FROM blocked)""")
def floor_check(m: Model):
    frames = evidence(m)
    none = m.points.select("run_id").distinct().withColumn("unmeasured", F.lit(0))
    blockers = m.records.filter("run_id like 'run_R%'").select("run_id", F.lit("suite failed").alias("reason")).distinct()
    by_file = coverage.summary(*frames, ["run_id"], by_file=True, metrics=["lines"])
    return compare_runs.floor_check(coverage.summary(*frames, ["run_id"], metrics=list(FLOORS)), by_file, FLOORS, none, blockers)


@query("floor_applicability", f"""{BASE}, {o_totals("run_id")},
  u AS (SELECT run_id, count(*) FILTER (declined) AS n FROM points GROUP BY run_id)
  SELECT t.run_id, t.metric, CASE WHEN t.total = 0 THEN 'not applicable' WHEN u.n > 0 THEN 'incomplete' ELSE 'measured' END AS applicability FROM t_totals t JOIN u ON u.run_id = t.run_id""")
def floor_applicability(m: Model):
    points, branches, decisions, _, _ = evidence(m)
    unmeasured = points.groupBy("run_id").agg(F.count_if("declined").alias("n"))
    return coverage.totals(points, branches, decisions, ["run_id"]).join(unmeasured, "run_id").select(
        "run_id", "metric", compare_runs.applicability(F.col("total"), F.col("n")).alias("applicability"))


@query("run_complete", f"""{BASE}, {o_counts("run_id")}, {o_totals("run_id")},
  s AS (SELECT t.run_id, bool_and(coalesce(c.covered, 0) = t.total) AS w FROM t_totals t LEFT JOIN c_counts c ON c.run_id = t.run_id AND c.metric = t.metric
     WHERE t.metric NOT IN ('decision_outcomes', 'value_selections') GROUP BY t.run_id),
  b AS (SELECT run_id, bool_or(coalesce(blocking, TRUE)) AS b, count(*) = 0 AS mc FROM limitations GROUP BY run_id)
  SELECT s.run_id, s.w AND NOT coalesce(b.b, FALSE) AND coalesce(b.mc, TRUE) AS structurally_complete,
    s.w AND NOT coalesce(b.b, FALSE) AND coalesce(b.mc, TRUE) AND s.run_id NOT LIKE 'run_N%' AS complete FROM s LEFT JOIN b ON b.run_id = s.run_id""")
def run_complete(m: Model):
    whole = coverage.completeness(coverage.summary(*evidence(m), ["run_id"]), m.limitations)
    measured = m.limitations.groupBy("run_id").agg((F.count(F.lit(1)) == 0).alias("measurement_complete"))
    runs = m.points.select("run_id").distinct().select(
        "run_id", F.lit("passed").alias("view"), F.lit(True).alias("valid"), F.col("run_id").like("run_N%").alias("stale"))
    return compare_runs.run_complete(whole, measured, runs)
