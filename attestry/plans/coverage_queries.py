"""Views, outcomes, coverage summaries, gaps and dimensions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from attestry.operators import attempts, coverage, dimensions, gaps, mcdc, selection
from attestry.operators.selection import TestFilter
from attestry.plans.catalog import query
from attestry.plans.model import Model

PCT = "CASE WHEN {t} = 0 THEN 100.0 ELSE round({c} * 1.0 / {t} * 10000) / 100 END"


def pct(covered: str, total: str) -> str:
    return PCT.format(c=f"({covered})", t=f"({total})")


# Oracle building blocks, written from the definitions over the model views.
O_BRANCHES = """
  o_declared AS (SELECT * FROM alternatives UNION ALL BY NAME SELECT * FROM outcome_alternatives),
  o_branches AS (SELECT run_id, branch_id, kind, id, label, file, line, col, declined FROM o_declared
    UNION ALL BY NAME
    SELECT d.run_id, d.id || ':outcome' AS branch_id, 'decision' AS kind, d.id || ':outcome:' || s.label AS id, s.label, d.file, d.line, d.col, d.declined
    FROM decisions d, (VALUES ('true'), ('false')) s(label)
    WHERE NOT EXISTS (SELECT 1 FROM outcome_alternatives o WHERE o.run_id = d.run_id AND o.branch_id = d.id || ':outcome'))"""
O_HITS = """
  o_hits AS (SELECT run_id, test_id, hit_id FROM hits UNION ALL SELECT run_id, test_id, hit_id FROM branch_hits
    UNION ALL SELECT v.run_id, v.test_id, v.decision_id || ':outcome:' || CASE WHEN v.outcome THEN 'true' ELSE 'false' END
    FROM vectors v WHERE CAST(substr(v.decision_id, 2) AS BIGINT) % 9 <> 0)"""


def o_counts(keys: str, hits: str = "o_hits", vecs: str = "vectors", by_file: bool = False) -> str:
    """Covered counts per key, long, over hit and vector relations carrying the keys."""
    cols = [k.strip() for k in keys.split(",")]
    out = keys + (", file" if by_file else "")
    p = ", ".join(f"h.{c}" for c in cols) + (", o.file" if by_file else "")
    v = ", ".join(f"v.{c}" for c in cols) + (", d.file" if by_file else "")
    lv = ", ".join(f"l.{c}" for c in cols)
    on = " AND ".join(f"l.{c} = r.{c}" for c in cols)
    return f"""
  c_hits AS (SELECT DISTINCT {keys}, hit_id FROM {hits}),
  c_points AS (SELECT {p}, o.id, o.kind AS site_kind, o.line, o.file AS f FROM points o JOIN c_hits h ON h.run_id = o.run_id AND h.hit_id = o.id WHERE NOT o.declined),
  c_alts AS (SELECT {p}, o.id, o.kind AS site_kind FROM o_branches o JOIN c_hits h ON h.run_id = o.run_id AND h.hit_id = o.id WHERE NOT o.declined),
  c_vec AS (SELECT DISTINCT {v}, v.decision_id, d.width, v.a, v.b, v.c, v.outcome FROM {vecs} v JOIN decisions d ON d.run_id = v.run_id AND d.id = v.decision_id WHERE NOT d.declined),
  c_pairs AS (SELECT DISTINCT {lv}{', l.file' if by_file else ''}, l.decision_id, l.width,
      CASE WHEN coalesce(l.a <> r.a, FALSE) THEN 0 WHEN coalesce(l.b <> r.b, FALSE) THEN 1 ELSE 2 END AS condition
    FROM c_vec l JOIN c_vec r ON {on} AND l.decision_id = r.decision_id AND l.outcome AND NOT r.outcome
     AND CAST(coalesce(l.a <> r.a, FALSE) AS INT) + CAST(coalesce(l.b <> r.b, FALSE) AS INT) + CAST(coalesce(l.c <> r.c, FALSE) AS INT) = 1),
  c_dec AS (SELECT {out}, decision_id, width, count(DISTINCT outcome) AS o,
      count(DISTINCT a) + count(DISTINCT b) + count(DISTINCT c) AS vals FROM c_vec GROUP BY {out}, decision_id, width),
  c_shown AS (SELECT {out}, decision_id, width, count(*) AS n FROM c_pairs GROUP BY {out}, decision_id, width),
  c_counts AS (
    SELECT {out}, 'lines' AS metric, count(DISTINCT (f, line)) AS covered FROM c_points GROUP BY {out}
    UNION ALL SELECT {out}, CASE site_kind WHEN 'function' THEN 'functions' ELSE 'statements' END, count(*) FROM c_points GROUP BY {out}, site_kind
    UNION ALL SELECT {out}, 'branches', count(*) FROM c_alts GROUP BY {out}
    UNION ALL SELECT {out}, 'value_selections', count(*) FILTER (site_kind = 'logical-value') FROM c_alts GROUP BY {out}
    UNION ALL SELECT {out}, 'decision_outcomes', sum(o) FROM c_dec GROUP BY {out}
    UNION ALL SELECT {out}, 'condition_outcomes', sum(vals) FROM c_dec GROUP BY {out}
    UNION ALL SELECT {out}, 'executed_decisions', count(*) FROM c_dec GROUP BY {out}
    UNION ALL SELECT {out}, 'conditions', sum(n) FROM c_shown GROUP BY {out}
    UNION ALL SELECT {out}, 'covered_decisions', count(*) FILTER (n = width) FROM c_shown GROUP BY {out})"""


def o_totals(by: str) -> str:
    return f"""
  t_totals AS (
    SELECT {by}, 'lines' AS metric, count(DISTINCT (file, line)) AS total FROM points WHERE NOT declined GROUP BY {by}
    UNION ALL SELECT {by}, CASE kind WHEN 'function' THEN 'functions' ELSE 'statements' END, count(*) FROM points WHERE NOT declined GROUP BY {by}, kind
    UNION ALL SELECT {by}, 'branches', count(*) FROM o_branches WHERE NOT declined GROUP BY {by}
    UNION ALL SELECT {by}, 'value_selections', count(*) FROM o_branches WHERE NOT declined AND kind = 'logical-value' GROUP BY {by}
    UNION ALL SELECT {by}, 'decision_outcomes', count(*) * 2 FROM decisions WHERE NOT declined GROUP BY {by}
    UNION ALL SELECT {by}, 'condition_outcomes', sum(width) * 2 FROM decisions WHERE NOT declined GROUP BY {by}
    UNION ALL SELECT {by}, 'conditions', sum(width) FROM decisions WHERE NOT declined GROUP BY {by})"""


BASE = "WITH" + O_BRANCHES + "," + O_HITS
SUMMARY_ROW = f"coalesce(c.covered, 0) AS covered, t.total, {pct('coalesce(c.covered, 0)', 't.total')} AS pct"


def evidence(m: Model):
    return m.evidence


# --- views and attempts -------------------------------------------------------

O_ATTEMPTS = """
  o_attempts AS (SELECT run_id, test_id, retry, count(*) AS records,
      CASE WHEN bool_or(status = 'failed') THEN 'failed'
           ELSE coalesce(last(status ORDER BY seq, status) FILTER (status <> 'unknown'), 'unknown') END AS status,
      last(expected_status ORDER BY seq, expected_status) FILTER (expected_status IS NOT NULL) AS expected_status
    FROM records GROUP BY run_id, test_id, retry),
  o_effective AS (SELECT *, CASE WHEN expected_status = 'failed' AND status = 'failed' THEN 'passed'
      WHEN expected_status = 'failed' AND status = 'passed' THEN 'failed' ELSE status END AS effective FROM o_attempts)"""


@query("view_passed", """
  WITH o AS (SELECT run_id, test_id, retry, bool_or(status = 'passed') AS p, coalesce(bool_or(expected_status = 'failed'), FALSE) AS e
      FROM records GROUP BY ALL),
  l AS (SELECT run_id, test_id, max(retry) AS retry FROM o GROUP BY ALL)
  SELECT r.run_id, r.test_id, r.retry, r.status, count(*) AS records FROM records r JOIN l USING (run_id, test_id, retry)
  JOIN o USING (run_id, test_id, retry) WHERE o.p AND NOT o.e GROUP BY ALL""")
def view_passed(m: Model):
    return attempts.view(m.records, "passed").groupBy("run_id", "test_id", "retry", "status").agg(F.count(F.lit(1)).alias("records"))


@query("view_failed", """
  WITH a AS (SELECT *, bool_or(expected_status IS NOT NULL) OVER (PARTITION BY run_id, test_id, retry) AS stated FROM records),
  f AS (SELECT DISTINCT run_id, test_id, retry FROM a WHERE (NOT stated OR expected_status IS NOT NULL)
      AND ((status = 'passed' AND expected_status = 'failed') OR (status = 'failed' AND coalesce(expected_status, '') <> 'failed')))
  SELECT run_id, test_id, retry, status, count(*) AS records FROM records JOIN f USING (run_id, test_id, retry) GROUP BY ALL""")
def view_failed(m: Model):
    return attempts.view(m.records, "failed").groupBy("run_id", "test_id", "retry", "status").agg(F.count(F.lit(1)).alias("records"))


@query("view_all", "SELECT run_id, count(*) AS records, count(DISTINCT test_id) AS tests FROM records GROUP BY run_id")
def view_all(m: Model):
    return attempts.view(m.records, "all").groupBy("run_id").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("test_id").alias("tests"))


@query("attempt_fold", f"WITH {O_ATTEMPTS} SELECT run_id, test_id, retry, status, expected_status, records FROM o_attempts")
def attempt_fold(m: Model):
    return attempts.fold_attempts(m.records).select(
        "run_id", "test_id", "retry", "status", "expected_status", "records")


@query("terminal_attempt", "SELECT run_id, test_id, max(retry) AS retry FROM records GROUP BY run_id, test_id")
def terminal_attempt(m: Model):
    return attempts.terminal_attempts(m.records)


O_OUTCOMES = O_ATTEMPTS + """,
  o_last AS (SELECT run_id, test_id, arg_max(effective, retry) AS last_status, count(*) AS n,
      count(*) FILTER (effective <> 'passed') AS unpassed FROM o_effective GROUP BY run_id, test_id),
  o_flaky AS (SELECT run_id, test_id, bool_or(flaky) AS f FROM records GROUP BY run_id, test_id),
  o_outcomes AS (SELECT run_id, test_id, n AS attempts,
      CASE WHEN last_status = 'passed' AND (f OR unpassed > 0) THEN 'flaky' ELSE last_status END AS outcome
    FROM o_last JOIN o_flaky USING (run_id, test_id))"""


@query("test_outcome", f"WITH {O_OUTCOMES} SELECT run_id, test_id, outcome, attempts FROM o_outcomes")
def test_outcome(m: Model):
    return attempts.outcomes(m.records).select("run_id", "test_id", "outcome", "attempts")


@query("outcome_counts", f"""WITH {O_OUTCOMES} SELECT run_id, outcome, count(*) AS tests FROM o_outcomes
  JOIN (SELECT DISTINCT run_id, test_id FROM records WHERE role = 'test') USING (run_id, test_id) GROUP BY run_id, outcome""")
def outcome_counts(m: Model):
    return attempts.outcome_counts(m.records)


@query("test_attribution", """
  SELECT run_id, test_id, CASE max(CASE attribution WHEN 'run-wide' THEN 3 WHEN 'partial' THEN 2 WHEN 'by-time' THEN 1 ELSE 0 END)
     WHEN 3 THEN 'run-wide' WHEN 2 THEN 'partial' WHEN 1 THEN 'by-time' ELSE 'exact' END AS attribution
  FROM records GROUP BY run_id, test_id""")
def test_attribution(m: Model):
    return attempts.test_attributions(m.records)


@query("attribution_counts", """
  SELECT run_id, count(*) FILTER (attribution = 'exact') AS exact, count(*) FILTER (attribution = 'by-time') AS by_time,
    count(*) FILTER (attribution = 'partial') AS partial, count(*) FILTER (attribution = 'run-wide') AS run_wide
  FROM tests WHERE role = 'test' GROUP BY run_id""")
def attribution_counts(m: Model):
    return attempts.attribution_counts(m.tests)


@query("attribution_predicates", """
  SELECT run_id, attribution, attribution <> 'run-wide' AS own_coverage, attribution IN ('exact', 'by-time', '') AS complete_coverage,
    count(*) AS tests FROM tests GROUP BY ALL""")
def attribution_predicates(m: Model):
    a = F.col("attribution")
    return m.tests.groupBy("run_id", "attribution", attempts.coverage_is_its_own(a).alias("own_coverage"),
                           attempts.coverage_is_complete(a).alias("complete_coverage")).agg(F.count(F.lit(1)).alias("tests"))


# --- filters and selectors ----------------------------------------------------

@query("filter_kind_runner", "SELECT run_id, test_id FROM tests WHERE role = 'test' AND kind = 'e2e' AND runner = 'playwright'")
def filter_kind_runner(m: Model):
    chosen = selection.picked_tests(m.tests_, TestFilter(kind="e2e", runner="playwright"))
    return selection.require_rows(chosen, "kind e2e, runner playwright").select("run_id", "test_id")


FILTERED = """(list_contains(string_split(lower(replace(tags_csv, '@', '')), ','), 'api') OR list_contains(string_split(tags_csv, ','), 'smoke'))
   AND NOT lower(name) LIKE '%000000018%' AND (contains(lower(title), 'cart adds') OR contains(lower(name), 'cart adds'))
   AND (test_file LIKE 'tests/n1/%' OR test_file LIKE 'tests/n2/%' OR test_file = 'tests/n3/n4_test.ts')"""
CRITERIA = TestFilter(tags=["api", "@Smoke"], titles=["Cart Adds", "!000000018"], files=["./tests/n1", "tests/n2/", "tests/n3/n4_test.ts"])


@query("filter_tag_title_file", f"SELECT run_id, test_id, name, test_file FROM tests WHERE role = 'test' AND {FILTERED}")
def filter_tag_title_file(m: Model):
    return selection.picked_tests(m.tests_, CRITERIA).select("run_id", "test_id", "name", "test_file")


@query("filter_keeps_setup", f"""
  WITH k AS (SELECT * FROM tests WHERE role = 'test' AND kind = 'unit')
  SELECT run_id, test_id, role FROM k UNION ALL SELECT run_id, test_id, role FROM tests t WHERE role = 'setup'
    AND EXISTS (SELECT 1 FROM k WHERE k.run_id = t.run_id AND k.test_file = t.test_file)""")
def filter_keeps_setup(m: Model):
    return selection.with_setup(m.tests_, selection.picked_tests(m.tests_, TestFilter(kind="unit"))).select("run_id", "test_id", "role")


@query("setup_expansion", f"""
  WITH k AS (SELECT * FROM tests WHERE role = 'test' AND kind = 'unit')
  SELECT run_id, test_id, role FROM k UNION ALL SELECT run_id, test_id, role FROM tests t WHERE role = 'background'
    OR (role = 'setup' AND EXISTS (SELECT 1 FROM k WHERE k.run_id = t.run_id AND k.test_file = t.test_file))""")
def setup_expansion(m: Model):
    return selection.setup_expansion(m.tests_, selection.picked_tests(m.tests_, TestFilter(kind="unit"))).select("run_id", "test_id", "role")


@query("select_test", "SELECT run_id, test_id, FALSE AS exact FROM tests WHERE contains(lower(name), '#00000000')")
def select_test(m: Model):
    return selection.select_tests(m.tests_, "#00000000").select("run_id", "test_id", "exact")


@query("select_decision", """
  SELECT run_id, id, file, line, col FROM decisions WHERE id = 'd1'
    OR (file = 'src/promo/brand_1_0.ts' AND line = 3)""")
def select_decision(m: Model):
    by_id = selection.select_decisions(m.decisions_, "d1")
    by_place = selection.select_decisions(m.decisions_, "src/promo/brand_1_0.ts:3")
    return by_id.unionByName(by_place).select("run_id", "id", "file", "line", "col").distinct()


@query("select_source_file", """
  SELECT run_id, file, count(*) AS points FROM points WHERE file = 'src/promo/brand_12_0.ts' GROUP BY run_id, file""")
def select_source_file(m: Model):
    path = selection.select_source_file(m.sites, "promo/brand_12_0")
    return m.points.filter(F.col("file") == path).groupBy("run_id", "file").agg(F.count(F.lit(1)).alias("points"))


# --- coverage -----------------------------------------------------------------

@query("hits_on_manifest", """
  WITH h AS (SELECT run_id, hit_id, count(*) AS hits, count(DISTINCT test_id) AS tests FROM hits GROUP BY ALL)
  SELECT p.run_id, p.id, p.kind, h.hits IS NOT NULL AS covered, coalesce(h.tests, 0) AS tests
  FROM points p LEFT JOIN h ON h.run_id = p.run_id AND h.hit_id = p.id WHERE NOT p.declined""")
def hits_on_manifest(m: Model):
    reached = m.hits.select("run_id", "hit_id", "test_id").distinct().groupBy("run_id", F.col("hit_id").alias("id")).agg(F.count(F.lit(1)).alias("tests"))
    return m.points.filter("not declined").join(reached, ["run_id", "id"], "left").select(
        "run_id", "id", "kind", F.col("tests").isNotNull().alias("covered"), F.coalesce("tests", F.lit(0)).alias("tests"))


@query("hit_detail", """
  SELECT h.run_id, h.test_id, h.hit_id, coalesce(p.kind, 'unknown') AS kind, p.file, p.line, p.label, count(*) AS hits
  FROM hits h LEFT JOIN points p ON p.run_id = h.run_id AND p.id = h.hit_id GROUP BY ALL""")
def hit_detail(m: Model):
    from attestry.operators.detail import hit_details

    return hit_details(m.hits, m.points)


@query("declined_set", """
  SELECT run_id, id FROM points WHERE declined UNION SELECT run_id, id FROM decisions WHERE declined
  UNION SELECT run_id, id FROM alternatives WHERE declined UNION SELECT run_id, id FROM outcome_alternatives WHERE declined
  UNION SELECT run_id, branch_id FROM alternatives GROUP BY ALL HAVING bool_and(declined)
  UNION SELECT run_id, branch_id FROM outcome_alternatives GROUP BY ALL HAVING bool_and(declined)""")
def declined_set(m: Model):
    return coverage.declined_ids(m.points, m.branches_, m.decisions_)


@query("whole_file_unmeasured", """
  WITH w AS (SELECT DISTINCT run_id, file FROM limitations WHERE whole_file)
  SELECT run_id, file, count(*) AS points, count(*) FILTER (declined OR EXISTS (SELECT 1 FROM w WHERE w.run_id = p.run_id AND w.file = p.file)) AS declined
  FROM points p GROUP BY ALL""")
def whole_file_unmeasured(m: Model):
    marked = coverage.without_whole_files(m.points, m.limitations)
    return marked.groupBy("run_id", "file").agg(F.count(F.lit(1)).alias("points"), F.count_if("declined").alias("declined"))


@query("whole_file_limitations", """
  WITH w AS (SELECT DISTINCT run_id, file FROM limitations WHERE whole_file)
  SELECT run_id, id, file, whole_file OR coalesce(blocking, TRUE) AS blocking FROM limitations l
  WHERE whole_file OR NOT EXISTS (SELECT 1 FROM w WHERE w.run_id = l.run_id AND w.file = l.file)""")
def whole_file_limitations(m: Model):
    return coverage.limitations_after_whole_files(m.limitations).select("run_id", "id", "file", "blocking")


@query("blocking_limitations", "SELECT run_id, count(*) AS limitations, count(*) FILTER (coalesce(blocking, TRUE)) AS blocking FROM limitations GROUP BY run_id")
def blocking_limitations(m: Model):
    return m.limitations.groupBy("run_id").agg(F.count(F.lit(1)).alias("limitations"), F.count_if(F.coalesce("blocking", F.lit(True))).alias("blocking"))


@query("line_fold", """
  WITH r AS (SELECT DISTINCT p.run_id, p.file, p.line, h.test_id FROM points p JOIN hits h ON h.run_id = p.run_id AND h.hit_id = p.id WHERE NOT p.declined),
  g AS (SELECT r.run_id, r.file, r.line, count(*) AS tests, count(DISTINCT t.kind) AS kinds, count(DISTINCT t.runner) AS runners, min(t.kind) AS k
     FROM r JOIN tests t ON t.run_id = r.run_id AND t.test_id = r.test_id GROUP BY ALL),
  l AS (SELECT run_id, file, line, bool_or(NOT declined) AS measured FROM points GROUP BY ALL)
  SELECT l.run_id, l.file, l.line, l.measured, g.tests IS NOT NULL AS covered, coalesce(g.tests, 0) AS tests, coalesce(g.kinds, 0) AS kinds,
    coalesce(g.runners, 0) AS runners, CASE WHEN g.kinds = 1 THEN g.k END AS exclusive_kind
  FROM l LEFT JOIN g ON g.run_id = l.run_id AND g.file = l.file AND g.line = l.line""")
def line_fold(m: Model):
    return coverage.line_fold(m.points, m.hits, m.tests)


@query("core_summary", f"""{BASE}, {o_counts("run_id")}, {o_totals("run_id")}
  SELECT t.run_id, t.metric, {SUMMARY_ROW} FROM t_totals t LEFT JOIN c_counts c ON c.run_id = t.run_id AND c.metric = t.metric""")
def core_summary(m: Model):
    return coverage.summary(*evidence(m), ["run_id"])


@query("file_summary", f"""{BASE}, {o_counts("run_id", by_file=True)}, {o_totals("run_id, file")}
  SELECT t.run_id, t.file, t.metric, {SUMMARY_ROW} FROM t_totals t LEFT JOIN c_counts c ON c.run_id = t.run_id AND c.file = t.file AND c.metric = t.metric""")
def file_summary(m: Model):
    return coverage.summary(*evidence(m), ["run_id"], by_file=True)


@query("decision_counts", f"""{BASE}, {o_counts("run_id")}
  SELECT run_id, metric, CAST(covered AS BIGINT) AS covered FROM c_counts WHERE metric IN ('executed_decisions', 'covered_decisions')""")
def decision_counts(m: Model):
    # Counts of decisions ask for no sites and no hits.
    counts = coverage.covered_counts(None, None, m.decisions_, None, m.vectors_, ["run_id"], metrics=["executed_decisions", "covered_decisions"])
    return counts.select("run_id", "metric", "covered")


@query("outcome_branches", f"""{BASE}
  SELECT run_id, branch_id, id, label, declined FROM o_branches WHERE kind = 'decision'""")
def outcome_branches(m: Model):
    return coverage.with_outcome_branches(m.branches_, m.decisions_).filter("kind = 'decision'").select("run_id", "branch_id", "id", "label", "declined")


@query("decision_result", f"""{BASE}, {o_counts("run_id")}
  SELECT c.run_id, c.decision_id, c.width AS conditions, c.o AS outcomes_seen, c.vals AS condition_values_seen,
    coalesce(s.n, 0) AS covered_conditions, coalesce(s.n, 0) = c.width AS covered
  FROM c_dec c LEFT JOIN c_shown s ON s.run_id = c.run_id AND s.decision_id = c.decision_id""")
def decision_result(m: Model):
    return coverage.decision_results(m.decisions_, m.vectors_, ["run_id"]).drop("file", "line", "col")


O_LETTER = "CASE WHEN {x} IS NULL THEN '-' WHEN {x} THEN 'T' ELSE 'F' END"
O_KEY = (
    O_LETTER.format(x="a") + " || " + O_LETTER.format(x="b") + " || CASE WHEN width = 3 THEN " + O_LETTER.format(x="c")
    + " ELSE '' END || ':' || CASE WHEN outcome THEN 'T' ELSE 'F' END"
)


@query("vector_observations", f"""
  SELECT run_id, decision_id, {O_KEY} AS vector_key, min(seq) AS seq, count(*) AS sightings FROM vectors GROUP BY ALL""")
def vector_observations(m: Model):
    return mcdc.observations(m.vectors_, ["run_id"]).select("run_id", "decision_id", "vector_key", "seq", "sightings")


@query("mcdc_witnesses", f"""
  WITH d AS (SELECT run_id, decision_id, a, b, c, outcome, {O_KEY} AS k, min(seq) AS seq FROM vectors GROUP BY ALL),
  p AS (SELECT l.run_id, l.decision_id, CASE WHEN coalesce(l.a <> r.a, FALSE) THEN 0 WHEN coalesce(l.b <> r.b, FALSE) THEN 1 ELSE 2 END AS condition,
      l.seq AS first_seq, l.k AS first_vector, r.seq AS second_seq, r.k AS second_vector
    FROM d l JOIN d r ON l.run_id = r.run_id AND l.decision_id = r.decision_id AND l.outcome <> r.outcome AND (l.seq, l.k) < (r.seq, r.k)
    WHERE CAST(coalesce(l.a <> r.a, FALSE) AS INT) + CAST(coalesce(l.b <> r.b, FALSE) AS INT) + CAST(coalesce(l.c <> r.c, FALSE) AS INT) = 1)
  SELECT run_id, decision_id, condition, first_seq, first_vector, second_seq, second_vector FROM p
  QUALIFY row_number() OVER (PARTITION BY run_id, decision_id, condition ORDER BY first_seq, first_vector, second_seq, second_vector) = 1""")
def mcdc_witnesses(m: Model):
    return mcdc.witnesses(mcdc.observations(m.vectors_, ["run_id"]), ["run_id"])


@query("exact_fraction", """
  WITH e AS (SELECT run_id, declined FROM points UNION ALL SELECT run_id, declined FROM decisions
    UNION ALL SELECT run_id, bool_and(declined) FROM alternatives GROUP BY run_id, branch_id
    UNION ALL SELECT run_id, bool_and(declined) FROM outcome_alternatives GROUP BY run_id, branch_id)
  SELECT run_id, count(*) AS obligations, count(*) FILTER (NOT declined) AS measured,
    round(count(*) FILTER (NOT declined) * 100.0 / count(*), 6) AS exact_fraction_pct FROM e GROUP BY run_id""")
def exact_fraction(m: Model):
    return coverage.exact_fraction(m.points, m.branches_, m.decisions_).withColumn("exact_fraction_pct", F.round("exact_fraction_pct", 6))


@query("completeness", f"""{BASE}, {o_counts("run_id")}, {o_totals("run_id")},
  s AS (SELECT t.run_id, bool_and(coalesce(c.covered, 0) = t.total) AS w FROM t_totals t LEFT JOIN c_counts c ON c.run_id = t.run_id AND c.metric = t.metric
     WHERE t.metric NOT IN ('decision_outcomes', 'value_selections') GROUP BY t.run_id),
  b AS (SELECT run_id, bool_or(coalesce(blocking, TRUE)) AS b FROM limitations GROUP BY run_id)
  SELECT s.run_id, s.w AND NOT coalesce(b.b, FALSE) AS coverage_complete, coalesce(b.b, FALSE) AS completeness_blocked FROM s LEFT JOIN b ON b.run_id = s.run_id""")
def completeness(m: Model):
    return coverage.completeness(coverage.summary(*evidence(m), ["run_id"]), m.limitations)


# --- gaps ---------------------------------------------------------------------

G = ["lines", "statements", "functions", "branches", "conditions"]
O_WIDE = ", ".join(
    f"coalesce(sum(total - covered) FILTER (metric = '{n}'), 0) AS uncovered_{n}, coalesce(sum(total) FILTER (metric = '{n}'), 0) AS total_{n}" for n in G)
O_FILE_GAPS = f"""{BASE}, {o_counts("run_id", by_file=True)}, {o_totals("run_id, file")},
  g_long AS (SELECT t.run_id, t.file, t.metric, t.total, coalesce(c.covered, 0) AS covered FROM t_totals t
     LEFT JOIN c_counts c ON c.run_id = t.run_id AND c.file = t.file AND c.metric = t.metric),
  g_wide AS (SELECT run_id, file, {O_WIDE} FROM g_long GROUP BY run_id, file),
  g_lim AS (SELECT run_id, file, count(*) AS limitations, bit_or(CASE kind WHEN 'dynamic-code' THEN 1 WHEN 'semantic-safety' THEN 2 WHEN 'source-scope' THEN 4 ELSE 8 END) AS limitation_mask
     FROM limitations GROUP BY run_id, file),
  g_files AS (SELECT run_id, file FROM points UNION SELECT run_id, file FROM limitations),
  g_all AS (SELECT f.run_id, f.file, {', '.join(f"coalesce(uncovered_{n}, 0) AS uncovered_{n}, coalesce(total_{n}, 0) AS total_{n}" for n in G)},
     coalesce(limitations, 0) AS limitations, coalesce(limitation_mask, 0) AS limitation_mask
     FROM g_files f LEFT JOIN g_wide w ON w.run_id = f.run_id AND w.file = f.file LEFT JOIN g_lim l ON l.run_id = f.run_id AND l.file = f.file),
  g AS (SELECT *, uncovered_lines + 2 * uncovered_functions + 2 * uncovered_branches + 3 * uncovered_conditions + 3 * limitations AS score FROM g_all)"""


@query("file_gaps", f"{O_FILE_GAPS} SELECT * FROM g")
def file_gaps(m: Model):
    return gaps.file_gaps(*evidence(m), m.limitations)


@query("ranked_files", f"""{O_FILE_GAPS} SELECT run_id, file, score AS value, limitations FROM g
  WHERE uncovered_lines + uncovered_statements + uncovered_functions + uncovered_branches + uncovered_conditions + limitations > 0""")
def ranked_files(m: Model):
    return gaps.rank_files(gaps.file_gaps(*evidence(m), m.limitations), "all").select("run_id", "file", "value", "limitations")


@query("has_gap_branches", f"{O_FILE_GAPS} SELECT run_id, count(*) AS files FROM g WHERE uncovered_branches > 0 GROUP BY run_id")
def has_gap_branches(m: Model):
    return gaps.file_gaps(*evidence(m), m.limitations, metrics=["branches"]).filter(gaps.has_gap("branches")).groupBy("run_id").agg(F.count(F.lit(1)).alias("files"))


@query("gaps_page", f"""{O_FILE_GAPS} SELECT run_id, file, uncovered_lines AS value, limitations FROM g WHERE uncovered_lines > 0 OR limitations > 0
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY uncovered_lines DESC, limitations DESC, file) BETWEEN 11 AND 30""")
def gaps_page(m: Model):
    return gaps.page(gaps.rank_files(gaps.file_gaps(*evidence(m), m.limitations), "lines"), gaps.file_order(), 10, 20).select("run_id", "file", "value", "limitations")


@query("page_facts", f"""{O_FILE_GAPS} SELECT run_id, 10 AS "offset", 20 AS "limit", greatest(0, least(20, count(*) - 10)) AS returned, count(*) AS total,
  10 + greatest(0, least(20, count(*) - 10)) < count(*) AS has_more,
  CASE WHEN 10 + greatest(0, least(20, count(*) - 10)) < count(*) THEN 30 END AS next_offset
  FROM g WHERE uncovered_lines > 0 OR limitations > 0 GROUP BY run_id""")
def page_facts(m: Model):
    return gaps.page_facts(gaps.rank_files(gaps.file_gaps(*evidence(m), m.limitations), "lines"), 10, 20)


O_AREA = "array_to_string(list_slice(string_split(file, '/'), 1, least(2, len(string_split(file, '/')) - 1)), '/')"


@query("directory_areas", f"""{O_FILE_GAPS} SELECT run_id, {O_AREA} AS directory, metric, CAST(sum(covered) AS BIGINT) AS covered,
  CAST(sum(total) AS BIGINT) AS total, count(*) AS files FROM g_long WHERE metric IN ('lines', 'statements', 'functions', 'branches', 'conditions')
  GROUP BY ALL ORDER BY run_id, metric, total DESC, directory""")
def directory_areas(m: Model):
    rows = coverage.summary(*evidence(m), ["run_id"], by_file=True, metrics=list(gaps.WEIGHTS))
    return gaps.areas(rows, ["run_id"], 2).orderBy("run_id", "metric", F.desc("total"), "directory")


O_OWN = "own AS (SELECT * FROM tests t WHERE attribution <> 'run-wide' AND (role = 'test' OR (role = 'setup' AND EXISTS (SELECT 1 FROM tests x WHERE x.run_id = t.run_id AND x.kind = t.kind AND x.role = 'test'))))"


@query("areas_by_kind", f"""{BASE}, {O_OWN},
  reach AS (SELECT DISTINCT t.run_id, t.kind, p.file, p.line FROM own t JOIN hits h ON h.run_id = t.run_id AND h.test_id = t.test_id
     JOIN points p ON p.run_id = h.run_id AND p.id = h.hit_id WHERE NOT p.declined),
  lines AS (SELECT DISTINCT p.run_id, p.file, p.line, EXISTS (SELECT 1 FROM hits h JOIN points q ON q.run_id = h.run_id AND q.id = h.hit_id AND NOT q.declined
     WHERE q.run_id = p.run_id AND q.file = p.file AND q.line = p.line) AS covered FROM points p WHERE NOT declined),
  a AS (SELECT run_id, {O_AREA} AS directory, count(DISTINCT file) AS files, count(*) AS total, count(*) FILTER (covered) AS covered FROM lines GROUP BY ALL)
  SELECT run_id, directory, files, total, 'any' AS "group", covered FROM a
  UNION ALL SELECT a.run_id, a.directory, a.files, a.total, k.kind, k.n FROM a JOIN
    (SELECT run_id, {O_AREA} AS directory, kind, count(*) AS n FROM reach GROUP BY ALL) k USING (run_id, directory)
  UNION ALL SELECT a.run_id, a.directory, a.files, a.total, '(all tests)', k.n FROM a JOIN
    (SELECT run_id, {O_AREA} AS directory, count(DISTINCT (file, line)) AS n FROM reach GROUP BY ALL) k USING (run_id, directory)""")
def areas_by_kind(m: Model):
    return gaps.areas_by_kind(*evidence(m), m.tests, depth=2)


@query("decision_gaps", f"""{BASE}, {o_counts("run_id")},
  e AS (SELECT d.run_id, d.id AS decision_id, d.file, d.line, d.col, d.width, s.i AS condition FROM decisions d, (VALUES (0), (1), (2)) s(i) WHERE NOT d.declined AND s.i < d.width),
  u AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM c_pairs p WHERE p.run_id = e.run_id AND p.decision_id = e.decision_id AND p.condition = e.condition))
  SELECT run_id, decision_id, file, line, col, width AS conditions, count(*) AS missing, string_agg(CAST(condition AS VARCHAR), ',' ORDER BY condition) AS missing_conditions,
    EXISTS (SELECT 1 FROM vectors v WHERE v.run_id = u.run_id AND v.decision_id = u.decision_id) AS executed
  FROM u GROUP BY ALL""")
def decision_gaps(m: Model):
    return gaps.decision_gaps(m.decisions_, m.vectors_).orderBy("run_id", F.desc("missing"), "file", "line", "col")


O_STATES = f"""{BASE}, {o_counts("run_id")},
  st AS (SELECT p.run_id, CASE p.kind WHEN 'function' THEN 'functions' ELSE 'statements' END AS metric, p.id, p.file, p.line, c.hit_id IS NOT NULL AS covered
      FROM points p LEFT JOIN c_hits c ON c.run_id = p.run_id AND c.hit_id = p.id WHERE NOT p.declined
    UNION ALL SELECT b.run_id, 'branches', b.id, b.file, b.line, c.hit_id IS NOT NULL FROM o_branches b LEFT JOIN c_hits c ON c.run_id = b.run_id AND c.hit_id = b.id WHERE NOT b.declined),
  states AS (SELECT * FROM st UNION ALL SELECT run_id, 'lines', file || ':' || line, file, line, bool_or(covered) FROM st WHERE metric <> 'branches' GROUP BY run_id, file, line
    UNION ALL SELECT d.run_id, 'conditions', d.id || '#' || s.i, d.file, d.line, EXISTS (SELECT 1 FROM c_pairs p WHERE p.run_id = d.run_id AND p.decision_id = d.id AND p.condition = s.i)
      FROM decisions d, (VALUES (0), (1), (2)) s(i) WHERE NOT d.declined AND s.i < d.width)"""


@query("obligation_states", f"{O_STATES} SELECT run_id, metric, id, file, line, covered FROM states")
def obligation_states(m: Model):
    return gaps.obligation_states(*evidence(m))


@query("open_obligations", f"{O_STATES} SELECT run_id, metric, id, file, line FROM states WHERE NOT covered")
def open_obligations(m: Model):
    return gaps.obligation_states(*evidence(m)).filter(~F.col("covered")).drop("covered")


@query("gap_lines", f"""{O_STATES},
  l AS (SELECT run_id, file, line, count(*) AS limitations FROM limitations GROUP BY ALL),
  s AS (SELECT run_id, file, line, bool_or(covered AND metric <> 'conditions') AS ran,
     {', '.join(f"count(*) FILTER (metric = '{n}' AND NOT covered) AS {n}" for n in G)} FROM states GROUP BY ALL),
  j AS (SELECT coalesce(s.run_id, l.run_id) AS run_id, coalesce(s.file, l.file) AS file, coalesce(s.line, l.line) AS line, coalesce(ran, FALSE) AS ran,
     {', '.join(f"coalesce({n}, 0) AS {n}" for n in G)}, coalesce(limitations, 0) AS limitations
     FROM s FULL JOIN l ON s.run_id = l.run_id AND s.file = l.file AND s.line = l.line)
  SELECT run_id, file, line, {', '.join(G)}, limitations,
    CASE WHEN lines > 0 OR (NOT ran AND lines + statements + functions + branches > 0 AND conditions = 0) THEN 'missing'
         WHEN ran OR lines + statements + functions + branches + conditions > 0 THEN 'part' ELSE 'limited' END AS state
  FROM j WHERE lines + statements + functions + branches + conditions + limitations > 0""")
def gap_lines(m: Model):
    return gaps.gap_lines(gaps.obligation_states(*evidence(m)), m.limitations)


# --- dimensions ---------------------------------------------------------------

def o_dimension(dim: str, members: str) -> str:
    return f"""{BASE}, mem AS ({members}),
  d_hits AS (SELECT h.run_id, h.hit_id, mem.{dim} FROM o_hits h JOIN mem ON mem.run_id = h.run_id AND mem.test_id = h.test_id),
  d_vec AS (SELECT v.*, mem.{dim} FROM vectors v JOIN mem ON mem.run_id = v.run_id AND mem.test_id = v.test_id),
  {o_counts(f"run_id, {dim}", "d_hits", "d_vec")}, {o_totals("run_id")},
  grp AS (SELECT DISTINCT run_id, {dim} FROM tests)
  SELECT t.run_id, grp.{dim}, t.metric, {SUMMARY_ROW} FROM grp JOIN t_totals t ON t.run_id = grp.run_id
  LEFT JOIN c_counts c ON c.run_id = t.run_id AND c.metric = t.metric AND c.{dim} = grp.{dim}"""


@query("by_kind", o_dimension("kind", "SELECT * FROM tests WHERE attribution <> 'run-wide'"))
def by_kind(m: Model):
    return dimensions.by_dimension(*evidence(m), m.tests, "kind")


@query("by_runner", o_dimension("runner", "SELECT * FROM tests WHERE attribution <> 'run-wide'"))
def by_runner(m: Model):
    return dimensions.by_dimension(*evidence(m), m.tests, "runner")


@query("group_members", """
  SELECT run_id, kind, count(*) FILTER (role = 'test') AS tests, count(*) FILTER (role = 'setup') AS setups,
    count(*) FILTER (role = 'test' AND attribution <> 'run-wide') AS attributed FROM tests GROUP BY run_id, kind""")
def group_members(m: Model):
    return dimensions.group_members(m.tests, "kind")


@query("kind_runner_projections", f"""{BASE},
  mem AS (SELECT run_id, test_id, kind AS of_kind, '*' AS of_runner FROM tests UNION ALL SELECT run_id, test_id, '*', runner FROM tests UNION ALL SELECT run_id, test_id, kind, runner FROM tests),
  d_hits AS (SELECT h.run_id, h.hit_id, mem.of_kind, mem.of_runner FROM o_hits h JOIN mem ON mem.run_id = h.run_id AND mem.test_id = h.test_id),
  d_vec AS (SELECT v.*, mem.of_kind, mem.of_runner FROM vectors v JOIN mem ON mem.run_id = v.run_id AND mem.test_id = v.test_id),
  {o_counts("run_id, of_kind, of_runner", "d_hits", "d_vec")}, {o_totals("run_id")}
  SELECT g.run_id, g.of_kind, g.of_runner, t.metric, {SUMMARY_ROW} FROM (SELECT DISTINCT run_id, of_kind, of_runner FROM mem) g JOIN t_totals t ON t.run_id = g.run_id
  LEFT JOIN c_counts c ON c.run_id = g.run_id AND c.of_kind = g.of_kind AND c.of_runner = g.of_runner AND c.metric = t.metric""")
def kind_runner_projections(m: Model):
    return dimensions.by_projection(*evidence(m), m.tests)


@query("tests_together", f"""{BASE}, {O_OWN},
  d_hits AS (SELECT h.run_id, h.hit_id FROM o_hits h WHERE EXISTS (SELECT 1 FROM own WHERE own.run_id = h.run_id AND own.test_id = h.test_id)),
  d_vec AS (SELECT v.* FROM vectors v WHERE EXISTS (SELECT 1 FROM own WHERE own.run_id = v.run_id AND own.test_id = v.test_id)),
  {o_counts("run_id", "d_hits", "d_vec")}, {o_totals("run_id")}, {re.sub(r"\bc_", "w_", o_counts("run_id"))}
  SELECT t.run_id, t.metric, {SUMMARY_ROW}, CAST(coalesce(w.covered, 0) AS BIGINT) AS covered_by_run,
    CAST(coalesce(w.covered, 0) - coalesce(c.covered, 0) AS BIGINT) AS outside_tests
  FROM t_totals t LEFT JOIN c_counts c ON c.run_id = t.run_id AND c.metric = t.metric LEFT JOIN w_counts w ON w.run_id = t.run_id AND w.metric = t.metric""")
def tests_together(m: Model):
    return dimensions.tests_together(*evidence(m), m.tests)


O_GROUP_GAPS = f"""
  d_hits AS (SELECT h.run_id, h.hit_id, t.kind FROM o_hits h JOIN tests t ON t.run_id = h.run_id AND t.test_id = h.test_id),
  g_pts AS (SELECT p.run_id, p.file, p.line, p.id, p.kind AS pk FROM points p WHERE NOT declined),
  g_kind AS (SELECT DISTINCT run_id, kind FROM tests),
  g_state AS (SELECT k.run_id, k.kind, g.file, g.pk, g.id,
      EXISTS (SELECT 1 FROM d_hits d WHERE d.run_id = k.run_id AND d.kind = k.kind AND d.hit_id = g.id) AS mine,
      EXISTS (SELECT 1 FROM d_hits d WHERE d.run_id = k.run_id AND d.hit_id = g.id) AS anyone
    FROM g_kind k JOIN g_pts g ON g.run_id = k.run_id)"""


# Any test's counts beside a group's own: both are recomputed, of every metric.
O_GROUP_WHOLE = f"""{BASE},
  d_hits AS (SELECT h.run_id, h.hit_id, t.kind FROM o_hits h JOIN tests t ON t.run_id = h.run_id AND t.test_id = h.test_id),
  d_vec AS (SELECT v.*, t.kind FROM vectors v JOIN tests t ON t.run_id = v.run_id AND t.test_id = v.test_id),
  {o_counts("run_id, kind", "d_hits", "d_vec", by_file=True)}, {o_totals("run_id, file")}, {re.sub(r"\bc_", "w_", o_counts("run_id", "d_hits", "d_vec", by_file=True))},
  g_all AS (SELECT t.run_id, k.kind, t.file, t.metric, CAST(t.total AS BIGINT) AS total, CAST(coalesce(c.covered, 0) AS BIGINT) AS mine, CAST(coalesce(w.covered, 0) AS BIGINT) AS anyone
    FROM t_totals t JOIN (SELECT DISTINCT run_id, kind FROM tests) k ON k.run_id = t.run_id
    LEFT JOIN c_counts c ON c.run_id = t.run_id AND c.kind = k.kind AND c.file = t.file AND c.metric = t.metric
    LEFT JOIN w_counts w ON w.run_id = t.run_id AND w.file = t.file AND w.metric = t.metric
    WHERE t.metric IN ('lines', 'statements', 'functions', 'branches', 'conditions'))"""


@query("group_gaps", f"""{O_GROUP_WHOLE}
  SELECT run_id, kind, file, metric, total - mine AS uncovered, total, mine AS covered, anyone - mine AS covered_by_other_tests, total - anyone AS uncovered_everywhere FROM g_all""")
def group_gaps(m: Model):
    return gaps.group_gaps(*evidence(m), m.tests, "kind")


def point_gaps(m: Model):
    # Statements and functions are met by hits on points alone.
    return gaps.group_gaps(m.points, None, None, m.hits, None, m.tests, "kind", metrics=["statements", "functions"])


@query("e2e_context", f"""{BASE}, {O_GROUP_GAPS}
  SELECT run_id, pk || 's' AS metric, count(*) FILTER (NOT mine AND anyone) AS covered_elsewhere, count(*) FILTER (NOT anyone) AS covered_nowhere
  FROM g_state s WHERE kind = 'e2e' AND EXISTS (SELECT 1 FROM tests t WHERE t.run_id = s.run_id AND t.kind <> 'e2e') GROUP BY ALL""")
def e2e_context(m: Model):
    return dimensions.e2e_context(point_gaps(m))


@query("kind_sources", "SELECT run_id, kind_source, count(*) AS tests FROM tests WHERE role = 'test' GROUP BY ALL")
def kind_sources(m: Model):
    return dimensions.kind_sources(m.tests)


@query("test_files", """
  SELECT t.run_id, t.test_file, count(DISTINCT t.test_id) FILTER (role = 'test') AS tests, string_agg(DISTINCT t.runner, ',' ORDER BY t.runner) AS runners,
    string_agg(DISTINCT t.kind, ',' ORDER BY t.kind) AS kinds, count(DISTINCT (p.file, p.line)) FILTER (p.file IS NOT NULL) AS lines
  FROM tests t LEFT JOIN hits h ON h.run_id = t.run_id AND h.test_id = t.test_id LEFT JOIN points p ON p.run_id = h.run_id AND p.id = h.hit_id GROUP BY ALL""")
def test_files(m: Model):
    return dimensions.test_files(m.tests, m.points, m.hits)


@query("tests_without_evidence", """
  SELECT t.run_id, t.test_id, t.name, count(*) AS assertions FROM tests t JOIN records r ON r.run_id = t.run_id AND r.test_id = 'c' || substr(t.test_id, 2)
  WHERE t.role = 'test' AND t.attribution <> 'run-wide' AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.run_id = t.run_id AND h.test_id = t.test_id AND substr(h.hit_id, 1, 1) = 'x')
  GROUP BY ALL""")
def tests_without_evidence(m: Model):
    # The customers' records stand for phases; only hits the manifest lacks for evidence.
    phases = m.records.select("run_id", F.concat(F.lit("t"), F.substring("test_id", 2, 20)).alias("test_id"), F.lit("test").alias("kind"))
    hits = m.hits.filter("hit_id like 'x%'")
    none = m.vectors_.filter(F.lit(False))
    return dimensions.tests_without_evidence(m.tests, hits, none, phases).select("run_id", "test_id", "name", "assertions")
