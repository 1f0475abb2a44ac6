"""Runs, merges, scope and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import attempts, coverage, runs, scope, validate
from attestry.plans.catalog import query
from attestry.plans.coverage_queries import BASE, SUMMARY_ROW, evidence, o_counts, o_totals
from attestry.plans.model import Model

ONE, TWO, ALL = "run_A1996", "run_N1996", "run_all"


@query("run_catalogue", "SELECT run_id, started_ms FROM runs WHERE records % 5 <> 0 ORDER BY started_ms DESC, run_id DESC")
def run_catalogue(m: Model):
    read = m.runs.select("run_id", F.when(F.col("records") % 5 != 0, F.col("started_ms")).alias("started_at"), F.lit(None).cast("string").alias("corrupt"))
    return runs.catalogue(read)[0].select("run_id", F.col("started_at").alias("started_ms"))


@query("run_catalogue_rejected", "SELECT run_id, 'run metadata has no start' AS reason FROM runs WHERE records % 5 = 0")
def run_catalogue_rejected(m: Model):
    read = m.runs.select("run_id", F.when(F.col("records") % 5 != 0, F.col("started_ms")).alias("started_at"), F.lit(None).cast("string").alias("corrupt"))
    return runs.catalogue(read)[1].select("run_id", "reason")


@query("run_select", """
  SELECT 'latest' AS selector, run_id FROM (SELECT run_id FROM runs ORDER BY started_ms DESC, run_id DESC LIMIT 1)
  UNION ALL SELECT 'run_R1996', 'run_R1996' UNION ALL SELECT 'run_N', run_id FROM (SELECT run_id FROM runs WHERE run_id LIKE 'run_N%' ORDER BY started_ms DESC, run_id DESC LIMIT 1)""")
def run_select(m: Model):
    picked = [runs.select_run(m.runs, s).select(F.lit(s).alias("selector"), "run_id") for s in ("latest", "run_R1996", "run_N")]
    return picked[0].unionByName(picked[1]).unionByName(picked[2])


@query("run_list", f"""{BASE}, {o_counts("run_id")}, {o_totals("run_id")},
  s AS (SELECT t.run_id, t.metric, {SUMMARY_ROW} FROM t_totals t LEFT JOIN c_counts c ON c.run_id = t.run_id AND c.metric = t.metric)
  SELECT r.run_id, r.started_ms, max(s.pct) FILTER (metric = 'lines') AS lines_pct, max(s.pct) FILTER (metric = 'branches') AS branches_pct, max(s.pct) FILTER (metric = 'conditions') AS conditions_pct,
    (SELECT count(*) FROM tests t WHERE t.run_id = r.run_id AND role = 'test') AS tests FROM runs r LEFT JOIN s ON s.run_id = r.run_id GROUP BY ALL""")
def run_list(m: Model):
    return runs.newest_first(runs.run_list(m.runs.select("run_id", "started_ms"), coverage.summary(*evidence(m), ["run_id"]), m.tests))


O_FIRST = """
  p AS (SELECT *, row_number() OVER (ORDER BY run_id) AS position FROM runs), f AS (SELECT * FROM p WHERE position = 1)"""
O_DIMS = " , ".join(f"CASE WHEN f.{c} <> r.{c} THEN '{w}' END" for c, (w, _) in runs.DOMAINS.items())


@query("merge_conflicts", f"""WITH {O_FIRST},
  d AS (SELECT r.run_id, list_filter([{O_DIMS}], lambda x: x IS NOT NULL) AS ds, f.combined <> r.combined AND f.execution = r.execution AS whole FROM p r, f WHERE r.position > 1)
  SELECT run_id, CASE WHEN len(ds) = 0 THEN 'integrity fingerprint' ELSE array_to_string(ds, ', ') END AS conflicts FROM d WHERE len(ds) > 0 OR whole""")
def merge_conflicts(m: Model):
    ordered = m.runs.withColumn("position", F.ascii(F.substring("run_id", 5, 1)) * 10000 + F.substring("run_id", 6, 4).cast("int"))
    return runs.merge_conflicts(ordered)


@query("merge_manifest_difference", f"""
  WITH a AS (SELECT * EXCLUDE (run_id) FROM points WHERE run_id = '{ONE}'), b AS (SELECT * EXCLUDE (run_id) FROM points WHERE run_id = '{TWO}' AND id NOT LIKE '%77')
  SELECT *, 1 AS surplus FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, -1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def merge_manifest_difference(m: Model):
    return runs.manifest_difference(m.points.filter((F.col("run_id") == ONE) | ~F.col("id").like("%77")), ONE, TWO)


@query("merge_runs", f"""
  WITH r AS (SELECT * FROM records WHERE run_id IN ('{ONE}', '{TWO}')),
  a AS (SELECT test_id, retry, bool_or(status = 'failed') AS f, max(seq) FILTER (status <> 'unknown') IS NOT NULL AS known, count(*) AS records FROM r GROUP BY ALL)
  SELECT '{ALL}' AS run_id, test_id, retry, f AS failed, known, records FROM a""")
def merge_runs(m: Model):
    merged = runs.merge(m.records, [ONE, TWO], ALL)
    folded = attempts.fold_attempts(merged)
    return folded.select("run_id", "test_id", "retry", (F.col("status") == "failed").alias("failed"), (F.col("status") != "unknown").alias("known"), "records")


# --- whole runs ----------------------------------------------------------------
# A copy of one run whose decisions and limitations differ, and whose points and alternatives do not.
COPY = "run_copy"


def manifests(m: Model):
    """What decides whether runs share a denominator."""
    tables = {"points": m.points, "alternatives": m.alternatives, "decisions": m.decisions, "limitations": m.limitations}
    own = {name: rows.filter(F.col("run_id") == ONE).withColumn("run_id", F.lit(COPY)) for name, rows in tables.items()}
    own["decisions"] = own["decisions"].withColumn("declined", F.col("declined") != (F.col("width") == 2))
    own["limitations"] = own["limitations"].filter("not whole_file")
    return {name: rows.filter(F.col("run_id").isin(ONE, TWO)).unionByName(own[name]) for name, rows in tables.items()}


def o_domain(name: str, copied: str = "*", where: str = "TRUE") -> str:
    """Rows of the other two runs against the first's: (run_id, domain, id, surplus)."""
    one = f"SELECT * EXCLUDE (run_id) FROM {name} WHERE run_id = '{ONE}'"
    parts = []
    for run, rows in ((TWO, f"SELECT * EXCLUDE (run_id) FROM {name} WHERE run_id = '{TWO}'"), (COPY, f"SELECT {copied} FROM ({one}) WHERE {where}")):
        for sign, left, right in ((1, one, rows), (-1, rows, one)):
            parts.append(f"SELECT '{run}' AS run_id, '{name}' AS domain, id, {sign} AS surplus FROM (({left}) EXCEPT ALL ({right}))")
    return " UNION ALL ".join(parts)


O_DENOMINATORS = " UNION ALL ".join([
    o_domain("points"), o_domain("alternatives"), o_domain("decisions", "* REPLACE (declined <> (width = 2) AS declined)"), o_domain("limitations", where="NOT whole_file")])


@query("merge_denominator_conflicts", f"SELECT DISTINCT run_id, domain FROM ({O_DENOMINATORS})")
def merge_denominator_conflicts(m: Model):
    return runs.denominator_conflicts(manifests(m), [ONE, TWO, COPY])


@query("merge_denominator_difference", O_DENOMINATORS)
def merge_denominator_difference(m: Model):
    tables = manifests(m)
    return runs.denominator_difference(tables, runs.denominator_conflicts(tables, [ONE, TWO, COPY]), ONE)


O_LEFT_OUT = f"SELECT run_id, test_id FROM tests WHERE run_id = '{ONE}' AND kind = 'e2e'"


def left_out(m: Model):
    """Tests measured again elsewhere: one kind of the first run's."""
    return m.tests.filter((F.col("run_id") == ONE) & (F.col("kind") == "e2e")).select("run_id", "test_id")


@query("merge_hits", f"""
  WITH o AS ({O_LEFT_OUT}), k AS (SELECT *, CASE run_id WHEN '{ONE}' THEN 0 ELSE 1 END AS shard FROM hits WHERE run_id IN ('{ONE}', '{TWO}') AND (run_id, test_id) NOT IN (SELECT run_id, test_id FROM o))
  SELECT '{ALL}' AS run_id, test_id, hit_id, min(shard) AS shard, arg_min(seq, (shard, seq)) AS seq FROM k GROUP BY test_id, hit_id""")
def merge_hits(m: Model):
    return runs.merge_evidence({"hits": m.hits}, [ONE, TWO], ALL, left_out(m))["hits"]


@query("merge_vectors", f"""
  WITH o AS ({O_LEFT_OUT}), k AS (SELECT *, CASE run_id WHEN '{ONE}' THEN 0 ELSE 1 END AS shard FROM vectors WHERE run_id IN ('{ONE}', '{TWO}') AND (run_id, test_id) NOT IN (SELECT run_id, test_id FROM o))
  SELECT '{ALL}' AS run_id, test_id, decision_id, width, a, b, c, outcome, min(shard) AS shard, arg_min(seq, (shard, seq)) AS seq FROM k GROUP BY test_id, decision_id, width, a, b, c, outcome""")
def merge_vectors(m: Model):
    return runs.merge_evidence({"vectors": m.vectors}, [ONE, TWO], ALL, left_out(m))["vectors"]


# Two runs of the phases, the second with half of the first's ids; a record is a run's test.
@query("merge_phases", """
  WITH k AS (SELECT 0 AS shard, test_id, id, kind, seq FROM phases WHERE run_id = 'run_u3' UNION ALL
     SELECT 1, test_id, CASE WHEN seq % 2 = 0 THEN id ELSE id || 'b' END, kind, seq FROM phases WHERE run_id = 'run_u3' AND seq % 5 <> 0),
  r AS (SELECT DISTINCT k.test_id FROM k JOIN k f ON f.id = k.id AND f.shard = 0 WHERE k.shard = 1)
  SELECT 'run_all' AS run_id, shard, test_id, id, kind, seq, CASE WHEN shard = 1 AND test_id IN (SELECT test_id FROM r) THEN id || '~2' ELSE id END AS fresh_id FROM k""")
def merge_phases(m: Model):
    rows = m.phases.filter("run_id = 'run_u3'").select("run_id", "test_id", "id", "kind", "seq")
    again = rows.filter("seq % 5 <> 0").withColumn("run_id", F.lit("run_again")).withColumn("id", F.when(F.col("seq") % 2 == 0, F.col("id")).otherwise(F.concat("id", F.lit("b"))))
    merged = runs.merge_evidence({"phases": rows.unionByName(again)}, ["run_u3", "run_again"], ALL)["phases"]
    return merged.select("run_id", "shard", "test_id", "id", "kind", "seq", "fresh_id")


@query("merge_first_kind", f"""
  SELECT '{ALL}' AS run_id, test_id, coalesce(max(kind) FILTER (run_id = '{TWO}'), max(kind)) AS kind FROM tests WHERE run_id IN ('{ONE}', '{TWO}') GROUP BY test_id""")
def merge_first_kind(m: Model):
    return runs.first_kind(runs.merge(m.tests, [TWO, ONE], ALL))


@query("superseded_records", """
  WITH o AS (SELECT DISTINCT run_id, test_id FROM records WHERE attribution = 'run-wide'), g AS (SELECT DISTINCT run_id, test_id FROM records)
  SELECT run_id, test_id FROM o WHERE EXISTS (SELECT 1 FROM g WHERE g.test_id = o.test_id AND g.run_id <> o.run_id)""")
def superseded_records(m: Model):
    stale = m.records.filter("attribution = 'run-wide'").select("run_id", "test_id").distinct()
    return runs.superseded_records(stale, m.records)


@query("merge_without_superseded", f"""
  WITH r AS (SELECT * FROM records WHERE run_id IN ('{ONE}', '{TWO}')), o AS (SELECT DISTINCT run_id, test_id FROM r WHERE attribution = 'run-wide'),
  s AS (SELECT run_id, test_id FROM o WHERE EXISTS (SELECT 1 FROM r g WHERE g.test_id = o.test_id AND g.run_id <> o.run_id))
  SELECT '{ALL}' AS run_id, test_id, count(*) AS records FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.run_id = r.run_id AND s.test_id = r.test_id) GROUP BY test_id""")
def merge_without_superseded(m: Model):
    both = m.records.filter(F.col("run_id").isin(ONE, TWO))
    gone = runs.superseded_records(both.filter("attribution = 'run-wide'").select("run_id", "test_id").distinct(), both)
    return runs.merge(m.records, [ONE, TWO], ALL, gone).groupBy("run_id", "test_id").agg(F.count(F.lit(1)).alias("records"))


@query("declared_runners", """
  WITH d AS (SELECT DISTINCT runner, CASE WHEN runner = 'pytest' THEN kind_source ELSE 'x' END AS model FROM tests) SELECT runner, count(*) > 1 AS conflict FROM d GROUP BY runner""")
def declared_runners(m: Model):
    told = m.tests.select("run_id", "runner", F.when(F.col("runner") == "pytest", F.col("kind_source")).otherwise("x").alias("model"))
    return runs.declared_runners(told).select("runner", "conflict")


@query("across_merge", """
  WITH w AS (SELECT file, string_agg(DISTINCT kind, '; ' ORDER BY kind) AS y FROM limitations GROUP BY file) SELECT file, file || ' (' || y || ')' AS explanation FROM w""")
def across_merge(m: Model):
    return runs.across(m.limitations.select("file", F.col("kind").alias("why")))


O_NOW = "n AS (SELECT * FROM runs WHERE run_id LIKE 'run_N%')"
O_STALE = O_NOW + """,
  st AS (SELECT r.run_id, r.merged, r.supersedes, r.started_ms, r.dependencies, r.instrumenter, n.run_id AS now, list_filter([""" + " , ".join(
    f"CASE WHEN n.{c} <> r.{c} THEN '{w}' END" for c, (_, w) in runs.DOMAINS.items()) + """], lambda x: x IS NOT NULL) AS ds, n.execution <> r.execution AS env
    FROM runs r LEFT JOIN n ON substr(n.run_id, 6) = substr(r.run_id, 6)),
  sr AS (SELECT *, CASE WHEN len(ds) = 0 AND env THEN 'execution environment changed' ELSE array_to_string(ds, ', ') END AS reasons FROM st)"""


def checkouts(m: Model):
    year = F.substring("run_id", 6, 4)
    return m.runs.withColumn("checkout", year), m.runs.filter("run_id like 'run_N%'").withColumn("checkout", year)


@query("stale_reasons", f"WITH {O_STALE} SELECT run_id, reasons <> '' AS stale, reasons FROM sr")
def stale_reasons(m: Model):
    return runs.stale_reasons(*checkouts(m))


@query("choose_for_merge", f"""WITH {O_STALE}, l AS (SELECT * FROM sr WHERE reasons = '' AND NOT merged),
  k AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.supersedes = l.run_id AND x.dependencies = l.dependencies AND x.instrumenter = l.instrumenter AND x.started_ms >= l.started_ms))
  SELECT run_id, dependencies, instrumenter, started_ms, row_number() OVER (PARTITION BY dependencies, instrumenter ORDER BY started_ms DESC, run_id DESC) AS place FROM k""")
def choose_for_merge(m: Model):
    return runs.choose_for_merge(*checkouts(m))


@query("changed_file_currency", """
  WITH c AS (SELECT path, doc_id FROM paths) SELECT 'r' AS run_id, path AS file, CASE WHEN doc_id % 11 = 0 THEN 'outdated' WHEN doc_id % 7 = 0 THEN 'no matter' WHEN doc_id % 3 = 0 THEN 'outdated'
     WHEN doc_id % 5 = 0 AND doc_id % 4 <> 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'reached' ELSE 'across' END WHEN doc_id % 4 = 2 THEN 'across' WHEN doc_id % 13 = 0 THEN 'outdated' WHEN doc_id % 17 = 0 THEN 'across' ELSE 'outdated' END AS judgment,
    CASE WHEN doc_id % 11 = 0 THEN 'own test' WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'measured'
     WHEN doc_id % 5 = 0 AND doc_id % 4 <> 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'served' ELSE 'served no test' END WHEN doc_id % 4 = 2 THEN 'not loaded' WHEN doc_id % 13 = 0 THEN 'gone' WHEN doc_id % 17 = 0 THEN 'only added' ELSE 'changed' END AS why FROM c""")
def changed_file_currency(m: Model):
    d = F.col("doc_id")
    facts = m.paths.select(
        F.lit("r").alias("run_id"), F.col("path").alias("file"), (d % 13 == 0).alias("gone"), (d % 11 == 0).alias("own_test"), (d % 7 == 0).alias("known_test"),
        F.lit(None).cast("string").alias("runner"), F.lit(None).cast("boolean").alias("ran_runner"), F.lit(None).cast("boolean").alias("same_settings"),
        (d % 3 == 0).alias("measured"), (d % 5 == 0).alias("supported"), (d % 2 == 0).alias("served"),
        F.when(d % 4 == 1, True).when(d % 4 == 2, False).alias("loads"), F.lit(True).alias("placed"), (d % 17 == 0).alias("only_added"))
    return runs.judge_files(facts)


@query("timeline_pairing", """
  WITH rf AS (SELECT 'r' || (doc_id % 40) AS run_id, path, md5(text) AS sha256 FROM paths), sf AS (SELECT 's' || (doc_id % 40 + doc_id % 2) AS snapshot, path, CASE WHEN doc_id % 39 = 5 THEN 'x' ELSE md5(text) END AS sha256 FROM paths)
  SELECT run_id, snapshot, count(*) AS shared FROM rf JOIN sf USING (path) GROUP BY ALL HAVING bool_and(rf.sha256 = sf.sha256)""")
def timeline_pairing(m: Model):
    d = F.col("doc_id")
    digest = F.md5("text")
    left = m.paths.select(F.concat(F.lit("r"), (d % 40).cast("string")).alias("run_id"), "path", digest.alias("sha256"))
    right = m.paths.select(F.concat(F.lit("s"), (d % 40 + d % 2).cast("string")).alias("snapshot"), "path", F.when(d % 39 == 5, "x").otherwise(digest).alias("sha256"))
    return runs.pair_moments(left, right)


@query("timeline", """
  WITH s AS (SELECT snapshot, min(started_ms) AS taken_ms FROM (SELECT 's' || substr(run_id, 6) AS snapshot, started_ms FROM runs) GROUP BY snapshot),
  p AS (SELECT run_id, 's' || substr(run_id, 6) AS snapshot FROM runs WHERE run_id LIKE 'run_A%' AND records % 2 = 0)
  SELECT r.run_id, p.snapshot, r.started_ms AS at_ms FROM runs r LEFT JOIN p ON p.run_id = r.run_id UNION ALL SELECT NULL, snapshot, taken_ms FROM s WHERE snapshot NOT IN (SELECT snapshot FROM p)""")
def timeline(m: Model):
    name = F.concat(F.lit("s"), F.substring("run_id", 6, 4)).alias("snapshot")
    snapshots = m.runs.select(name, "started_ms").groupBy("snapshot").agg(F.min("started_ms").alias("taken_ms"))
    return runs.timeline(m.runs, snapshots, m.runs.filter("run_id like 'run_A%' and records % 2 = 0").select("run_id", name))


# --- scope and measurement -------------------------------------------------------

@query("scope_groups", "SELECT CASE status WHEN 'ambiguous' THEN 0 WHEN 'included' THEN 1 ELSE 2 END AS rank, status, regexp_replace(file, '/[^/]*$', '') AS directory, reason, count(*) AS files FROM scope_entries GROUP BY ALL")
def scope_groups(m: Model):
    return scope.groups(m.scope_entries)


@query("scope_entries_listed", "SELECT file, status, reason, CASE status WHEN 'ambiguous' THEN 0 WHEN 'included' THEN 1 ELSE 2 END AS rank FROM scope_entries")
def scope_entries_listed(m: Model):
    return scope.listed(m.scope_entries)


@query("unclassified_roots", "SELECT regexp_replace(file, '/[^/]*$', '') AS root, count(*) AS files FROM scope_entries WHERE status = 'ambiguous' GROUP BY ALL")
def unclassified_roots(m: Model):
    return scope.unclassified(m.scope_entries)


@query("scope_after_whole_files", """
  WITH w AS (SELECT path AS file FROM paths WHERE doc_id % 23 = 0), e AS (SELECT * FROM scope_entries WHERE status <> 'excluded')
  SELECT 'r' AS run_id, coalesce(e.file, w.file) AS file, CASE WHEN w.file IS NOT NULL THEN 'excluded' ELSE e.status END AS status, CASE WHEN w.file IS NOT NULL THEN 'too large' ELSE e.reason END AS reason
  FROM e FULL JOIN w ON w.file = e.file""")
def scope_after_whole_files(m: Model):
    entries = m.scope_entries.filter("status <> 'excluded'").select(F.lit("r").alias("run_id"), "file", "status", "reason")
    marks = m.paths.filter("doc_id % 23 = 0").select(F.lit("r").alias("run_id"), F.col("path").alias("file"), F.lit("too large").alias("reason"), F.lit(True).alias("whole_file"))
    return coverage.scope_after_whole_files(entries, marks)


@query("scope_classification", r"""
  WITH l AS (SELECT doc_id, strlen(unnest(string_split(text, chr(10)))) AS n, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM paths),
  o AS (SELECT doc_id, n, coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
  h AS (SELECT doc_id, coalesce(sum(least(n, greatest(65536 - before, 0))) FILTER (least(n, greatest(65536 - before, 0)) > 500), 0) AS long FROM o GROUP BY doc_id),
  f AS (SELECT doc_id, 'c' || (doc_id % 2) AS checkout, path, text, long, doc_id % 4 = 0 AS measured FROM paths JOIN h USING (doc_id)),
  ro AS (SELECT * FROM (VALUES ('c0', 'src/src1'), ('c0', 'src/src2/en'), ('c1', 'src/src2/'), ('c1', 'src/src')) t(checkout, root)),
  pa AS (SELECT * FROM (VALUES ('c0', 'src/src2'), ('c0', 'src/src2/en'), ('c1', 'src'), ('c1', 'src/src3')) t(checkout, package)),
  r AS (SELECT f.checkout, path AS file, CASE WHEN doc_id % 9 = 0 AND NOT measured THEN 'excluded|test' WHEN doc_id % 10 = 1 AND doc_id % 9 <> 0 THEN 'excluded|generated' WHEN doc_id % 8 = 3 AND NOT measured THEN 'excluded|example'
      WHEN path LIKE '%.js' AND strlen(text) > 2000 AND long * 2 > least(strlen(text), 65536) THEN 'excluded|minified code'
      WHEN measured OR EXISTS (SELECT 1 FROM ro WHERE ro.checkout = f.checkout AND starts_with(path, rtrim(root, '/') || '/')) THEN 'included|discovered package source root' ELSE 'ambiguous|unclassified first-party source' END AS r,
      (SELECT arg_max(package, len(string_split(package, '/'))) FROM pa WHERE pa.checkout = f.checkout AND starts_with(path, package || '/')) AS package_root FROM f)
  SELECT checkout, file, string_split(r, '|')[1] AS status, string_split(r, '|')[2] AS reason, package_root FROM r""")
def scope_classification(m: Model):
    d = F.col("doc_id")
    files = m.paths.select(
        F.concat(F.lit("c"), (d % 2).cast("string")).alias("checkout"), F.col("path").alias("file"), "text",
        F.when(d % 9 == 0, "test").when(d % 10 == 1, "generated").alias("skipped"), F.when(d % 8 == 3, "example").alias("beside"), (d % 4 == 0).alias("measured"))
    roots = m.spark.createDataFrame([("c0", "src/src1"), ("c0", "src/src2/en"), ("c1", "src/src2/"), ("c1", "src/src")], "checkout string, root string")
    packages = m.spark.createDataFrame([("c0", "src/src2"), ("c0", "src/src2/en"), ("c1", "src"), ("c1", "src/src3")], "checkout string, package string")
    return scope.classify(files, roots, packages, explicit=False)


@query("measurement_status", """
  WITH c AS (SELECT run_id, count(*) FILTER (hit_id LIKE 'x%') AS cr, count(DISTINCT test_id) FILTER (hit_id LIKE 'x%') AS cf FROM hits GROUP BY run_id),
  l AS (SELECT run_id, count(*) AS n, count(*) FILTER (coalesce(blocking, TRUE)) AS b, count(DISTINCT file) AS f, count(*) FILTER (kind = 'dynamic-code') AS k1, count(*) FILTER (kind = 'semantic-safety') AS k2, count(*) FILTER (kind = 'source-scope') AS k3 FROM limitations GROUP BY run_id)
  SELECT r.run_id, coalesce(n, 0) AS limitations, coalesce(b, 0) + coalesce(cr, 0) AS blocking, coalesce(n - b, 0) AS declared, coalesce(f, 0) + coalesce(cf, 0) AS files,
   coalesce(k1, 0) AS dynamic_code, coalesce(k2, 0) AS semantic_safety, coalesce(k3, 0) AS source_scope, coalesce(cr, 0) AS corrupt_records FROM runs r LEFT JOIN l USING (run_id) LEFT JOIN c USING (run_id)""")
def measurement_status(m: Model):
    torn = m.hits.filter("hit_id like 'x%'").groupBy("run_id").agg(F.count(F.lit(1)).alias("corrupt_records"), F.count_distinct("test_id").alias("corrupt_files"))
    return scope.measurement(m.limitations, torn, m.runs)


TRACE = ["process", "child-launch", "remote-launch", "workspace-capability", "guest-process"]


@query("transport_counts", "SELECT run_id, " + ", ".join(f"count(*) FILTER (event_id % 6 = {i}) AS {k.replace('-', '_')}" for i, k in enumerate(TRACE)) + " FROM event_times GROUP BY run_id")
def transport_counts(m: Model):
    kind = F.get(F.array(*[F.lit(k) for k in TRACE]), (F.col("event_id") % 6).cast("int"))
    return scope.transport_counts(m.event_times.select("run_id", kind.alias("kind")))


@query("transport_diagnostics", """
  WITH f AS (SELECT run_id, count(*) FILTER (event_type = 'view' AND value < 1) AS e, count(*) FILTER (event_type = 'click' AND value < 1) AS c, count(*) FILTER (event_type = 'signup') AS r, count(*) FILTER (event_type = 'error' AND value > 20) AS s FROM event_times GROUP BY run_id)
  SELECT run_id, 'TEST_EVIDENCE_MISSING' AS code, FALSE AS blocks FROM f WHERE e > 0 UNION ALL SELECT run_id, 'CORRUPT_EVIDENCE_RECORDS', TRUE FROM f WHERE c > 0
  UNION ALL SELECT run_id, 'REMOTE_SERVER_EVIDENCE_MISSING', TRUE FROM f WHERE r > 0 AND s = 0""")
def transport_diagnostics(m: Model):
    n = lambda kind, test, name: F.count_if((F.col("event_type") == kind) & test).alias(name)
    v = F.col("value")
    facts = m.event_times.groupBy("run_id").agg(
        n("view", v < 1, "empty_evidence_tests"), n("click", v < 1, "corrupt_records"), n("signup", F.lit(True), "remote_launches"), n("error", v > 20, "server_records"))
    return scope.diagnostics(facts)


# --- validation -------------------------------------------------------------------

@query("validate_runners", """
  WITH s AS (SELECT DISTINCT run_id, runner || role AS runner FROM tests WHERE kind <> 'e2e'), d AS (SELECT DISTINCT run_id, runner || role AS runner FROM tests WHERE kind = 'unit' OR role = 'background')
  SELECT run_id, 'undeclared runner' AS rule, runner AS key FROM s WHERE (run_id, runner) NOT IN (SELECT (run_id, runner) FROM d)
  UNION ALL SELECT run_id, 'unobserved runner', runner FROM d WHERE (run_id, runner) NOT IN (SELECT (run_id, runner) FROM s)""")
def validate_runners(m: Model):
    named = m.tests.withColumn("runner", F.concat("runner", "role"))
    return validate.runners(named.filter("kind <> 'e2e'"), named.filter("kind = 'unit' or role = 'background'"))


@query("validate_limitations", """
  WITH d AS (SELECT run_id, id FROM limitations WHERE kind <> 'macro' UNION ALL SELECT run_id, id FROM limitations WHERE whole_file UNION ALL SELECT run_id, 'zz' FROM runs)
  SELECT run_id, 'limitation not in manifest' AS rule, 'zz' AS key FROM runs UNION ALL SELECT run_id, 'limitation declared twice', id FROM d GROUP BY run_id, id HAVING count(*) > 1
  UNION ALL SELECT run_id, 'limitation not declared', id FROM limitations l WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.run_id = l.run_id AND d.id = l.id)""")
def validate_limitations(m: Model):
    told = m.limitations.filter("kind <> 'macro'").select("run_id", "id").unionByName(m.limitations.filter("whole_file").select("run_id", "id")).unionByName(
        m.runs.select("run_id", F.lit("zz").alias("id")))
    return validate.limitations(told, m.limitations)


O_SCOPED = """
  rec AS (SELECT run_id, seq AS record_id, CASE WHEN seq % 4 = 0 THEN 'pytest' ELSE 'vitest' END AS runner, CASE WHEN seq % 31 <> 0 THEN test_id END AS test_id, CASE WHEN seq % 29 <> 0 THEN retry END AS retry,
     CASE WHEN seq % 23 = 0 THEN 'unstarted' ELSE status END AS status, role, flaky, seq % 3 = 0 AS observed, CASE WHEN seq % 2 = 0 THEN CASE WHEN seq % 37 = 0 THEN 'other' ELSE run_id END END AS scope_run_id,
     CASE WHEN seq % 2 = 0 THEN CASE WHEN seq % 41 = 0 THEN '' ELSE 'w1' END END AS scope_worker_id, CASE WHEN seq % 2 = 0 THEN test_id END AS scope_test_id, CASE WHEN seq % 2 = 0 THEN CASE WHEN seq % 43 = 0 THEN retry + 1 ELSE retry END END AS scope_retry FROM records)"""


def scoped(m: Model):
    s = F.col("seq")
    has = s % 2 == 0
    return m.records.select(
        "run_id", s.alias("record_id"), F.when(s % 4 == 0, "pytest").otherwise("vitest").alias("runner"), F.when(s % 31 != 0, F.col("test_id")).alias("test_id"),
        F.when(s % 29 != 0, F.col("retry")).alias("retry"), F.when(s % 23 == 0, "unstarted").otherwise(F.col("status")).alias("status"), "role", "flaky", (s % 3 == 0).alias("observed"),
        F.when(has, F.when(s % 37 == 0, "other").otherwise(F.col("run_id"))).alias("scope_run_id"), F.when(has, F.when(s % 41 == 0, "").otherwise("w1")).alias("scope_worker_id"),
        F.when(has, F.col("test_id")).alias("scope_test_id"), F.when(has, F.when(s % 43 == 0, F.col("retry") + 1).otherwise(F.col("retry"))).alias("scope_retry"))


@query("validate_identities", f"""WITH {O_SCOPED}, x AS (SELECT * FROM rec WHERE runner = 'vitest' OR runner = 'pytest')
  SELECT run_id, 'no test identity' AS rule, CAST(record_id AS VARCHAR) AS key FROM x WHERE test_id IS NULL
  UNION ALL SELECT run_id, 'no worker identity', CAST(record_id AS VARCHAR) FROM x WHERE runner = 'vitest' AND CASE WHEN scope_run_id IS NOT NULL THEN scope_worker_id = '' ELSE observed END
  UNION ALL SELECT run_id, 'no retry identity', CAST(record_id AS VARCHAR) FROM x WHERE retry IS NULL AND (scope_run_id IS NOT NULL OR status <> 'unstarted')
  UNION ALL SELECT run_id, 'retry is not its scope''s', CAST(record_id AS VARCHAR) FROM x WHERE scope_retry <> retry""")
def validate_identities(m: Model):
    declared = m.runs.select("run_id", F.explode(F.array(F.lit("pytest"), F.lit("vitest"))).alias("runner")).select(
        "run_id", "runner", (F.col("runner") == "vitest").alias("exact_worker"), F.lit(True).alias("exact_test"), F.lit(True).alias("exact_retry"))
    return validate.identities(scoped(m), declared)


@query("validate_unstarted", f"""WITH {O_SCOPED} SELECT run_id, 'unstarted result with evidence' AS rule, CAST(record_id AS VARCHAR) AS key FROM rec
  WHERE status = 'unstarted' AND (role <> 'test' OR scope_run_id IS NOT NULL OR retry IS NOT NULL OR flaky OR observed)""")
def validate_unstarted(m: Model):
    return validate.unstarted(scoped(m))


@query("validate_scope_runs", f"WITH {O_SCOPED} SELECT run_id, 'scope of another run' AS rule, CAST(record_id AS VARCHAR) AS key FROM rec WHERE scope_run_id = 'other'")
def validate_scope_runs(m: Model):
    return validate.scope_runs(scoped(m))


O_VPHASES = """
  vp AS (SELECT run_id, test_id AS record_id, CASE WHEN seq % 50 = 0 THEN 'shared' ELSE id END AS id, CASE WHEN seq % 40 = 1 THEN 'warmup' ELSE kind END AS kind, seq,
     CASE WHEN seq % 3 = 0 THEN id WHEN seq % 3 = 1 THEN 'gone' || seq END AS cause FROM phases)"""


def vphases(m: Model):
    s = F.col("seq")
    return m.phases.select(
        "run_id", F.col("test_id").alias("record_id"), F.when(s % 50 == 0, "shared").otherwise(F.col("id")).alias("id"), F.when(s % 40 == 1, "warmup").otherwise(F.col("kind")).alias("kind"), "seq",
        F.when(s % 3 == 0, F.col("id")).when(s % 3 == 1, F.concat(F.lit("gone"), s.cast("string"))).alias("cause"))


@query("validate_phases", f"""WITH {O_VPHASES} SELECT run_id, 'phase kind' AS rule, id AS key FROM vp WHERE kind = 'warmup'
  UNION ALL SELECT run_id, 'phase id twice', id FROM vp GROUP BY run_id, id HAVING count(*) > 1""")
def validate_phases(m: Model):
    return validate.phases(vphases(m))


@query("validate_phase_references", f"""WITH {O_VPHASES} SELECT run_id, 'unknown phase' AS rule, cause AS key FROM vp v WHERE cause IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM vp x WHERE x.run_id = v.run_id AND x.record_id = v.record_id AND x.id = v.cause)""")
def validate_phase_references(m: Model):
    rows = vphases(m)
    return validate.phase_references(rows.select("run_id", "record_id", F.col("cause").alias("phase_id")), rows)


@query("validate_cyclic_causes", """
  WITH o AS (SELECT run_id, test_id AS record_id, id, row_number() OVER (PARTITION BY run_id, test_id ORDER BY started_at_ms, id) AS n, count(*) OVER (PARTITION BY run_id, test_id) AS size, min(id) OVER (PARTITION BY run_id, test_id) AS z FROM phases)
  SELECT run_id, 'cyclic cause' AS rule, id AS key FROM o WHERE length(record_id) % 2 = 1""")
def validate_cyclic_causes(m: Model):
    # Each test's phases cause one another in order; odd-named tests close the ring.
    from attestry.operators.ordered import previous

    chain = previous(m.phases, ["run_id", "test_id"], "started_at_ms", ["started_at_ms", "id"], ["id"])
    ends = m.phases.groupBy("run_id", "test_id").agg(F.max_by("id", F.struct("started_at_ms", "id")).alias("_last"))
    ring = chain.join(ends, ["run_id", "test_id"]).select(
        "run_id", F.col("test_id").alias("record_id"), "id", F.coalesce("prev_id", F.when(F.length("test_id") % 2 == 1, F.col("_last"))).alias("cause"))
    return validate.cyclic_causes(ring)


@query("validate_coverage_models", """
  WITH c AS (SELECT run_id, records, CASE records % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN ' python' WHEN 2 THEN 'go' ELSE 'rust' END AS language FROM runs)
  SELECT run_id, 'model schema version' AS rule, language AS key FROM c WHERE records % 5 = 0 UNION ALL SELECT run_id, 'model identifier', language FROM c WHERE records % 4 = 1
  UNION ALL SELECT run_id, 'model measures nothing', language FROM c WHERE records % 6 = 0 UNION ALL SELECT run_id, 'model surfaces', language FROM c WHERE records % 6 = 1
  UNION ALL SELECT run_id, 'model lists overlap', language FROM c WHERE records % 6 = 2 UNION ALL SELECT run_id, 'model language', language FROM c WHERE records % 4 = 2""")
def validate_coverage_models(m: Model):
    n = F.col("records")
    language = F.get(F.array(F.lit("typescript"), F.lit(" python"), F.lit("go"), F.lit("rust")), (n % 4).cast("int"))
    measured = F.when(n % 6 == 0, F.array().cast("array<string>")).when(n % 6 == 1, F.array(F.lit("lines"), F.lit("lines"))).otherwise(F.array(F.lit("lines"), F.lit("branches")))
    models = m.runs.select(
        "run_id", F.when(n % 5 == 0, 2).otherwise(1).alias("schema_version"), language.alias("language"), F.lit("v8").alias("variant"), F.lit("Lines").alias("name"), F.lit("All lines ran").alias("meaning"),
        measured.alias("measured"), F.when(n % 6 == 2, F.array(F.lit("branches"))).otherwise(F.array(F.lit("macros"))).alias("not_measured"),
        F.when(n % 4 == 2, "ruby").otherwise(language).alias("frontend_language"))
    return validate.coverage_models(models)


@query("validate_decisions", """
  WITH d AS (SELECT run_id, id, CASE WHEN line % 10 = 0 THEN 0 WHEN line % 10 = 1 THEN 2 ELSE width END AS w FROM decisions)
  SELECT run_id, 'decision without conditions' AS rule, id AS key FROM d WHERE w = 0
  UNION ALL SELECT DISTINCT d.run_id, 'vector of another width', d.id FROM d JOIN vectors v ON v.run_id = d.run_id AND v.decision_id = d.id WHERE v.width <> d.w""")
def validate_decisions(m: Model):
    bent = m.decisions_.withColumn("conditions", F.when(F.col("line") % 10 == 0, 0).when(F.col("line") % 10 == 1, 2).otherwise(F.col("conditions")))
    return validate.decisions(bent, m.vectors_)


@query("validate_results", "SELECT run_id, 'no results' AS rule, run_id AS key FROM runs WHERE run_id NOT IN (SELECT run_id FROM records WHERE run_id LIKE 'run_A%')")
def validate_results(m: Model):
    return validate.results(m.runs, m.records.filter("run_id like 'run_A%'"))
