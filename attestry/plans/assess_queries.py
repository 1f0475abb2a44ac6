"""Quality and security assessment, scans of source lines, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import numbers, paths, text
from attestry.functions.needles import CATALOGUE
from attestry.operators import assess, asserts, coverage, gaps, scan
from attestry.plans.catalog import query
from attestry.plans.model import Model

O_MERGED = """
  mg AS (SELECT snapshot, path, check_id, max(value) AS value, sum(bytes) AS bytes, count(*) AS windows FROM answers GROUP BY ALL),
  fi AS (SELECT * FROM mg WHERE value >= 0.6),
  he AS (SELECT snapshot, path, round((1 - avg(value)) * 10 * 100) / 100 AS health, max(bytes) AS bytes FROM mg GROUP BY ALL)"""


def merged(m: Model):
    return assess.merge_windows(m.answers)


@query("window_merge", f"WITH {O_MERGED} SELECT snapshot, path, check_id, value, CAST(bytes AS BIGINT) AS bytes, windows FROM mg")
def window_merge(m: Model):
    return merged(m)


@query("fired_checks", f"WITH {O_MERGED} SELECT snapshot, path, check_id, value FROM fi")
def fired_checks(m: Model):
    return assess.fired(merged(m)).select("snapshot", "path", "check_id", "value")


@query("fired_security_checks", """
  SELECT snapshot, path, check_id, line, value FROM line_answers WHERE value >= CASE WHEN check_id IN ('secret_in_source', 'unescaped_output') THEN 0.5 ELSE 0.6 END""")
def fired_security_checks(m: Model):
    return assess.fired(m.line_answers, assess.SECURITY_CUTS).select("snapshot", "path", "check_id", "line", "value")


@query("top_findings", f"""WITH {O_MERGED}
  SELECT snapshot, path, check_id, value, place, greatest(n - 3, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY snapshot, path ORDER BY value DESC, check_id) AS place,
    count(*) OVER (PARTITION BY snapshot, path) AS n FROM fi) WHERE place <= 3""")
def top_findings(m: Model):
    return assess.top_findings(assess.fired(merged(m)))


@query("file_health", f"WITH {O_MERGED} SELECT snapshot, path, health, CAST(bytes AS BIGINT) AS bytes FROM he")
def file_health(m: Model):
    return assess.health(merged(m))


@query("directory_health", f"""WITH {O_MERGED},
  d AS (SELECT *, array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') AS directory FROM he)
  SELECT snapshot, directory, round(sum(bytes * health) / sum(bytes) * 100) / 100 AS health, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files FROM d GROUP BY snapshot, directory
  UNION ALL SELECT snapshot, NULL, round(sum(bytes * health) / sum(bytes) * 100) / 100, CAST(sum(bytes) AS BIGINT), count(*) FROM d GROUP BY snapshot""")
def directory_health(m: Model):
    return assess.directory_health(assess.health(merged(m)))


@query("health_band", f"""WITH {O_MERGED}
  SELECT snapshot, CASE WHEN round(health, 1) >= 8 THEN 'good' WHEN round(health, 1) >= 5 THEN 'fair' ELSE 'weak' END AS band, count(*) AS files FROM he GROUP BY ALL""")
def health_band(m: Model):
    return assess.health(merged(m)).groupBy("snapshot", numbers.band(F.col("health")).alias("band")).agg(F.count(F.lit(1)).alias("files"))


@query("flagged_files", f"""WITH {O_MERGED},
  f AS (SELECT snapshot, path, count(*) AS n FROM fi GROUP BY ALL), x AS (SELECT DISTINCT snapshot, path FROM answers WHERE window_no >= 4)
  SELECT h.snapshot, h.path, coalesce(f.n, 0) AS findings, x.path IS NOT NULL AS failed FROM he h LEFT JOIN f USING (snapshot, path) LEFT JOIN x USING (snapshot, path)
  WHERE f.n > 0 OR x.path IS NOT NULL""")
def flagged_files(m: Model):
    told = assess.flagged_files(m.answers, assess.fired(merged(m)), m.answers.filter("window_no >= 4"))
    return told.filter("findings > 0 or failed")


O_THIN = """
  cl AS (SELECT snapshot, path, check_id, line, value FROM line_answers WHERE dismissed < 0.6 AND value >= CASE WHEN check_id IN ('secret_in_source', 'unescaped_output') THEN 0.5 ELSE 0.6 END),
  ar AS (SELECT snapshot, path, check_id, list({'m': -value, 'l': line} ORDER BY -value, line) AS ls FROM cl GROUP BY ALL),
  th AS (SELECT snapshot, path, check_id, unnest(list_reduce(list_prepend(list_value({'m': CAST(0 AS DOUBLE), 'l': CAST(-1000 AS INT)}), list_transform(ls, lambda x: list_value(x))),
     lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k.l - x[1].l) <= 10)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM ar),
  thin AS (SELECT snapshot, path, check_id, k.l AS line, -k.m AS value FROM th WHERE k.l >= 0)"""


@query("thinned_lines", f"WITH {O_THIN} SELECT * FROM thin")
def thinned_lines(m: Model):
    return assess.thin_lines(m.line_answers, assess.SECURITY_CUTS)


O_TIER = O_THIN + "," + O_MERGED + """,
  bl AS (SELECT snapshot, path, check_id, arg_min(value, line) AS lv, count(*) AS lines FROM thin GROUP BY ALL),
  ti AS (SELECT coalesce(f.snapshot, b.snapshot) AS snapshot, coalesce(f.path, b.path) AS path, coalesce(f.check_id, b.check_id) AS check_id, coalesce(f.value, b.lv) AS value,
     CASE WHEN b.lines IS NULL THEN 'file' ELSE 'line' END AS tier, coalesce(b.lines, 0) AS lines
     FROM (SELECT * FROM fi) f FULL JOIN bl b ON b.snapshot = f.snapshot AND b.path = f.path AND b.check_id = f.check_id)"""


def tiered(m: Model):
    return assess.with_line_tier(assess.fired(merged(m)), assess.thin_lines(m.line_answers, assess.SECURITY_CUTS))


@query("findings_tier", f"WITH {O_TIER} SELECT * FROM ti")
def findings_tier(m: Model):
    return tiered(m)


@query("finding_counts", f"""WITH {O_TIER} SELECT snapshot, count(DISTINCT path) AS flagged, count(DISTINCT path) FILTER (tier = 'line') AS line_confirmed, count(*) AS findings FROM ti GROUP BY snapshot""")
def finding_counts(m: Model):
    return assess.finding_counts(tiered(m))


@query("findings_per_check", f"WITH {O_TIER} SELECT snapshot, check_id, count(*) AS files FROM ti GROUP BY ALL")
def findings_per_check(m: Model):
    return assess.findings_per_check(tiered(m))


@query("change_review", f"""WITH {O_TIER}
  SELECT t.path, count(*) AS introduced, max(t.value) AS strongest, (SELECT min(line) FROM line_answers l WHERE l.path = t.path AND l.check_id = 'injection_sink') AS anchor
  FROM ti t WHERE snapshot = 'a' GROUP BY t.path""")
def change_review(m: Model):
    added = m.line_answers.filter("check_id = 'injection_sink'").select(F.col("path").alias("file"), "line")
    return assess.change_review(tiered(m).filter("snapshot = 'a'"), added)


def sides(m: Model):
    answers = merged(m)
    healths, found = assess.health(answers), assess.fired(answers)
    pick = lambda df, s: df.filter(F.col("snapshot") == s)
    return pick(healths, "a"), pick(healths, "b"), pick(found, "a"), pick(found, "b")


O_SDIFF = O_MERGED + """,
  ck AS (SELECT coalesce(o.path, n.path) AS path, coalesce(o.check_id, n.check_id) AS check_id, o.value AS "from", n.value AS "to",
     CASE WHEN o.value IS NULL THEN 'appeared' WHEN n.value IS NULL THEN 'no longer present' ELSE 'still present' END AS state
     FROM (SELECT * FROM fi WHERE snapshot = 'a') o FULL JOIN (SELECT * FROM fi WHERE snapshot = 'b') n ON n.path = o.path AND n.check_id = o.check_id),
  sd AS (SELECT coalesce(o.path, n.path) AS path, o.health AS "from", n.health AS "to", round((n.health - o.health) * 100) / 100 AS movement,
     (SELECT count(*) FROM ck WHERE ck.path = coalesce(o.path, n.path) AND state = 'appeared') AS appeared,
     (SELECT count(*) FROM ck WHERE ck.path = coalesce(o.path, n.path) AND state = 'no longer present') AS gone
     FROM (SELECT * FROM he WHERE snapshot = 'a') o FULL JOIN (SELECT * FROM he WHERE snapshot = 'b') n ON n.path = o.path),
  sc AS (SELECT *, CASE WHEN "from" IS NULL THEN 'added' WHEN "to" IS NULL THEN 'removed' WHEN "to" < "from" THEN 'declined' WHEN "to" > "from" THEN 'improved'
     WHEN appeared > 0 THEN 'declined' WHEN gone > 0 THEN 'improved' ELSE 'unchanged' END AS change FROM sd)"""


@query("snapshot_diff", f"WITH {O_SDIFF} SELECT * FROM sc")
def snapshot_diff(m: Model):
    return assess.snapshot_diff(*sides(m))


@query("snapshot_check_states", f"WITH {O_SDIFF} SELECT * FROM ck")
def snapshot_check_states(m: Model):
    return assess.check_states(*sides(m)[2:])


@query("decline_gate", f"WITH {O_SDIFF} SELECT * FROM sc WHERE change = 'declined'")
def decline_gate(m: Model):
    return assess.decline_gate(assess.snapshot_diff(*sides(m)))


@query("shared_health", f"""WITH {O_MERGED}, b AS (SELECT path FROM he GROUP BY path HAVING count(*) = 2)
  SELECT snapshot, round(sum(bytes * health) / sum(bytes) * 100) / 100 AS health, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files FROM he JOIN b USING (path) GROUP BY snapshot""")
def shared_health(m: Model):
    before, after, _, _ = sides(m)
    return assess.shared_health(before, after)


@query("finding_coverage", """
  WITH fl AS (SELECT run_id AS snapshot, file AS path, count(*) AS findings FROM limitations GROUP BY ALL),
  ml AS (SELECT p.file, p.line, bool_or(h.hit_id IS NOT NULL) AS covered FROM points p LEFT JOIN (SELECT DISTINCT run_id, hit_id FROM hits) h
     ON h.run_id = p.run_id AND h.hit_id = p.id WHERE NOT p.declined AND p.run_id = 'run_A1996' GROUP BY ALL),
  me AS (SELECT file, count(*) AS n, count(*) FILTER (NOT covered) AS u FROM ml GROUP BY file),
  a AS (SELECT DISTINCT p.file FROM points p JOIN (SELECT run_id, id FROM statement_answers WHERE asked GROUP BY ALL HAVING bool_or(p >= 0.5)) s ON s.run_id = p.run_id AND s.id = p.id)
  SELECT fl.snapshot, fl.path, fl.findings, me.n IS NOT NULL AS in_run, coalesce(me.n, 0) AS measured_lines, coalesce(me.u, 0) AS uncovered_lines,
    fl.findings > 0 AND coalesce(me.u, 0) > 0 AS flagged_and_untested, fl.findings > 0 AND coalesce(me.n, 0) > coalesce(me.u, 0) AND a.file IS NULL AS flagged_and_unasserted
  FROM fl LEFT JOIN me ON me.file = fl.path LEFT JOIN a ON a.file = fl.path""")
def finding_coverage(m: Model):
    flagged = m.limitations.groupBy(F.col("run_id").alias("snapshot"), F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("findings"))
    one = F.col("run_id") == "run_A1996"
    lines = coverage.line_fold(m.points.filter(one), m.hits.filter(one), m.tests)
    asserted = m.points.join(asserts.verdicts(m.statement_answers).filter("asserted").select("run_id", "id"), ["run_id", "id"]).select("file", "line")
    return assess.cross_with_coverage(flagged, lines, asserted)


# --- paths between functions --------------------------------------------------

def functions_of(m: Model):
    return m.functions.withColumnsRenamed({"start_line": "start", "end_line": "end"})


O_IMPORT_PATHS = """
  ip AS (SELECT DISTINCT c.file AS caller_file, c.name AS caller_name, k.file AS callee_file, k.name AS callee_name, k.start_line AS callee_start, k.sink_kind
   FROM imports i JOIN functions c ON c.file = i.file JOIN functions k ON k.file = i.target
   WHERE c.takes_outside >= 0.6 AND k.reaches_sink >= 0.6 AND k.sanitises < 0.6 AND k.sink_kind <> 'none'
     AND CASE i.exported WHEN '*' THEN TRUE WHEN 'default' THEN k.name = coalesce(i.target_default, i.local) ELSE k.name = i.exported END
     AND (contains(c.body, i.local || '.' || k.name || '(') OR contains(c.body, i.local || '(')))"""


@query("import_paths", f"WITH {O_IMPORT_PATHS} SELECT * FROM ip")
def import_paths(m: Model):
    return assess.import_paths(functions_of(m), m.imports)


O_RAN = O_IMPORT_PATHS + """,
  rn AS (SELECT DISTINCT f.*, e.test_id FROM functions f JOIN executions e ON e.file = f.file AND e.line BETWEEN f.start_line AND f.end_line)"""


@query("run_paths", f"""WITH {O_RAN},
  pr AS (SELECT c.file AS caller_file, c.name AS caller_name, k.file AS callee_file, k.name AS callee_name, k.sink_kind, c.start_line AS cs, min(k.test_id) AS test_id
    FROM rn k JOIN rn c ON c.test_id = k.test_id AND c.file <> k.file WHERE c.takes_outside >= 0.6 AND k.reaches_sink >= 0.6 AND k.sanitises < 0.6 AND k.sink_kind <> 'none' GROUP BY ALL),
  nk AS (SELECT * FROM pr WHERE NOT EXISTS (SELECT 1 FROM ip WHERE ip.caller_file = pr.caller_file AND ip.caller_name = pr.caller_name AND ip.callee_file = pr.callee_file AND ip.callee_name = pr.callee_name))
  SELECT caller_file, caller_name, callee_file, callee_name, sink_kind, test_id,
    row_number() OVER (PARTITION BY callee_file, callee_name ORDER BY test_id, caller_file, cs, caller_name) <= 3 AS asked FROM nk""")
def run_paths(m: Model):
    functions = functions_of(m)
    return assess.run_paths(functions, m.executions, assess.import_paths(functions, m.imports))


@query("guard_evidence", f"""WITH {O_RAN},
  gd AS (SELECT test_id, min({{'f': file, 's': start_line, 'n': name}}) AS g FROM rn WHERE sanitises >= 0.6 GROUP BY test_id),
  en AS (SELECT DISTINCT r.file, r.name, r.start_line AS "start", r.test_id, CASE WHEN g IS NOT NULL THEN g.f || ':' || g.s || ' ' || g.n END AS guard FROM rn r LEFT JOIN gd ON gd.test_id = r.test_id WHERE r.takes_outside >= 0.6)
  SELECT file, name, "start", count(guard) AS tests_with_a_guard, count(*) FILTER (guard IS NULL) AS tests_without, arg_min(guard, test_id) FILTER (guard IS NOT NULL) AS guard_example,
    array_to_string((list(test_id ORDER BY test_id) FILTER (guard IS NULL))[1:3], ',') AS unguarded_tests FROM en GROUP BY ALL""")
def guard_evidence(m: Model):
    return assess.guard_evidence(functions_of(m), m.executions)


# --- scans --------------------------------------------------------------------

# Needles the shared prose holds, as a project's own catalogue would add them.
PROSE = {"prose_article": ["The ", "the "], "prose_mark": ["!", "?", "@"], "prose_word": ["password", "License", "ung"]}
O_SOURCE = r"""
  dl AS (SELECT path, doc_id, unnest(regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n')) AS text, generate_subscripts(regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n'), 1) AS line FROM paths),
  sl AS (SELECT * FROM dl WHERE regexp_matches(text, '\S') AND NOT regexp_matches(text, '^\s*(#|//|\*|/\*)'))"""


@query("source_lines", f"WITH {O_SOURCE} SELECT path, line, md5(text) AS digest FROM sl")
def source_lines(m: Model):
    return scan.source_lines(m.paths.select("path", "text")).select("path", "line", F.md5("text").alias("digest"))


def _needle_sql(parts: list[str]) -> str:
    quoted = [part.replace("'", "''") for part in parts]
    return " OR ".join(f"contains(text, '{part}')" for part in quoted)


O_CANDIDATES = O_SOURCE + ", ca AS (" + " UNION ALL ".join(
    f"SELECT path, line, text, '{check}' AS \"check\" FROM sl WHERE {_needle_sql(parts)}" for check, parts in {**CATALOGUE, **PROSE}.items()
) + r""" UNION ALL SELECT path, line, text, 'secret_in_source' FROM sl WHERE regexp_matches(lower(text), '^[^=:]*(secret|password|passwd|api_key|apikey|token|private_key|privatekey|client_secret|auth)[^=:]*[=:]')
    AND regexp_matches(lower(text), '^[^=:]*[=:]\s*[''"`][^''"`]{6,}[''"`]'))"""


def candidates(m: Model):
    return scan.candidate_lines(m.paths.select("path", "text"), {**CATALOGUE, **PROSE})


@query("candidate_lines", f'WITH {O_CANDIDATES} SELECT path, line, "check", count(*) AS n FROM ca GROUP BY ALL')
def candidate_lines(m: Model):
    return candidates(m).groupBy("path", "line", "check").agg(F.count(F.lit(1)).alias("n"))


@query("candidates_round_robin", f"""WITH {O_CANDIDATES},
  t AS (SELECT path, line, "check", row_number() OVER (PARTITION BY path, "check" ORDER BY line) AS r FROM ca)
  SELECT path, line, "check" FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY r, "check") AS k FROM t) WHERE k <= 120""")
def candidates_round_robin(m: Model):
    return scan.round_robin(candidates(m), 120).select("path", "line", "check")


@query("nodes_spread", f"""WITH {O_SOURCE},
  n AS (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY line) - 1 AS i, count(*) OVER (PARTITION BY path) AS size FROM sl)
  SELECT path, line FROM n WHERE size <= 300 OR i IN (SELECT CAST(floor(k * (size / 300.0::DOUBLE)) AS BIGINT) FROM range(300) r(k))""")
def nodes_spread(m: Model):
    return scan.spread(scan.source_lines(m.paths.select("path", "text")), 300).select("path", "line")


@query("template_lines", r"""
  WITH tl AS (SELECT page_id, unnest(regexp_split_to_array(regexp_replace(html, '\r?\n$', ''), '\r?\n')) AS text, generate_subscripts(regexp_split_to_array(regexp_replace(html, '\r?\n$', ''), '\r?\n'), 1) AS line FROM pages)
  SELECT concat('views/p', page_id, '.html') AS path, line FROM tl WHERE trim(text) <> '' AND NOT regexp_matches(trim(text), '^(#|//|<!--)')
   AND regexp_matches(text, '\{\{|\{%|<%|v-html|innerHTML|\| safe|\|safe|autoescape|<script|href=|href =|src=|src =|on')""")
def template_lines(m: Model):
    files = m.pages.select(F.format_string("views/p%d.html", "page_id").alias("path"), F.col("html").alias("text"))
    return scan.template_nodes(files).select("path", "line")


@query("config_lines", f"""WITH {O_SOURCE}
  SELECT path, line FROM dl WHERE trim(text) <> '' AND NOT regexp_matches(trim(text), '^(#|//)')
    AND ((path LIKE '%.yaml' AND regexp_matches(text, '[:=]')) OR (path LIKE '%.html' AND trim(text) NOT LIKE '<!--%'
      AND regexp_matches(text, '\\{{\\{{|\\{{%|<%|v-html|innerHTML|\\| safe|\\|safe|autoescape|<script|href=|href =|src=|src =|on')))""")
def config_lines(m: Model):
    return scan.template_nodes(m.paths.select("path", "text")).select("path", "line")


@query("import_resolution", """
  WITH x AS (SELECT a.path AS file, a.path LIKE '%.py' AS python, b.source || '/' || b.lang || '/d' || b.doc_id AS there, b.path AS target
    FROM paths a JOIN paths b ON b.doc_id = a.doc_id + 1)
  SELECT file, '../../' || replace(there, '/d', '/./d') AS specifier, target FROM x WHERE NOT python AND target LIKE '%.js'
  UNION ALL SELECT file, '../a/b/c/d/e/f/g/h/i/../../../../../../../../../../' || there AS specifier, target FROM x WHERE NOT python AND target LIKE '%.js'
  UNION ALL SELECT file, 'src.' || replace(there, '/', '.') AS specifier, target FROM x WHERE python AND target LIKE '%.py'
  UNION ALL SELECT file, '...' || replace(there, '/', '.') || '.name' AS specifier, target FROM x WHERE python AND target LIKE '%.py'""")
def import_resolution(m: Model):
    after = m.paths.select((F.col("doc_id") - 1).alias("doc_id"), F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("there"))
    imports = m.paths.select("doc_id", F.col("path").alias("file")).join(after, "doc_id")
    dotted, own = F.replace("there", F.lit("/"), F.lit(".")), F.replace(F.regexp_replace("file", "[.]py$", ""), F.lit("/"), F.lit("."))
    scripts = F.array(F.concat(F.lit("../../"), F.replace("there", F.lit("/d"), F.lit("/./d"))), F.concat(F.lit("../a/b/c/d/e/f/g/h/i/../../../../../../../../../../"), "there"))
    # The last names the importing file itself, which is no import.
    modules = F.array(F.concat(F.lit("src."), dotted), F.concat(F.lit("..."), dotted, F.lit(".name")), own)
    named = imports.select("file", F.explode(F.when(F.col("file").endswith(".py"), modules).otherwise(scripts)).alias("specifier"))
    return scan.resolve_imports(named, m.paths)


@query("third_party_files", r"""
  WITH v AS (SELECT doc_id, text, 'app/' || CASE WHEN doc_id % 2 = 0 THEN 'vendor' ELSE 'src' END || '/' || CASE WHEN doc_id % 3 = 0 THEN 'jquery.' ELSE 'mod' END || doc_id || '.js' AS path FROM documents),
  l AS (SELECT doc_id, strlen(unnest(string_split(text, chr(10)))) AS n, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM v),
  o AS (SELECT doc_id, n, coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
  h AS (SELECT doc_id, least(n, greatest(65536 - before, 0)) AS n FROM o),
  s AS (SELECT doc_id, sum(n) FILTER (n > 500) AS long FROM h GROUP BY doc_id)
  SELECT path, CASE WHEN strlen(text) > 2000 AND coalesce(long, 0) * 2 > least(strlen(text), 65536) THEN 'minified code'
    WHEN doc_id % 2 = 0 AND (doc_id % 3 = 0 OR regexp_matches(substr(text, 1, 2048), '/\*!|@license|Licensed under the MIT|Licensed under MIT|Licensed under the Apache')) THEN 'vendored third-party library' END AS reason
  FROM v JOIN s USING (doc_id)""")
def third_party_files(m: Model):
    folder = F.when(F.col("doc_id") % 2 == 0, "vendor").otherwise("src")
    name = F.when(F.col("doc_id") % 3 == 0, "jquery.").otherwise("mod")
    path = F.concat(F.lit("app/"), folder, F.lit("/"), name, F.col("doc_id").cast("string"), F.lit(".js"))
    return m.documents.select(path.alias("path"), text.third_party(path, F.col("text")).alias("reason"))


@query("security_extra_files", r"""
  WITH p AS (SELECT path, unnest([path, replace(path, '/d', '/app-config.'), 'config/d' || path || '.json', path || '.json', path || '.min.js', path || '.lock']) AS file FROM paths)
  SELECT file, CASE WHEN regexp_matches(file, '\.(lock|min\.js)$') THEN FALSE WHEN file LIKE '%.json' THEN file LIKE 'config/%'
    ELSE regexp_matches(file, '\.(html|yaml)$') END AS read FROM p""")
def security_extra_files(m: Model):
    p = F.col("path")
    forms = F.array(p, F.regexp_replace(p, "/d", "/app-config."), F.concat(F.lit("config/d"), p, F.lit(".json")), F.concat(p, F.lit(".json")),
                    F.concat(p, F.lit(".min.js")), F.concat(p, F.lit(".lock")))
    return m.paths.select(F.explode(forms).alias("file")).select("file", text.security_extra(F.col("file")).alias("read"))


# --- scalar functions -----------------------------------------------------------

@query("name_words", r"""
  WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN
     ('test','tests','the','and','for','with','get','set','self','from','not','does','should'))) AS ws FROM documents)
  SELECT doc_id, len(ws) AS words, array_to_string(list_sort(ws), ' ') AS all_words FROM w""")
def name_words(m: Model):
    found = text.name_words(F.col("text"))
    return m.documents.select("doc_id", found.alias("w")).select("doc_id", F.size("w").alias("words"), F.array_join(F.array_sort("w"), " ").alias("all_words"))


@query("secret_literals", r"""
  WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(text, '\s+'))) AS w FROM documents)
  SELECT doc_id, w AS literal FROM t WHERE strlen(w) >= 8 AND (regexp_matches(w, '^(sk_|sk-|pk_|rk_|AKIA|ghp_|xoxa-|xoxb-|xoxp-|eyJ)')
    OR (strlen(w) >= 20 AND regexp_matches(w, '^[0-9a-fA-F]+$')) OR contains(lower(w), 'password') OR contains(lower(w), 'secret') OR contains(lower(w), 'passwd')
    OR (strlen(w) >= 24 AND regexp_matches(w, '^[A-Za-z0-9+/_-]*=*$') AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]')))""")
def secret_literals(m: Model):
    literals = m.documents.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("literal"))
    return literals.filter(text.secretish(F.col("literal")))


@query("estimated_tokens", r"""
  WITH d AS (SELECT doc_id, text, coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{64,}'), lambda r: strlen(r))), 0) AS dense FROM documents)
  SELECT doc_id, CAST(ceil((strlen(text) - dense) / 3.0) + dense AS BIGINT) AS tokens FROM d""")
def estimated_tokens(m: Model):
    return m.documents.select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


@query("stable_ids", "SELECT doc_id, substr(sha256(source || chr(0) || lang || chr(0) || CAST(doc_id AS VARCHAR) || chr(0)), 1, 24) AS id FROM documents")
def stable_ids(m: Model):
    return m.documents.select("doc_id", text.stable_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id"))


@query("xml_escape", r"""SELECT page_id, md5(replace(replace(replace(replace(replace(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS digest FROM pages""")
def xml_escape(m: Model):
    return m.pages.select("page_id", F.md5(text.xml_escape(F.col("html"))).alias("digest"))


@query("percentage", "SELECT o_orderkey, CASE WHEN t = 0 THEN 100.0 ELSE round(c / t * 10000) / 100 END AS pct FROM (SELECT o_orderkey, CAST(o_custkey % 50 AS DOUBLE) AS t, CAST(o_custkey % 50 AS DOUBLE) * (o_orderkey % 7) / 7 AS c FROM orders)")
def percentage(m: Model):
    whole = (F.col("o_custkey") % 50).cast("double")
    return m.orders.select("o_orderkey", numbers.percentage(whole * (F.col("o_orderkey") % 7) / 7, whole).alias("pct"))


@query("parse_percentage", r"""
  WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.' WHEN 1 THEN ' ' || p_size || '.' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') WHEN 2 THEN CAST(p_size * 5 AS VARCHAR)
     WHEN 3 THEN '.' || (p_partkey % 10) WHEN 4 THEN '-' || p_size ELSE p_size || '.12345' END AS t FROM part)
  SELECT p_partkey, CASE WHEN regexp_matches(trim(t), '^([0-9]+(\.[0-9]{0,4})?|\.[0-9]{1,4})$') AND CAST(regexp_replace('0' || trim(t), '\.$', '') AS DECIMAL(30, 4)) <= 100
     THEN CAST(CAST(regexp_replace('0' || trim(t), '\.$', '') AS DECIMAL(30, 4)) * 10000 AS BIGINT) END AS ppm FROM t""")
def parse_percentage(m: Model):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    form = (
        F.when(key % 6 == 0, F.concat(size, F.lit("."))).when(key % 6 == 1, F.concat(F.lit(" "), size, F.lit("."), F.lpad((key % 10000).cast("string"), 4, "0")))
        .when(key % 6 == 2, (F.col("p_size") * 5).cast("string")).when(key % 6 == 3, F.concat(F.lit("."), (key % 10).cast("string")))
        .when(key % 6 == 4, F.concat(F.lit("-"), size)).otherwise(F.concat(size, F.lit(".12345")))
    )
    return m.part.select("p_partkey", numbers.parse_percentage(form).alias("ppm"))


@query("meets_floor", """
  WITH c AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS k FROM orders GROUP BY o_custkey)
  SELECT o_custkey, CAST(k AS HUGEINT) * 1000000 >= CAST(333333 AS HUGEINT) * n AS met FROM c""")
def meets_floor(m: Model):
    counts = m.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("k"))
    return counts.select("o_custkey", numbers.meets(F.col("k"), F.col("n"), F.lit(333_333)).alias("met"))


@query("path_predicates", r"""
  WITH f AS (SELECT DISTINCT unnest([file, replace(file, '.ts', '_test.ts'), replace(file, 'src/', 'tests/'), regexp_replace(file, '[^/]*$', 'package.json'), regexp_replace(file, '[^/]*$', 'tsconfig.app.json'),
     regexp_replace(file, '[^/]*$', '.eslintrc.config.js'), replace(file, '.ts', '.config.ts')]) AS file FROM sites)
  SELECT file, regexp_matches(lower(regexp_extract(file, '[^/]*$')), '(^|[_.-])(test|spec)([_.-]|$)') AS named, regexp_matches(lower(file), '^(test|tests|__tests__)(/|$)|(^|[/_.-])(test|spec)([/_.-]|$)') AS beside,
    file LIKE '%/package.json' AS dependency, regexp_matches(file, '/tsconfig[^/]*\.json$|/[^/.][^/]*\.config\.[^/]*$') AS configuration FROM f""")
def path_predicates(m: Model):
    f = F.col("file")
    into = lambda name: F.regexp_replace(f, "[^/]+$", name)
    forms = F.array(f, F.regexp_replace(f, r"\.ts", "_test.ts"), F.regexp_replace(f, "src/", "tests/"), into("package.json"), into("tsconfig.app.json"),
                    into(".eslintrc.config.js"), F.regexp_replace(f, r"\.ts", ".config.ts"))
    return m.sites.select(F.explode(forms).alias("file")).distinct().select(
        "file", paths.named_as_test(f).alias("named"), paths.beside_the_tests(f).alias("beside"), paths.dependency_file(f).alias("dependency"),
        paths.configuration_file(f).alias("configuration"))


@query("test_kind", """
  WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'spec/features/' WHEN 1 THEN 'test/checkout-integration-e2e/' WHEN 2 THEN 'apiRequests/' WHEN 3 THEN 'unit/end-to-end/' WHEN 4 THEN 'a/b/' ELSE 'componentsTest/x/' END
     || CASE WHEN p_partkey % 5 = 0 THEN 'cartUnit_test.ts' ELSE 'cart.ct.ts' END AS f, p_partkey % 7 = 0 AS tagged FROM part)
  SELECT p_partkey, CASE WHEN tagged THEN 'integration' WHEN p_partkey % 6 IN (0, 1, 3) THEN 'e2e' WHEN p_partkey % 6 = 2 THEN 'integration' WHEN p_partkey % 6 = 5 THEN 'component'
     WHEN p_partkey % 5 = 0 THEN 'unit' ELSE 'component' END AS kind FROM t""")
def test_kind(m: Model):
    key = F.col("p_partkey")
    folder = F.element_at(F.array(*[F.lit(x) for x in (
        "spec/features/", "test/checkout-integration-e2e/", "apiRequests/", "unit/end-to-end/", "a/b/", "componentsTest/x/")]), (key % 6 + 1).cast("int"))
    path = F.concat(folder, F.when(key % 5 == 0, "cartUnit_test.ts").otherwise("cart.ct.ts"))
    tags = F.when(key % 7 == 0, F.array(F.lit("slow"), F.lit("@Integration"))).otherwise(F.array(F.lit("slow")))
    return m.part.select("p_partkey", paths.test_kind(path, tags).alias("kind"))


@query("area_directory", "SELECT file, array_to_string(list_slice(string_split(file, '/'), 1, least(1, len(string_split(file, '/')) - 1)), '/') AS directory, count(*) AS sites FROM sites GROUP BY ALL")
def area_directory(m: Model):
    return m.sites.groupBy("file", gaps.area_directory(F.col("file"), 1).alias("directory")).agg(F.count(F.lit(1)).alias("sites"))


@query("vector_text", """
  SELECT run_id, decision_id, seq, CASE WHEN a THEN 'T' ELSE 'F' END || ' ' || CASE WHEN b IS NULL THEN '-' WHEN b THEN 'T' ELSE 'F' END
    || CASE WHEN width = 3 THEN ' ' || CASE WHEN c IS NULL THEN '-' WHEN c THEN 'T' ELSE 'F' END ELSE '' END AS shown FROM vectors""")
def vector_text(m: Model):
    from attestry.operators.mcdc import vector_text as shown

    return m.vectors_.select("run_id", "decision_id", "seq", shown(F.col("vals")).alias("shown"))


@query("independence_pairs", """
  WITH v AS (SELECT DISTINCT run_id, decision_id, a, b, c, outcome FROM vectors),
  p AS (SELECT l.run_id, l.decision_id, CAST(coalesce(l.a <> r.a, FALSE) AS INT) AS da, CAST(coalesce(l.b <> r.b, FALSE) AS INT) AS db, CAST(coalesce(l.c <> r.c, FALSE) AS INT) AS dc
    FROM v l JOIN v r ON l.run_id = r.run_id AND l.decision_id = r.decision_id AND l.outcome <> r.outcome)
  SELECT run_id, decision_id, CASE WHEN da = 1 THEN 0 WHEN db = 1 THEN 1 ELSE 2 END AS condition, count(*) AS pairs FROM p WHERE da + db + dc = 1 GROUP BY ALL""")
def independence_pairs(m: Model):
    from attestry.operators import mcdc

    seen = mcdc.observations(m.vectors_, ["run_id"]).withColumn("rank", F.lit(0))
    return mcdc.independence_pairs(seen, seen, ["run_id"]).groupBy("run_id", "decision_id", "condition").agg(F.count(F.lit(1)).alias("pairs"))
