"""Change impact and assertion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import text as words
from attestry.operators import asserts, impact
from attestry.plans.catalog import query
from attestry.plans.model import Model
from attestry.session import stored


def kept(m: Model, name: str, build):
    """A table several of these queries start from, written once in an application."""
    return stored(m.spark, m.sf_dir, f"impact-{name}", build)


# --- the documents as a checkout ----------------------------------------------

def units(m: Model):
    return kept(m, "units", lambda: split_units(m))


def difference_of(m: Model):
    return kept(m, "difference", lambda: impact.declaration_diff(units(m)))


def changes_of(m: Model):
    return kept(m, "changes", lambda: impact.file_changes(files(m), difference_of(m), probed(m)))


def closure_of(m: Model):
    return kept(m, "closure", lambda: impact.ancestors(before(m)))


def split_units(m: Model):
    lines = m.versions.filter("parsed").select("version", F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    idx = F.col("pos") + 1
    return lines.select(
        "version", "file", idx.alias("idx"), F.concat(F.lit("L"), idx.cast("string")).alias("path"), F.md5(F.trim("text")).alias("digest"),
        F.when(idx % 5 != 1, F.floor((idx - 1) / 5).cast("int") * 5 + 1).alias("parent"), (idx % 17 == 0).alias("inert"),
        idx.alias("line"), F.when(idx % 5 == 1, idx + 4).otherwise(idx).alias("end_line"))


def files(m: Model):
    parsed = F.col("parsed")
    return m.versions.select(
        "version", F.col("path").alias("file"), F.md5("text").alias("bytes"), F.when(parsed, F.md5(F.lower("text"))).alias("semantic"),
        F.when(parsed, F.size(F.split("text", "\n"))).alias("structure"))


def before(m: Model):
    return units(m).filter("version = 'before'")


def test_records(m: Model):
    d = F.col("doc_id")
    return m.checkout.select(
        "doc_id", F.col("path").alias("test_file"), F.concat(F.lit("test d"), d.cast("string"), F.lit("::srcCase")).alias("name"), (d % 13 != 0).alias("passed"),
        F.when(d % 7 == 3, "partial").when(d % 11 == 0, "run-wide").otherwise("exact").alias("attribution"))


def executed(m: Model):
    ran = before(m).select("file", "idx").join(m.checkout.select(F.col("path").alias("file"), "doc_id"), "file")
    tests = test_records(m).select("doc_id", "test_file", "name")
    # Every fourth line is run by no test.
    return ran.filter("idx % 4 <> 0").withColumn("doc_id", F.col("doc_id") + 1 + F.col("idx") % 3).join(tests, "doc_id").select("test_file", "name", "file", "idx")


def probed(m: Model):
    return before(m).filter("idx % 19 <> 0").select("file", "idx")


O_UNITS = """
  un AS (SELECT version, path AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS idx, doc_id FROM versions WHERE parsed),
  bu AS (SELECT file, idx, md5(trim(text)) AS digest, idx % 17 = 0 AS inert, doc_id FROM un WHERE version = 'before'),
  au AS (SELECT file, idx, md5(trim(text)) AS digest FROM un WHERE version = 'after'),
  dd AS (SELECT coalesce(b.file, a.file) AS file, 'L' || coalesce(b.idx, a.idx) AS path, b.idx AS old_idx, a.idx AS new_idx, b.inert,
     CASE WHEN b.digest IS NULL THEN 'added' WHEN a.digest IS NULL THEN 'removed' ELSE 'changed' END AS change
     FROM bu b FULL JOIN au a ON a.file = b.file AND a.idx = b.idx WHERE b.digest IS DISTINCT FROM a.digest)"""
O_CHANGES = O_UNITS + """,
  vf AS (SELECT version, path AS file, text, parsed, len(string_split(text, chr(10))) AS n FROM versions),
  fc AS (SELECT coalesce(o.file, n.file) AS file, CASE WHEN o.file IS NULL THEN 'added' WHEN n.file IS NULL THEN 'removed' WHEN o.text = n.text THEN 'same'
     WHEN NOT o.parsed THEN 'bytes' WHEN lower(o.text) = lower(n.text) THEN 'comments only' ELSE 'code' END AS kind, o.n = n.n AS flat
     FROM (SELECT * FROM vf WHERE version = 'before') o FULL JOIN (SELECT * FROM vf WHERE version = 'after') n ON n.file = o.file),
  ch AS (SELECT file, kind AS change, kind = 'code' AND flat AND NOT EXISTS (SELECT 1 FROM dd WHERE dd.file = fc.file AND (dd.change <> 'changed' OR dd.inert OR dd.old_idx % 19 = 0)) AS narrow FROM fc)"""


@query("declaration_diff", f"WITH {O_UNITS} SELECT file, path, old_idx, new_idx, change FROM dd")
def declaration_diff(m: Model):
    return difference_of(m).drop("inert")


@query("file_changes", f"WITH {O_CHANGES} SELECT file, change, narrow FROM ch")
def file_changes(m: Model):
    return changes_of(m)


O_TREE = """
  tree AS (SELECT concat('d', CAST(doc_id AS VARCHAR)) AS file, i AS idx, CASE WHEN i > 1 THEN i // 2 END AS parent
    FROM (SELECT doc_id, unnest(range(1, 3 + n_chars % 37)) AS i FROM documents))"""


def tree(m: Model):
    nodes = m.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.explode(F.sequence(F.lit(1).cast("bigint"), 2 + F.col("n_chars") % 37)).alias("idx"))
    return nodes.withColumn("parent", F.when(F.col("idx") > 1, F.floor(F.col("idx") / 2)))


@query("unit_ancestors", f"""WITH RECURSIVE {O_TREE},
  up AS (SELECT file, idx, idx AS ancestor FROM tree UNION ALL SELECT u.file, u.idx, t.parent FROM up u JOIN tree t ON t.file = u.file AND t.idx = u.ancestor WHERE t.parent IS NOT NULL)
  SELECT file, idx, ancestor FROM up""")
def unit_ancestors(m: Model):
    return impact.ancestors(tree(m))


O_SPANS = """
  sp AS (SELECT file, idx, parent, CAST(idx AS INT) AS line, CAST(idx + 40 // idx AS INT) AS end_line FROM tree)"""


def spans(m: Model):
    return tree(m).withColumn("line", F.col("idx").cast("int")).withColumn("end_line", (F.col("idx") + F.floor(F.lit(40) / F.col("idx"))).cast("int"))


@query("innermost_unit", f"""WITH {O_TREE}, {O_SPANS},
  pl AS (SELECT DISTINCT file, CAST(idx * 3 AS INT) AS line, CAST(idx % 7 AS INT) AS col FROM tree)
  SELECT pl.file, pl.line, pl.col, max(sp.idx) AS unit FROM pl LEFT JOIN sp ON sp.file = pl.file AND (sp.line, 1) <= (pl.line, pl.col) AND (pl.line, pl.col) <= (sp.end_line, 80) GROUP BY ALL""")
def innermost_unit(m: Model):
    places = tree(m).select("file", (F.col("idx") * 3).cast("int").alias("line"), (F.col("idx") % 7).cast("int").alias("col")).distinct()
    return impact.innermost_unit(places, spans(m).withColumn("col", F.lit(1)).withColumn("end_col", F.lit(80)))


@query("own_lines", f"""WITH {O_TREE}, {O_SPANS},
  al AS (SELECT file, idx, unnest(range(line, end_line + 1)) AS line FROM sp), ne AS (SELECT DISTINCT file, parent AS idx, unnest(range(line, end_line + 1)) AS line FROM sp WHERE parent IS NOT NULL),
  ow AS (SELECT * FROM al WHERE NOT EXISTS (SELECT 1 FROM ne WHERE ne.file = al.file AND ne.idx = al.idx AND ne.line = al.line)),
  gi AS (SELECT *, line - row_number() OVER (PARTITION BY file, idx ORDER BY line) AS g FROM ow)
  SELECT file, idx, CAST(min(line) AS INT) AS "start", CAST(max(line) AS INT) AS "end" FROM gi GROUP BY file, idx, g""")
def own_lines(m: Model):
    return impact.own_lines(spans(m))


O_TESTS = """
  te AS (SELECT doc_id, path AS test_file, 'test d' || doc_id || '::srcCase' AS name, doc_id % 13 <> 0 AS passed,
     CASE WHEN doc_id % 7 = 3 THEN 'partial' WHEN doc_id % 11 = 0 THEN 'run-wide' ELSE 'exact' END AS attribution FROM checkout),
  ex AS (SELECT t.test_file, t.name, b.file, b.idx FROM bu b JOIN te t ON t.doc_id = b.doc_id + 1 + b.idx % 3 WHERE b.idx % 4 <> 0),
  ru AS (SELECT test_file, name, file, idx FROM ex UNION SELECT test_file, name, file, CAST((idx - 1) // 5 AS BIGINT) * 5 + 1 FROM ex),
  im AS (SELECT a.path AS file, b.path AS target FROM checkout a JOIN checkout b ON b.doc_id = a.doc_id + CASE WHEN a.doc_id % 2 = 0 THEN 1 ELSE 5 END WHERE a.doc_id % 4 <> 3),
  lo AS (SELECT file AS test_file, target AS file FROM im UNION SELECT a.file, b.target FROM im a JOIN im b ON b.file = a.target
     UNION SELECT a.file, c.target FROM im a JOIN im b ON b.file = a.target JOIN im c ON c.file = b.target UNION SELECT a.file, d.target FROM im a JOIN im b ON b.file = a.target JOIN im c ON c.file = b.target JOIN im d ON d.file = c.target),
  fo AS (SELECT path AS test_file FROM checkout WHERE doc_id % 1000 <> 8),
  sv AS (SELECT a.path AS file, t.name FROM checkout a JOIN te t ON t.doc_id = a.doc_id + 9 OR t.doc_id = a.doc_id + 11 WHERE a.doc_id % 4 = 1 OR a.doc_id < 12),
  nw AS (SELECT DISTINCT b.file, CASE WHEN b.idx % 5 = 1 THEN 'L' || b.idx END AS word FROM bu b JOIN ch ON ch.file = b.file WHERE ch.change = 'code' AND NOT narrow AND b.file LIKE '%.java' AND b.idx % 5 = 1 AND b.idx > 9
     UNION SELECT file, regexp_extract(file, '([^/.]*)\\.[^/]*$', 1) FROM ch WHERE change = 'code' AND NOT narrow AND file LIKE '%.java' AND strlen(regexp_extract(file, '([^/.]*)\\.[^/]*$', 1)) > 2),
  ns AS (SELECT v.path AS test_file, nw.file, min(nw.word) AS word FROM (SELECT path, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM versions WHERE version = 'after') v JOIN nw ON nw.word = v.w GROUP BY ALL),
  oa AS (SELECT ch.file FROM ch JOIN dd ON dd.file = ch.file WHERE ch.change = 'code' GROUP BY ch.file HAVING bool_and(dd.change = 'added')),
  he AS (SELECT file FROM ch WHERE change IN ('removed', 'bytes', 'code') AND file NOT IN (SELECT test_file FROM te WHERE doc_id % 2 = 0) AND file NOT IN (SELECT path FROM checkout WHERE doc_id % 3 = 0) AND file NOT IN (SELECT file FROM oa)),
  hr AS (SELECT t.test_file, t.name, he.file, ch.change, fo.test_file IS NOT NULL AS known, fo.test_file IS NOT NULL AND (t.test_file, he.file) IN (SELECT test_file, file FROM lo) AS imported,
       he.file IN (SELECT file FROM sv) AS serving, (he.file, t.name) IN (SELECT file, name FROM sv) AS served, he.file IN (SELECT file FROM lo WHERE test_file IN (SELECT test_file FROM fo)) AS placed
     FROM te t CROSS JOIN he JOIN ch ON ch.file = he.file LEFT JOIN fo ON fo.test_file = t.test_file),
  hs AS (SELECT test_file, name, file || CASE change WHEN 'removed' THEN ' removed' ELSE ' changed' END || CASE WHEN imported THEN ' (this test''s file loads it)' WHEN serving THEN ' (a server that served this test loaded it)' ELSE ' (a file tests may load)' END AS reason
     FROM hr WHERE imported OR (serving AND served) OR (NOT serving AND (NOT known OR NOT placed))),
  mv AS (SELECT * FROM ch WHERE change IN ('removed', 'bytes', 'code')),
  re AS (SELECT test_file, name, 'did not pass in the run' AS reason FROM te WHERE NOT passed
    UNION SELECT t.test_file, t.name, CASE change WHEN 'removed' THEN 'test file removed' ELSE 'test file changed' END FROM te t JOIN mv ON mv.file = t.test_file
    UNION SELECT e.test_file, e.name, e.file || CASE change WHEN 'removed' THEN ' removed' ELSE ' changed' END || ' (this test ran code in it)' FROM ex e JOIN mv ON mv.file = e.file WHERE change IN ('removed', 'bytes')
    UNION SELECT r.test_file, r.name, r.file || ': changed (this test ran it)' FROM ru r JOIN dd ON dd.file = r.file AND dd.old_idx = r.idx AND dd.change = 'changed' JOIN mv ON mv.file = r.file WHERE mv.change = 'code' AND narrow
    UNION SELECT e.test_file, e.name, e.file || ': changed (this test ran code in this file)' FROM ex e JOIN mv ON mv.file = e.file WHERE change = 'code' AND NOT narrow
    UNION SELECT * FROM hs
    UNION SELECT t.test_file, t.name, ns.file || ': declarations changed, and the test file names ' || ns.word FROM te t JOIN ns ON ns.test_file = t.test_file
      WHERE ns.file <> t.test_file AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.test_file = t.test_file AND ex.name = t.name AND ex.file = ns.file)),
  inside AS (SELECT file, change AS why, CASE change WHEN 'removed' THEN 0 ELSE 1 END AS rank, file || CASE change WHEN 'removed' THEN ' removed' ELSE ' changed' END || ' (the run covered code in it)' AS reason FROM ch WHERE change IN ('removed', 'bytes')
    UNION ALL SELECT file, 'code', 2, file || ': changed (the run covered it)' FROM ch WHERE change = 'code' AND EXISTS (SELECT 1 FROM dd JOIN ru ON ru.file = dd.file AND ru.idx = dd.old_idx WHERE dd.file = ch.file AND dd.change = 'changed')),
  bu2 AS (SELECT t.test_file, t.name, t.attribution, coalesce(re.reason, CASE WHEN t.attribution IN ('partial', 'run-wide') THEN (SELECT arg_min(reason, (rank, reason)) FROM inside) END) AS reason,
      CASE WHEN re.reason IS NOT NULL THEN 'affected' WHEN t.attribution IN ('partial', 'run-wide') AND (SELECT count(*) FROM inside) > 0 THEN 'undetermined' ELSE 'unaffected' END AS bucket
    FROM te t LEFT JOIN re ON re.test_file = t.test_file AND re.name = t.name)"""


def imports_of(m: Model, without: int = -1):
    """Files and what they import: one other each, some none."""
    near = F.when(F.col("doc_id") % 2 == 0, 1).otherwise(5)
    by = m.checkout.filter(f"doc_id % 4 <> 3 and doc_id <> {without}").select(F.col("path").alias("file"), (F.col("doc_id") + near).alias("doc_id"))
    return by.join(m.checkout.select("doc_id", F.col("path").alias("target")), "doc_id").select("file", "target")


def loaded(m: Model, without: int = -1):
    return kept(m, f"loads{without}", lambda: impact.load_closure(m.checkout.select(F.col("path").alias("test_file")), imports_of(m, without)))


def followed(m: Model):
    return m.checkout.filter("doc_id % 1000 <> 8").select(F.col("path").alias("test_file"))


def served_by(m: Model):
    """Files a serving process loaded, with the names of the tests it served."""
    files_ = m.checkout.filter("doc_id % 4 = 1 or doc_id < 12").select(F.col("path").alias("file"), F.explode(F.array(F.col("doc_id") + 9, F.col("doc_id") + 11)).alias("doc_id"))
    return files_.join(test_records(m).select("doc_id", "name"), "doc_id").select("file", "name")


def namings(m: Model, changes):
    sources = m.versions.filter("version = 'after'").select(F.col("path").alias("test_file"), "text")
    return impact.naming_tests(sources, impact.declared_names(units(m), changes))


def changed_helpers(m: Model, changes, difference):
    known = test_records(m).filter("doc_id % 2 = 0")
    measured = m.checkout.filter("doc_id % 3 = 0").select(F.col("path").alias("file"))
    return impact.helpers(changes, known, measured, difference)


def buckets(m: Model):
    difference = difference_of(m)
    changes = changes_of(m)
    ran = executed(m)
    closure = closure_of(m)
    return impact.affected_tests(
        test_records(m).drop("doc_id"), ran, closure, changes, difference, changed_helpers(m, changes, difference), loaded(m), ran.select("file", "idx").distinct(),
        followed(m), served_by(m), namings(m, changes))


@query("affected_tests", f"WITH {O_CHANGES}, {O_TESTS} SELECT test_file, name, attribution, reason, bucket FROM bu2")
def affected_tests(m: Model):
    return buckets(m)


@query("helper_files", f"WITH {O_CHANGES}, {O_TESTS} SELECT file, change FROM he JOIN ch USING (file)")
def helper_files(m: Model):
    difference = difference_of(m)
    return changed_helpers(m, changes_of(m), difference).select("file", "change")


# Nothing is seen to import document 35, so any test may load it.
O_UNPLACED = O_TESTS.replace("a.doc_id % 4 <> 3", "a.doc_id % 4 <> 3 AND a.doc_id <> 34")


@query("helper_reasons", f"WITH {O_CHANGES}, {O_UNPLACED} SELECT test_file, name, reason FROM hs")
def helper_reasons(m: Model):
    difference = difference_of(m)
    changes = changes_of(m)
    return impact.helper_reasons(test_records(m), changed_helpers(m, changes, difference), loaded(m, without=34), followed(m), served_by(m))


@query("loads_of_tests", f"""WITH RECURSIVE im AS (SELECT a.path AS file, b.path AS target FROM checkout a JOIN checkout b ON b.doc_id = a.doc_id + CASE WHEN a.doc_id % 2 = 0 THEN 1 ELSE 5 END WHERE a.doc_id % 4 <> 3),
  lo AS (SELECT file AS test_file, target AS file FROM im UNION SELECT lo.test_file, im.target FROM lo JOIN im ON im.file = lo.file)
  SELECT test_file, file FROM lo""")
def loads_of_tests(m: Model):
    return loaded(m)


@query("declarations_named_by_tests", f"WITH {O_CHANGES}, {O_TESTS} SELECT test_file, file, word FROM ns")
def declarations_named_by_tests(m: Model):
    return namings(m, changes_of(m))


@query("beyond_the_run", f"WITH {O_CHANGES}, {O_TESTS} SELECT file, why, reason FROM inside")
def beyond_the_run(m: Model):
    difference = difference_of(m)
    changes = changes_of(m)
    return impact.beyond_the_run(changes, difference, executed(m).select("file", "idx").distinct(), closure_of(m)).select("file", "why", "reason")


@query("affected_of_merge", f"""WITH {O_CHANGES}, {O_TESTS},
  two AS (SELECT test_file, name, bucket, reason FROM bu2 UNION ALL SELECT test_file, name, CASE WHEN passed THEN 'unaffected' ELSE 'affected' END, CASE WHEN passed THEN NULL ELSE 'did not pass in the run' END FROM te),
  r AS (SELECT *, CASE bucket WHEN 'affected' THEN 0 WHEN 'undetermined' THEN 1 ELSE 2 END AS k FROM two)
  SELECT DISTINCT test_file, name, bucket, reason FROM r WHERE k = (SELECT min(k) FROM r x WHERE x.test_file = r.test_file AND x.name = r.name)""")
def affected_of_merge(m: Model):
    other = test_records(m).select("test_file", "name", F.when(F.col("passed"), "unaffected").otherwise("affected").alias("bucket"),
                                   F.when(~F.col("passed"), "did not pass in the run").alias("reason"))
    return impact.merged_affected(buckets(m).select("test_file", "name", "bucket", "reason").unionByName(other))


O_VERDICTS = """
  st AS (SELECT e.test_file, e.name, e.file, e.idx, CASE WHEN e.idx % 3 = 0 THEN (e.idx * 37 % 100) / 100.0::DOUBLE END AS p, e.idx % 9 <> 0 AS complete
     FROM ex e JOIN dd ON dd.file = e.file AND dd.old_idx = e.idx AND dd.change = 'changed'),
  an AS (SELECT test_file, name, max(p) AS best, count(*) AS n, bool_and(complete) AS c FROM st GROUP BY ALL),
  ow2 AS (SELECT test_file, name, bool_or(reason LIKE 'test file%' OR reason = 'did not pass in the run') AS own FROM bu2 WHERE bucket = 'affected' GROUP BY ALL),
  vd AS (SELECT o.test_file, o.name, CASE WHEN own THEN 'must run' WHEN best >= 0.5 THEN 'catches' WHEN best IS NOT NULL THEN 'runs' WHEN n > 0 AND c THEN 'misses' ELSE 'unassessed' END AS verdict, best
     FROM ow2 o LEFT JOIN an ON an.test_file = o.test_file AND an.name = o.name)"""


def verdicts(m: Model):
    changed = difference_of(m).filter("change = 'changed'").select("file", F.col("old_idx").alias("idx"))
    statements = executed(m).join(changed, ["file", "idx"]).select(
        "test_file", "name", F.when(F.col("idx") % 3 == 0, (F.col("idx") * 37 % 100) / 100.0).alias("p"), (F.col("idx") % 9 != 0).alias("complete"))
    return impact.assertion_verdicts(buckets(m), statements)


@query("assertion_verdicts_of_change", f"WITH {O_CHANGES}, {O_TESTS}, {O_VERDICTS} SELECT * FROM vd")
def assertion_verdicts_of_change(m: Model):
    return verdicts(m)


@query("affected_order", f"""WITH {O_CHANGES}, {O_TESTS}, {O_VERDICTS},
  wo AS (SELECT DISTINCT regexp_extract(file, '([^/.]*)\\.[^/]*$', 1) AS w FROM ch WHERE change NOT IN ('same', 'comments only')),
  ma AS (SELECT t.test_file, t.name, count(DISTINCT wo.w) AS name_match FROM te t JOIN wo ON wo.w = 'd' || t.doc_id AND length(wo.w) > 1 GROUP BY ALL)
  SELECT v.test_file, v.name, verdict, best, coalesce(name_match, 0) AS name_match, CASE verdict WHEN 'must run' THEN 0 WHEN 'catches' THEN 1 WHEN 'unassessed' THEN 2 WHEN 'runs' THEN 3 ELSE 4 END AS rank
  FROM vd v LEFT JOIN ma ON ma.test_file = v.test_file AND ma.name = v.name""")
def affected_order(m: Model):
    changes = changes_of(m)
    matches = impact.matched_words(test_records(m), impact.changed_words(changes))
    return impact.order_affected(verdicts(m), matches)


@query("names_word", r"""
  SELECT doc_id, regexp_matches(text, '(^|[^\p{L}\p{N}_])' || w || '($|[^\p{L}\p{N}_])') AS named FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'le' ELSE 'und' END AS w FROM documents)""")
def names_word(m: Model):
    word = F.when(F.col("doc_id") % 3 == 0, "the").when(F.col("doc_id") % 3 == 1, "le").otherwise("und")
    return m.documents.select("doc_id", words.names_word(F.col("text"), word).alias("named"))


# --- assertions ----------------------------------------------------------------

O_JUDGED = """
  ju AS (SELECT run_id, id, coalesce(bool_or(p >= 0.5) FILTER (asked), FALSE) AS asserted, max(p) FILTER (asked) AS best,
     (list(test_id ORDER BY p DESC, test_id) FILTER (asked))[1] AS best_test, count(*) FILTER (asked) AS asked, count(*) AS running FROM statement_answers GROUP BY ALL)"""


@query("assertion_verdicts", f"WITH {O_JUDGED} SELECT * FROM ju")
def assertion_verdicts(m: Model):
    return asserts.verdicts(m.statement_answers)


@query("weak_assertions", f"WITH {O_JUDGED} SELECT run_id, id, best FROM ju WHERE asserted AND best < 0.75")
def weak_assertions(m: Model):
    return asserts.weak(asserts.verdicts(m.statement_answers)).select("run_id", "id", "best")


O_SHARE = """
  sh AS (SELECT p.run_id, p.file, j.* EXCLUDE (run_id, id) FROM ju j JOIN points p ON p.run_id = j.run_id AND p.id = j.id WHERE j.asked > 0)"""


@query("assertion_share", f"""WITH {O_JUDGED}, {O_SHARE}
  SELECT run_id, file, count(*) AS assessed, count(*) FILTER (asserted) AS asserted, count(*) FILTER (asserted AND best < 0.75) AS weak,
    round(count(*) FILTER (asserted) * 100.0::DOUBLE / count(*) * 10) / 10 AS pct FROM sh GROUP BY GROUPING SETS ((run_id, file), (run_id))""")
def assertion_share(m: Model):
    return asserts.share(asserts.verdicts(m.statement_answers), m.points)


@query("unasked_files", f"""WITH {O_JUDGED} SELECT p.run_id, p.file FROM ju j JOIN points p ON p.run_id = j.run_id AND p.id = j.id GROUP BY ALL HAVING max(j.asked) = 0""")
def unasked_files(m: Model):
    return asserts.unasked_files(asserts.verdicts(m.statement_answers), m.points)


@query("assertion_verdicts_of_picked", """
  SELECT s.run_id, s.id, bool_or(p >= 0.5) FILTER (asked) AS asserted, max(p) FILTER (asked) AS best, (list(s.test_id ORDER BY p DESC, s.test_id) FILTER (asked))[1] AS best_test,
    count(*) FILTER (asked) AS asked, count(*) AS running FROM statement_answers s JOIN tests t ON t.run_id = s.run_id AND t.test_id = s.test_id WHERE t.kind = 'unit'
  GROUP BY ALL HAVING count(*) FILTER (asked) > 0""")
def assertion_verdicts_of_picked(m: Model):
    return asserts.picked_verdicts(m.statement_answers, m.tests.filter("kind = 'unit'"))


@query("first_statement_on_line", "SELECT run_id, file, line, arg_min(id, (col, id)) AS id FROM points WHERE kind = 'statement' GROUP BY ALL")
def first_statement_on_line(m: Model):
    return asserts.first_on_line(m.points.filter("kind = 'statement'"))


@query("module_level_credit", """
  WITH s AS (SELECT * FROM points WHERE kind = 'statement'), f AS (SELECT file, line AS a, line + 3 AS b FROM sites WHERE p_partkey % 5 = 0),
  r AS (SELECT DISTINCT run_id, hit_id AS id, test_id FROM hits), i AS (SELECT s.*, EXISTS (SELECT 1 FROM f WHERE f.file = s.file AND s.line BETWEEN f.a AND f.b) AS inside FROM s),
  u AS (SELECT DISTINCT i.run_id, i.file, r.test_id FROM i JOIN r ON r.run_id = i.run_id AND r.id = i.id WHERE inside)
  SELECT s.run_id, s.id, r.test_id FROM s JOIN r ON r.run_id = s.run_id AND r.id = s.id UNION SELECT i.run_id, i.id, u.test_id FROM i JOIN u ON u.run_id = i.run_id AND u.file = i.file WHERE NOT inside""")
def module_level_credit(m: Model):
    spans_ = m.sites.filter("p_partkey % 5 = 0").select("file", F.col("line").alias("start"), (F.col("line") + 3).alias("end"))
    running = m.hits.select("run_id", F.col("hit_id").alias("id"), "test_id").distinct()
    return asserts.credit_module_level(m.points.filter("kind = 'statement'"), running, spans_)


@query("quoted_fragments", r"""
  WITH p AS (SELECT page_id, regexp_extract_all(html, '"([^"\\]*)"', 1) AS q FROM (SELECT page_id, replace(replace(replace(replace(replace(html, '''', ' '), '`', ' '), chr(92), ' '), '{', ' '), '}', ' ') AS html FROM pages)),
  y AS (SELECT page_id, unnest(q) AS q FROM p),
  x AS (SELECT page_id, trim(unnest(regexp_split_to_array(q, '[$#%]')), ' ' || chr(9) || chr(10) || chr(13)) AS f FROM y)
  SELECT DISTINCT page_id, f AS fragment FROM x WHERE strlen(f) >= 6 AND length(regexp_replace(f, '[^\p{L}]', '', 'g')) >= 3""")
def quoted_fragments(m: Model):
    bare = F.translate("html", "'`\\{}", "     ")
    return m.pages.select("page_id", F.explode(words.quoted_fragments(bare)).alias("fragment"))


def asking(m: Model):
    running = m.hits.select("run_id", F.col("hit_id").alias("id"), "test_id").distinct()
    statements = m.points.withColumn("source", F.concat(F.lit('say("'), F.coalesce("label", "source"), F.lit('")')))
    tests = m.tests.withColumn("name", F.concat(F.lit("suite "), F.substring("kind", 1, 1), F.lit(" > "), "name"))
    sources = m.tests.select("run_id", "test_id", F.concat(F.lit("expect "), F.when(F.col("kind") == "unit", "red widget").otherwise("fn_15")).alias("test_source"))
    return statements, running, tests, sources


def asked(m: Model, keep: int):
    statements, running, tests, sources = asking(m)
    told = kept(m, "asking", lambda: asserts.asking_rows(statements, running, tests, None, test_sources=sources))
    return kept(m, f"asked-{keep}", lambda: asserts.first_asked(told, keep))


O_ASK = """
  ss AS (SELECT run_id, id, file, coalesce(label, source) AS said FROM points), rr AS (SELECT DISTINCT run_id, hit_id AS id, test_id FROM hits),
  tt AS (SELECT run_id, test_id, test_file, 'suite ' || substr(kind, 1, 1) AS block, 'suite ' || substr(kind, 1, 1) || ' > ' || name AS name, CASE kind WHEN 'unit' THEN 'red widget' ELSE 'fn_15' END AS src FROM tests),
  jj AS (SELECT s.run_id, s.id, t.test_id, t.test_file, t.block, t.name, NOT contains(lower(regexp_extract(t.test_file, '[^/]*$')), lower(regexp_extract(s.file, '([^/.]*)\\.[^/]*$', 1))) AS away,
      strlen(s.said) >= 6 AND length(regexp_replace(s.said, '[^a-zA-Z]', '', 'g')) >= 3 AND contains('expect ' || t.src, s.said) AS q
    FROM ss s JOIN rr r ON r.run_id = s.run_id AND r.id = s.id JOIN tt t ON t.run_id = r.run_id AND t.test_id = r.test_id),
  k1 AS (SELECT *, row_number() OVER (PARTITION BY run_id, id ORDER BY away, test_file, name, test_id) AS base, count(*) OVER (PARTITION BY run_id, id) AS n FROM jj),
  k2 AS (SELECT *, row_number() OVER (PARTITION BY run_id, id, test_file, q ORDER BY base) AS qn, min(base) OVER (PARTITION BY run_id, id, test_file, block) AS lead FROM k1),
  k3 AS (SELECT *, dense_rank() OVER (PARTITION BY run_id, id, test_file ORDER BY lead) AS depth FROM k2),
  k4 AS (SELECT *, CASE WHEN n <= {keep} THEN 0 WHEN q AND qn = 1 THEN 1 WHEN q THEN 2 WHEN base = lead THEN 3 ELSE 4 END AS tier FROM k3),
  k5 AS (SELECT run_id, id, test_id, row_number() OVER (PARTITION BY run_id, id ORDER BY tier, CASE WHEN tier = 3 THEN depth ELSE 0 END, base) AS place FROM k4)"""


@query("tests_to_ask", f"WITH {O_ASK.format(keep=2)} SELECT * FROM k5 WHERE place <= 2")
def tests_to_ask(m: Model):
    return asked(m, 2)


O_NAME_WORDS = r"""list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'),
    lambda w: length(w) > 2 AND w NOT IN ('test','tests','the','and','for','with','get','set','self','from','not','does','should')))"""
# The spread: the places of the first tests there would be if more were asked.
O_SPREAD = f"""
  k6 AS (SELECT *, CASE WHEN n <= {asserts.MORE_TESTS} THEN 0 WHEN q AND qn = 1 THEN 1 WHEN q THEN 2 WHEN base = lead THEN 3 ELSE 4 END AS tier FROM k3),
  sp AS (SELECT run_id, id, test_id, row_number() OVER (PARTITION BY run_id, id ORDER BY tier, CASE WHEN tier = 3 THEN depth ELSE 0 END, base) AS place FROM k6 QUALIFY place <= {asserts.MORE_TESTS})"""


@query("last_tests_to_ask", f"""WITH {O_ASK.format(keep=2)}, {O_SPREAD},
  br AS (SELECT run_id, test_id, count(*) AS breadth FROM hits GROUP BY ALL),
  sw AS (SELECT run_id, id, {O_NAME_WORDS.format(x="'say(' || chr(34) || said || chr(34) || ')'")} AS ws FROM ss), tw AS (SELECT run_id, test_id, {O_NAME_WORDS.format(x="name")} AS ws FROM tt),
  lt AS (SELECT r.run_id, r.id, r.test_id, len(list_intersect(tw.ws, sw.ws)) AS shared, br.breadth, sp.place FROM rr r JOIN sw ON sw.run_id = r.run_id AND sw.id = r.id
    JOIN tw ON tw.run_id = r.run_id AND tw.test_id = r.test_id JOIN br ON br.run_id = r.run_id AND br.test_id = r.test_id
    LEFT JOIN sp ON sp.run_id = r.run_id AND sp.id = r.id AND sp.test_id = r.test_id
    WHERE NOT EXISTS (SELECT 1 FROM k5 k WHERE k.run_id = r.run_id AND k.id = r.id AND k.test_id = r.test_id AND k.place <= 2))
  SELECT run_id, id, test_id, CAST(shared AS INT) AS shared, row_number() OVER (PARTITION BY run_id, id ORDER BY shared DESC, breadth, place NULLS LAST, test_id) AS last_place
  FROM lt QUALIFY last_place <= {asserts.LAST_TESTS}""")
def last_tests_to_ask(m: Model):
    statements, running, tests, _ = asking(m)
    breadth = m.hits.groupBy("run_id", "test_id").agg(F.count(F.lit(1)).alias("breadth"))
    return asserts.last_order(statements, running, tests, asked(m, 2), asked(m, asserts.MORE_TESTS), breadth)


@query("quoting_tests", f"WITH {O_ASK.format(keep=2)} SELECT run_id, id, test_id FROM jj WHERE q")
def quoting_tests(m: Model):
    statements, running, _, sources = asking(m)
    return asserts.quoting(statements, running, sources)


@query("answer_reuse", """
  WITH k AS (SELECT run_id, id, p FROM statement_answers WHERE run_id = 'run_A1996')
  SELECT s.id, s.test_id, s.run_id, k.p IS NOT NULL AS reused FROM statement_answers s LEFT JOIN (SELECT id, max(p) AS p FROM k GROUP BY id) k ON k.id = s.id WHERE s.run_id <> 'run_A1996'""")
def answer_reuse(m: Model):
    key = words.answer_key(F.col("id"), F.lit("model-1")).alias("key")
    one = F.col("run_id") == "run_A1996"
    kept = m.statement_answers.filter(one).groupBy(key).agg(F.max("p").alias("p"))
    questions = m.statement_answers.filter(~one).select("id", "test_id", "run_id", key)
    return asserts.reuse(questions, kept).select("id", "test_id", "run_id", "reused")
