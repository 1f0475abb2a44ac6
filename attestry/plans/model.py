"""The shared tables read as test evidence.

Every view covers its base tables whole. The text is the common dialect of
Spark SQL and DuckDB plus three macros, so queries and oracles start from the
same inputs; what is computed on top of them is written twice.

``MS(ts)``      epoch milliseconds, floored
``EACH(a, b)``  one row per listed value
``SPAN(a, b)``  one row per integer of an inclusive range
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import coverage
from attestry.session import require_utc, size_as_rows, stored

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

RUN = "concat('run_', l_returnflag, CAST(extract(year FROM l_shipdate) AS VARCHAR(4)))"
FILE = (
    "concat('src/', lower(p_type), '/', lower(replace(p_brand, '#', '_')), '_', "
    "CAST(CAST(floor(p_partkey / 2500) AS BIGINT) AS VARCHAR(20)), '.ts')"
)
HOUR = 3600000

VIEWS: dict[str, str] = {
    # One row per source obligation site, before it is bound to a run.
    "sites": f"""
        SELECT p_partkey, {FILE} AS file, CAST(p_size AS INT) AS line,
               CAST(p_partkey % 40 AS INT) AS col, p_name AS source
        FROM part""",
    "line_records": f"""
        SELECT {RUN} AS run_id, l_suppkey, l_partkey, l_orderkey, l_linenumber,
               l_quantity, l_discount, l_tax, l_extendedprice, l_shipdate,
               l_orderkey * 10 + l_linenumber AS seq
        FROM lineitem""",
    "run_files": """
        SELECT DISTINCT run_id, file FROM line_records JOIN sites ON p_partkey = l_partkey""",
    "points": """
        SELECT r.run_id, concat('p', CAST(p_partkey AS VARCHAR(20))) AS id,
               CASE WHEN p_partkey % 5 = 0 THEN 'function' ELSE 'statement' END AS kind,
               s.file, s.line, s.col, s.source,
               CASE WHEN p_partkey % 5 = 0
                    THEN concat('fn_', CAST(p_partkey AS VARCHAR(20))) END AS label,
               p_partkey % 97 = 0 AS declined
        FROM sites s JOIN run_files r ON r.file = s.file""",
    "alternatives": """
        SELECT run_id, branch_id, kind, concat(branch_id, ':', label) AS id, label, file, line, col,
               p_partkey % 89 = 0 OR (p_partkey % 97 = 0 AND label = 'false') AS declined
        FROM (SELECT r.run_id, p_partkey, concat('b', CAST(p_partkey AS VARCHAR(20))) AS branch_id,
                     CASE WHEN p_partkey % 4 = 0 THEN 'logical-value' ELSE 'if' END AS kind,
                     s.file, s.line, s.col, EACH('true', 'false') AS label
              FROM sites s JOIN run_files r ON r.file = s.file) x""",
    # A decision for every eight parts, at the place of the first of them.
    "decisions": """
        SELECT r.run_id, concat('d', CAST(g AS VARCHAR(20))) AS id, CASE WHEN g % 3 = 0 THEN 2 ELSE 3 END AS width,
               s.file, s.line, s.col, s.source, g % 31 = 0 AS declined
        FROM (SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS g, MIN(p_partkey) AS lead FROM sites GROUP BY CAST(floor(p_partkey / 8) AS BIGINT)) d
        JOIN sites s ON s.p_partkey = d.lead JOIN run_files r ON r.file = s.file""",
    # Decisions whose two outcomes the manifest declares as a branch of their own.
    "outcome_alternatives": """
        SELECT run_id, concat(id, ':outcome') AS branch_id, 'if' AS kind,
               concat(id, ':outcome:', label) AS id, label, file, line, col, declined
        FROM (SELECT d.*, EACH('true', 'false') AS label FROM decisions d) x
        WHERE CAST(substr(id, 2) AS BIGINT) % 9 = 0""",
    "hits": """
        SELECT run_id, concat('t', CAST(l_suppkey AS VARCHAR(20))) AS test_id,
               concat(CASE WHEN l_discount >= 0.095 AND l_tax >= 0.075 THEN 'x' ELSE 'p' END,
                      CAST(l_partkey AS VARCHAR(20))) AS hit_id, seq
        FROM line_records""",
    "branch_hits": """
        SELECT run_id, concat('t', CAST(l_suppkey AS VARCHAR(20))) AS test_id,
               concat('b', CAST(l_partkey AS VARCHAR(20)), ':',
                      CASE WHEN l_quantity > 25 THEN 'true' ELSE 'false' END) AS hit_id, seq
        FROM line_records""",
    "vectors": """
        SELECT run_id, test_id, decision_id, seq, width, a, b, CASE WHEN width = 3 THEN c END AS c,
               (a AND b) OR (width = 3 AND NOT (a AND b) AND c) AS outcome
        FROM (SELECT run_id, concat('t', CAST(l_suppkey AS VARCHAR(20))) AS test_id,
                     concat('d', CAST(CAST(floor(l_partkey / 8) AS BIGINT) AS VARCHAR(20))) AS decision_id,
                     seq, CASE WHEN floor(l_partkey / 8) % 3 = 0 THEN 2 ELSE 3 END AS width,
                     l_quantity > 25 AS a,
                     CASE WHEN l_quantity > 25 THEN l_discount > 0.05 END AS b,
                     CASE WHEN NOT (l_quantity > 25 AND l_discount > 0.05) THEN l_tax > 0.04 END AS c
              FROM line_records) x""",
    "tests": """
        SELECT u.run_id, concat('t', CAST(s_suppkey AS VARCHAR(20))) AS test_id, s_name AS name,
               concat('cart adds item ', CAST(s_suppkey AS VARCHAR(20))) AS title,
               concat('tests/n', CAST(s_nationkey AS VARCHAR(20)), '/n', CAST(s_suppkey % 9 AS VARCHAR(20)),
                      '_test.ts') AS test_file,
               CASE s_nationkey % 4 WHEN 0 THEN 'unit' WHEN 1 THEN 'component'
                    WHEN 2 THEN 'integration' ELSE 'e2e' END AS kind,
               CASE s_nationkey % 3 WHEN 0 THEN 'vitest' WHEN 1 THEN 'playwright' ELSE 'pytest' END AS runner,
               CASE WHEN s_suppkey % 20 = 0 THEN 'setup' WHEN s_suppkey % 33 = 0 THEN 'background'
                    ELSE 'test' END AS role,
               CASE WHEN s_suppkey % 11 = 0 THEN 'run-wide' WHEN s_suppkey % 7 = 0 THEN 'partial'
                    WHEN s_suppkey % 13 = 0 THEN 'by-time' ELSE 'exact' END AS attribution,
               CASE WHEN s_suppkey % 6 = 0 THEN '@API,slow' WHEN s_suppkey % 5 = 0 THEN 'smoke'
                    ELSE '' END AS tags_csv,
               CASE WHEN s_nationkey % 2 = 0 THEN 'path' ELSE 'tag' END AS kind_source
        FROM supplier JOIN (SELECT DISTINCT run_id, l_suppkey FROM line_records) u ON u.l_suppkey = s_suppkey""",
    # One record per line item: the attempt it belongs to and what it says of it.
    "records": """
        SELECT run_id, concat('c', CAST(o_custkey AS VARCHAR(20))) AS test_id,
               CAST((l_linenumber - 1) % 3 AS INT) AS retry,
               CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'passed'
                    ELSE CASE WHEN l_tax > 0.04 THEN 'skipped' ELSE 'unknown' END END AS status,
               CASE WHEN l_partkey % 9 = 0 THEN 'failed' WHEN l_partkey % 9 = 1 THEN 'passed' END AS expected_status,
               l_tax > 0.075 AS flaky,
               CASE CAST(l_orderkey % 8 AS INT) WHEN 0 THEN 'run-wide' WHEN 1 THEN 'partial'
                    WHEN 2 THEN 'by-time' ELSE 'exact' END AS attribution,
               CASE WHEN o_custkey % 20 = 0 THEN 'setup' WHEN o_custkey % 33 = 0 THEN 'background'
                    ELSE 'test' END AS role,
               seq, concat('p', CAST(l_partkey AS VARCHAR(20))) AS hit_id
        FROM line_records JOIN orders ON o_orderkey = l_orderkey""",
    "event_times": f"""
        SELECT event_id, user_id, event_type, value,
               concat('run_u', CAST(CAST(floor(user_id / 3) AS BIGINT) AS VARCHAR(20))) AS run_id,
               concat('u', CAST(user_id AS VARCHAR(20))) AS test_id, MS(ts) AS ms,
               MS(ts) - MS(ts) % {HOUR} AS hour_ms, MS(ts) - MS(ts) % {24 * HOUR} AS day_ms
        FROM events""",
    "phases": """
        SELECT run_id, test_id, concat('ph', CAST(event_id AS VARCHAR(20))) AS id,
               CASE event_type WHEN 'view' THEN 'test' WHEN 'click' THEN 'action'
                    WHEN 'signup' THEN 'setup' ELSE 'assertion' END AS kind,
               event_id AS seq, hour_ms AS started_at_ms,
               LEAD(hour_ms) OVER (PARTITION BY test_id ORDER BY hour_ms, event_id) AS ended_at_ms
        FROM event_times WHERE event_type <> 'error'""",
    "runtime_events": """
        SELECT run_id, test_id, event_id, CASE WHEN event_id % 3 = 0 THEN ms ELSE hour_ms END AS timestamp_ms,
               CASE WHEN event_id % 2 = 0 THEN 'browser' ELSE 'server' END AS environment,
               CASE WHEN event_id % 7 = 0 THEN concat('ph', CAST(event_id AS VARCHAR(20))) END AS own_phase_id
        FROM event_times""",
    "windows": """
        SELECT run_id, test_id, concat(test_id, '@', CAST(day_ms AS VARCHAR(20))) AS attempt_id,
               MIN(ms) AS start_ms, MAX(ms) AS end_ms
        FROM event_times GROUP BY run_id, test_id, day_ms""",
    "background": """
        SELECT run_id, event_id AS record_id, CASE WHEN value < 5 THEN NULL ELSE event_id END AS request,
               ms AS timestamp_ms, concat(run_id, '/w', CAST(user_id % 3 AS VARCHAR(20))) AS process,
               concat('p', CAST(1 + event_id % 100 AS VARCHAR(20))) AS hit_id
        FROM event_times WHERE event_type = 'error'""",
    # Worker 0 of a run served only its own user's attempts; the others name none.
    "served": """
        SELECT DISTINCT run_id, concat(run_id, '/w0') AS process,
               concat(test_id, '@', CAST(day_ms AS VARCHAR(20))) AS attempt_id
        FROM event_times WHERE user_id % 3 = 0""",
    "changed": f"""
        SELECT DISTINCT file, line FROM sites WHERE (line * 7 + col) % 6 = 0
        UNION SELECT DISTINCT concat('src/', lower(p_type), '/zz_new.ts') AS file, CAST(p_size AS INT) AS line FROM part
        UNION SELECT 'docs/readme.md' AS file, CAST(MIN(p_size) AS INT) AS line FROM part
        UNION SELECT DISTINCT concat('tests/n', CAST(s_nationkey AS VARCHAR(20)), '_test.ts') AS file, 1 AS line
        FROM supplier""",
    "limitations": """
        SELECT run_id, concat('lim', CAST(CAST(substr(id, 2) AS BIGINT) AS VARCHAR(20))) AS id,
               CASE CAST(substr(id, 2) AS BIGINT) % 4 WHEN 0 THEN 'dynamic-code' WHEN 1 THEN 'semantic-safety'
                    WHEN 2 THEN 'source-scope' ELSE 'macro' END AS kind,
               file, line, col, CASE WHEN width = 3 THEN source END AS source,
               CASE WHEN width = 2 THEN CAST(substr(id, 2) AS BIGINT) % 2 = 0 END AS blocking,
               CAST(substr(id, 2) AS BIGINT) % 41 = 0 AS whole_file
        FROM decisions WHERE declined OR source LIKE 'red%'""",
    "paths": """
        SELECT doc_id, concat('src/', source, '/', lang, '/d', CAST(doc_id AS VARCHAR(20)),
               CASE doc_id % 5 WHEN 0 THEN '.html' WHEN 1 THEN '.yaml' WHEN 2 THEN '.js' ELSE '.py' END) AS path,
               text, n_chars, source, lang
        FROM documents""",
    "answers": """
        SELECT snapshot, path, window_no, check_id, n_chars AS bytes,
               ((doc_id * 37 + length(check_id) * 101 + window_no * 29
                 + CASE WHEN snapshot = 'b' AND doc_id % 4 = 0 THEN 13 ELSE 0 END) % 100) / CAST(100 AS DOUBLE) AS value
        FROM (SELECT snapshot, doc_id, path, n_chars, window_no,
                     EACH('god_class', 'long_method', 'deep_nesting', 'complex_conditional', 'dead_code', 'magic_values') AS check_id
              FROM (SELECT snapshot, doc_id, path, n_chars, SPAN(0, CAST(floor(n_chars / 8000) AS INT)) AS window_no
                    FROM (SELECT doc_id, path, n_chars, EACH('a', 'b') AS snapshot FROM paths) x) y) z
        WHERE NOT (snapshot = 'b' AND doc_id % 17 = 0) AND NOT (snapshot = 'a' AND doc_id % 19 = 0)""",
    "functions": """
        SELECT file, concat('fn_', CAST(p_partkey AS VARCHAR(20))) AS name, line AS start_line, line + 2 AS end_line,
               concat('return fn_', CAST(p_partkey + 1 AS VARCHAR(20)), '(', source, ')') AS body,
               (p_partkey * 37 % 100) / CAST(100 AS DOUBLE) AS takes_outside,
               (p_partkey * 53 % 100) / CAST(150 AS DOUBLE) AS reaches_sink,
               (p_partkey * 71 % 100) / CAST(160 AS DOUBLE) AS sanitises,
               CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'injection_sink' ELSE 'path_from_input' END AS sink_kind
        FROM sites""",
    "imports": """
        SELECT a.file, b.file AS target, concat('fn_', CAST(b.p_partkey AS VARCHAR(20))) AS local,
               CASE b.p_partkey % 3 WHEN 0 THEN 'default' WHEN 1 THEN '*'
                    ELSE concat('fn_', CAST(b.p_partkey AS VARCHAR(20))) END AS exported,
               CASE WHEN b.p_partkey % 6 = 0 THEN concat('fn_', CAST(b.p_partkey AS VARCHAR(20))) END AS target_default
        FROM sites a JOIN sites b ON b.p_partkey = a.p_partkey + 1""",
    "executions": """
        SELECT DISTINCT concat(run_id, '/t', CAST(l_suppkey AS VARCHAR(20))) AS test_id, file, line
        FROM line_records JOIN sites ON p_partkey = l_partkey""",
    "statement_answers": """
        SELECT run_id, hit_id AS id, test_id, MAX(seq * 17 % 101) / CAST(100 AS DOUBLE) AS p, MIN(seq % 10) < 5 AS asked
        FROM hits GROUP BY run_id, hit_id, test_id""",
    "line_answers": """
        SELECT snapshot, path, check_id, line, (doc_id * 13 + line * 29 + length(check_id)) % 100 / CAST(100 AS DOUBLE) AS value,
               (doc_id * 7 + line * 3) % 100 / CAST(100 AS DOUBLE) AS dismissed
        FROM (SELECT snapshot, path, check_id, doc_id, line
              FROM (SELECT snapshot, path, check_id, doc_id, SPAN(1, 2 + CAST(n_chars % 60 AS INT)) AS line
                    FROM (SELECT 'a' AS snapshot, path, doc_id, n_chars,
                                 EACH('injection_sink', 'secret_in_source', 'unescaped_output') AS check_id FROM paths) x) y) z""",
    # The documents as the files of a checkout; each names another one, some only as part of a longer word.
    "checkout": """
        SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN replace(path, '.py', '.java') ELSE path END AS path, n_chars,
               concat(text, CASE WHEN doc_id % 4 = 3 THEN ' see x_d' ELSE ' see d' END, CAST(doc_id + 6 AS VARCHAR(20)), '.') AS text
        FROM paths""",
    # Its versions before and after a change, one declaration per line.
    "versions": """
        SELECT doc_id, path, version, text, doc_id % 9 <> 0 AS parsed
        FROM (SELECT doc_id, path, 'before' AS version, text FROM checkout
              UNION ALL SELECT doc_id, path, 'after' AS version,
                     CASE WHEN doc_id % 5 = 0 THEN replace(text, 'the', 'THE')
                          WHEN doc_id % 6 = 1 THEN concat(text, chr(10), 'one more line') 
                          WHEN doc_id % 4 = 1 THEN replace(text, 'an', 'on') ELSE text END AS text
              FROM checkout WHERE doc_id % 7 <> 0
              UNION ALL SELECT doc_id, concat(path, '.new') AS path, 'after' AS version, text FROM checkout WHERE doc_id % 50 = 3) x""",
    "runs": """
        SELECT run_id, started_ms, records, records % 7 = 0 AS merged, CAST(records % 3 AS INT) AS exit_code,
               concat('schema-', CASE WHEN records % 29 = 0 THEN '2' ELSE '3' END) AS schema_version,
               concat('i', CAST(records % 2 AS VARCHAR(5))) AS instrumenter, concat('s', substr(run_id, 6, 4)) AS source,
               concat('t', CAST(records % 4 AS VARCHAR(5))) AS tests_digest, concat('d', CAST(records % 3 AS VARCHAR(5))) AS dependencies,
               concat('c', substr(run_id, 5, 1)) AS configuration, concat('e', CAST(records % 5 AS VARCHAR(5))) AS execution,
               concat('m', CAST(records % 6 AS VARCHAR(5))) AS combined,
               CASE WHEN records % 4 = 1 THEN concat('run_A', substr(run_id, 6, 4)) END AS supersedes
        FROM (SELECT run_id, MIN(MS(l_shipdate)) AS started_ms, COUNT(*) AS records FROM line_records GROUP BY run_id) x""",
    "scope_entries": """
        SELECT path AS file, CASE WHEN doc_id % 6 = 0 THEN 'ambiguous' WHEN doc_id % 5 = 0 THEN 'excluded' ELSE 'included' END AS status,
               CASE WHEN doc_id % 6 = 0 THEN 'unclassified first-party source' WHEN doc_id % 5 = 0 THEN 'outside explicit source roots'
                    ELSE 'discovered package source root' END AS reason
        FROM paths""",
}

DEPENDENCIES = {
    name: [other for other in [*VIEWS, *BASE_TABLES] if other != name and re.search(rf"\b{other}\b", sql)]
    for name, sql in VIEWS.items()
}


def _call(sql: str, name: str, render) -> str:
    """Expand ``name(...)`` with balanced brackets."""
    while (match := re.search(rf"\b{name}\(", sql)) is not None:
        depth, at = 1, match.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        sql = sql[: match.start()] + render(sql[match.end() : at - 1]) + sql[at:]
    return sql


def spark_dialect(sql: str) -> str:
    sql = _call(sql, "MS", lambda arg: f"unix_millis(CAST({arg} AS TIMESTAMP))")
    sql = _call(sql, "EACH", lambda arg: f"explode(array({arg}))")
    return _call(sql, "SPAN", lambda arg: f"explode(sequence({arg}))")


def duckdb_dialect(sql: str) -> str:
    sql = _call(sql, "MS", lambda arg: f"(epoch_us({arg}) // 1000)")
    sql = _call(sql, "EACH", lambda arg: f"unnest([{arg}])")
    return _call(sql, "SPAN", lambda arg: "unnest(range({}, {} + 1))".format(*arg.split(",", 1)))


def _closure(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in seen:
            for other in DEPENDENCIES[name]:
                visit(other)
            seen.append(name)

    for name in names:
        visit(name)
    return seen


def oracle(body: str) -> str:
    """DuckDB text: the model views the body names, as CTEs, then the body.

    The body may start with ``WITH`` and further CTEs of its own.
    """
    names = _closure([name for name in VIEWS if re.search(rf"\b{name}\b", body)])
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in names]
    text = body.strip()
    recursive = ""
    if text.upper().startswith("WITH RECURSIVE"):
        recursive, text = "RECURSIVE ", text[len("WITH RECURSIVE"):].strip()
        ctes.append(text)
    elif text.upper().startswith("WITH"):
        ctes.append(text[len("WITH"):].strip())
    else:
        return duckdb_dialect((f"WITH {', '.join(ctes)} " if ctes else "") + text)
    return duckdb_dialect(f"WITH {recursive}" + ",\n".join(ctes))


# Tables an ingest writes once: those that take a join or an aggregation to make.
# The others are projections of the given tables and read them in every query.
INGESTED = {
    "run_files", "points", "alternatives", "decisions", "tests", "records", "phases", "windows", "served", "changed", "limitations",
    "executions", "statement_answers", "runs",
}


class Model:
    """The model's tables as DataFrames, one lazily planned frame per name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        require_utc(spark)
        size_as_rows(spark)
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in BASE_TABLES:
                self._frames[name] = self._read(name)
            else:
                needs = DEPENDENCIES[name]
                text = spark_dialect(VIEWS[name])
                for other in needs:
                    text = re.sub(rf"\b(FROM|JOIN)(\s+){other}\b", rf"\1\2{{{other}}}", text)
                made = self.spark.sql(text, **{other: self.table(other) for other in needs})
                self._frames[name] = stored(self.spark, self.sf_dir, name, lambda: made) if name in INGESTED else made
        return self._frames[name]

    __getattr__ = table

    def _read(self, name: str) -> DataFrame:
        """A given table."""
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def vectors_(self) -> DataFrame:
        """Vectors with their values as one array, the library's own shape."""
        return self.table("vectors").select(
            "run_id", "test_id", "decision_id", "seq", "outcome",
            F.slice(F.array("a", "b", "c"), 1, F.col("width")).alias("vals"),
        )

    @property
    def decisions_(self) -> DataFrame:
        return self.table("decisions").withColumnRenamed("width", "conditions")

    @property
    def branches_(self) -> DataFrame:
        return self.table("alternatives").unionByName(self.table("outcome_alternatives"))

    @property
    def all_hits(self) -> DataFrame:
        return self.table("hits").unionByName(self.table("branch_hits"))

    @property
    def evidence(self) -> tuple[DataFrame, ...]:
        """Points, branches, decisions, hits and vectors as a summary takes them:
        with the outcome branches decisions do not declare, and the hits their
        vectors make on them."""
        branches = stored(self.spark, self.sf_dir, "all_branches", lambda: coverage.with_outcome_branches(self.branches_, self.decisions_))
        made = lambda: coverage.outcome_hits(self.vectors_, self.decisions_, self.branches_)
        hits = stored(self.spark, self.sf_dir, "all_hits", lambda: self.all_hits.select("run_id", "test_id", "hit_id", "seq").unionByName(made()))
        return self.points, branches, self.decisions_, hits, self.vectors_

    @property
    def tests_(self) -> DataFrame:
        """Tests with their tags split."""
        return self.table("tests").withColumn("tags", F.filter(F.split("tags_csv", ","), lambda t: t != ""))
