"""Phases, crediting by time, served tests, repeated executions, confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import timing
from attestry.plans.catalog import query
from attestry.plans.model import Model

O_PHASED = """
  ph AS (SELECT *, lag(id) OVER w AS pid, lag(started_at_ms) OVER w AS ps, lag(ended_at_ms) OVER w AS pe
    FROM phases WINDOW w AS (PARTITION BY run_id, test_id ORDER BY started_at_ms, id)),
  cand AS (SELECT e.run_id, e.test_id, e.event_id, e.timestamp_ms, e.environment, e.own_phase_id, p.id, p.started_at_ms, p.pid, p.ps, p.pe,
      row_number() OVER (PARTITION BY e.event_id ORDER BY p.started_at_ms DESC NULLS LAST, p.id DESC) AS rn
    FROM runtime_events e LEFT JOIN ph p ON p.run_id = e.run_id AND p.test_id = e.test_id AND p.started_at_ms <= e.timestamp_ms),
  placed AS (SELECT run_id, test_id, event_id, environment, own_phase_id IS NOT NULL AS explicit, coalesce(own_phase_id,
      CASE WHEN started_at_ms = timestamp_ms AND pe = timestamp_ms AND ps < timestamp_ms THEN pid ELSE id END) AS phase_id FROM cand WHERE rn = 1)"""


@query("event_phase", f"WITH {O_PHASED} SELECT run_id, test_id, event_id, phase_id, explicit FROM placed")
def event_phase(m: Model):
    return timing.phase_of_events(m.runtime_events, m.phases).select("run_id", "test_id", "event_id", "phase_id", "explicit")


@query("phase_event_counts", f"""WITH {O_PHASED}
  SELECT p.run_id, p.test_id, p.phase_id, d.kind, count(*) FILTER (environment = 'browser' AND explicit) AS explicit_browser_events,
    count(*) FILTER (environment = 'browser' AND NOT explicit) AS inferred_browser_events,
    count(*) FILTER (environment = 'server' AND explicit) AS explicit_server_events,
    count(*) FILTER (environment = 'server' AND NOT explicit) AS inferred_server_events
  FROM placed p JOIN phases d ON d.run_id = p.run_id AND d.test_id = p.test_id AND d.id = p.phase_id GROUP BY ALL""")
def phase_event_counts(m: Model):
    return timing.phase_event_counts(m.runtime_events, m.phases)


@query("phase_hand_over", """
  SELECT run_id, test_id, id, lag(id) OVER w AS prev_id, lag(ended_at_ms) OVER w AS prev_ended_at_ms, lag(started_at_ms) OVER w AS prev_started_at_ms
  FROM phases WINDOW w AS (PARTITION BY run_id, test_id ORDER BY started_at_ms, id)""")
def phase_hand_over(m: Model):
    from attestry.operators.ordered import previous

    return previous(m.phases, ["run_id", "test_id"], "started_at_ms", ["started_at_ms", "id"], ["id", "ended_at_ms", "started_at_ms"]).select(
        "run_id", "test_id", "id", "prev_id", "prev_ended_at_ms", "prev_started_at_ms")


O_OWNED = """
  owned AS (SELECT b.run_id, b.record_id, b.request, b.timestamp_ms, b.process, b.hit_id,
      count(w.attempt_id) AS running, min(w.attempt_id) AS one
    FROM background b LEFT JOIN windows w ON w.run_id = b.run_id AND b.request IS NOT NULL AND b.timestamp_ms BETWEEN w.start_ms AND w.end_ms
      AND (NOT EXISTS (SELECT 1 FROM served s WHERE s.process = b.process)
           OR EXISTS (SELECT 1 FROM served s WHERE s.process = b.process AND s.attempt_id = w.attempt_id))
    GROUP BY ALL)"""


@query("credit_by_time", f"WITH {O_OWNED} SELECT run_id, record_id, running AS owner_count, CASE WHEN running = 1 THEN one END AS owner FROM owned")
def credit_by_time(m: Model):
    return timing.owners_by_time(m.background, m.windows, m.served).select("run_id", "record_id", "owner_count", "owner")


@query("unattributed_work", f"WITH {O_OWNED} SELECT DISTINCT run_id, timestamp_ms, process, hit_id FROM owned WHERE running <> 1")
def unattributed_work(m: Model):
    return timing.unattributed(timing.owners_by_time(m.background, m.windows, m.served))


@query("owner_among_served", """
  WITH r AS (SELECT b.record_id, b.run_id, count(w.attempt_id) AS n, min(w.test_id) AS t FROM background b
    LEFT JOIN windows w ON w.run_id = b.run_id AND b.timestamp_ms BETWEEN w.start_ms AND w.end_ms GROUP BY ALL)
  SELECT run_id, record_id, CASE WHEN n = 1 THEN t END AS test_id FROM r""")
def owner_among_served(m: Model):
    from attestry.operators.ordered import sole_container

    found = sole_container(m.background, m.windows, ["run_id"], "timestamp_ms", "start_ms", "end_ms", "attempt_id")
    return found.select("run_id", "record_id", F.substring_index("owner", "@", 1).alias("test_id"))


@query("server_record_join", """
  WITH s AS (SELECT DISTINCT run_id, test_id, retry, hit_id FROM records),
  a AS (SELECT run_id, test_id, retry, min(seq) AS attempt_seq FROM records WHERE status <> 'unknown' GROUP BY ALL)
  SELECT s.run_id, s.test_id, s.retry, s.hit_id, a.attempt_seq FROM s LEFT JOIN a ON a.run_id = s.run_id AND a.test_id = s.test_id AND a.retry = s.retry""")
def server_record_join(m: Model):
    return timing.join_server_records(
        m.records.select("run_id", "test_id", "retry", "hit_id"), m.records.filter("status <> 'unknown'"), ["run_id", "test_id", "retry"])


BLOCK = 21_600_000


def transports(m: Model):
    cut = m.event_times.withColumn("transport", F.concat("run_id", F.lit("/"), ((F.col("ms") / BLOCK).cast("long")).cast("string")))
    starts = cut.filter("event_type <> 'error'").select("transport", F.col("event_id").alias("seq"), F.col("test_id").alias("attempt"))
    requests = cut.filter("event_type = 'error'").select("transport", F.col("event_id").alias("seq"))
    return starts, requests


O_TRANSPORTS = f"""
  tr AS (SELECT run_id || '/' || CAST(ms // {BLOCK} AS VARCHAR) AS transport, event_id AS seq, test_id AS attempt, event_type FROM event_times),
  starts AS (SELECT * FROM tr WHERE event_type <> 'error'),
  steps AS (SELECT *, attempt IS DISTINCT FROM lag(attempt) OVER (PARTITION BY transport ORDER BY seq, attempt) AS turn FROM starts),
  mixed AS (SELECT transport, count(*) FILTER (turn) > count(DISTINCT attempt) AS interleaved FROM steps GROUP BY transport)"""


@query("interleaved_attempts", f"WITH {O_TRANSPORTS} SELECT transport, interleaved FROM mixed")
def interleaved_attempts(m: Model):
    return timing.interleaved(transports(m)[0])


@query("in_process_owner", f"""WITH {O_TRANSPORTS}
  SELECT q.transport, q.seq, CASE WHEN NOT coalesce(x.interleaved, FALSE) THEN
     (SELECT arg_max(s.attempt, s.seq) FROM starts s WHERE s.transport = q.transport AND s.seq < q.seq) END AS owner
  FROM tr q LEFT JOIN mixed x ON x.transport = q.transport WHERE q.event_type = 'error'""")
def in_process_owner(m: Model):
    starts, requests = transports(m)
    return timing.in_process_owners(requests, starts)


@query("support_reach", """
  WITH loads AS (SELECT DISTINCT run_id, process, 'src/' || hit_id || '.ts' AS file FROM background),
  alone AS (SELECT b.run_id, b.process, b.record_id, count(w.attempt_id) AS n, min(w.attempt_id) AS attempt_id FROM background b
     JOIN windows w ON w.run_id = b.run_id AND b.timestamp_ms BETWEEN w.start_ms AND w.end_ms WHERE b.request IS NULL GROUP BY ALL),
  who AS (SELECT run_id, process, attempt_id FROM served UNION SELECT run_id, process, attempt_id FROM alone WHERE n = 1),
  t AS (SELECT DISTINCT who.run_id, who.process, w.test_id FROM who JOIN windows w ON w.run_id = who.run_id AND w.attempt_id = who.attempt_id)
  SELECT DISTINCT l.file, t.test_id FROM loads l JOIN t ON t.run_id = l.run_id AND t.process = l.process""")
def support_reach(m: Model):
    loads = m.background.select("run_id", "process", F.concat(F.lit("src/"), "hit_id", F.lit(".ts")).alias("file")).distinct()
    return timing.support_reach(loads, m.served, m.background.filter("request is null"), m.windows)


@query("support_reach_union", """
  WITH x AS (SELECT DISTINCT run_id, hit_id AS file, process AS test_id FROM background) SELECT file, count(DISTINCT test_id) AS tests FROM x GROUP BY file""")
def support_reach_union(m: Model):
    reach = m.background.select("run_id", F.col("hit_id").alias("file"), F.col("process").alias("test_id"))
    return reach.select("file", "test_id").distinct().groupBy("file").agg(F.count(F.lit(1)).alias("tests"))


def repeated_phases(m: Model):
    """Days as records; some phases have a name that a repeat of another would be given."""
    own = F.concat("test_id", F.lit("#"), "event_type", F.when(F.col("event_id") % 11 == 0, "~2").when(F.col("event_id") % 13 == 0, "~4").otherwise(""))
    return m.event_times.select("run_id", F.col("day_ms").alias("record_seq"), own.alias("id")).distinct()


# The records of a run one after another: what is declared decides the next one.
@query("repeated_executions", """WITH RECURSIVE
  pr AS (SELECT DISTINCT run_id, day_ms AS record_seq, test_id || '#' || event_type || CASE WHEN event_id % 11 = 0 THEN '~2' WHEN event_id % 13 = 0 THEN '~4' ELSE '' END AS id FROM event_times),
  re AS (SELECT run_id, record_seq, list(id ORDER BY id) AS ids, row_number() OVER (PARTITION BY run_id ORDER BY record_seq) AS k FROM pr GROUP BY run_id, record_seq),
  go AS (
    SELECT run_id, 0::BIGINT AS k, 0::BIGINT AS record_seq, []::VARCHAR[] AS ids, []::VARCHAR[] AS fresh, []::VARCHAR[] AS declared FROM (SELECT DISTINCT run_id FROM re)
    UNION ALL
    SELECT run_id, k, record_seq, ids, fresh, list_concat(declared, fresh) FROM (
      SELECT go.run_id, re.k, re.record_seq, re.ids, go.declared, CASE WHEN NOT list_has_any(go.declared, re.ids) THEN re.ids
        ELSE list_transform(re.ids, lambda i: i || '~' || CAST(list_filter(range(2, 3 + len(go.declared)), lambda n: NOT list_contains(go.declared, i || '~' || CAST(n AS VARCHAR)))[1] AS VARCHAR)) END AS fresh
      FROM go JOIN re ON re.run_id = go.run_id AND re.k = go.k + 1))
  SELECT run_id, record_seq, unnest(ids) AS id, unnest(fresh) AS fresh_id FROM go WHERE k > 0""")
def repeated_executions(m: Model):
    return timing.separate_repeats(repeated_phases(m)).select("run_id", "record_seq", "id", "fresh_id")


@query("leaked_phases", """
  WITH p AS (SELECT DISTINCT run_id, test_id AS record_seq, id AS phase_id FROM phases),
  e AS (SELECT run_id, test_id AS record_seq, event_id, CASE WHEN event_id % 5 = 0 THEN 'ph' || (event_id // 2) ELSE own_phase_id END AS phase_id FROM runtime_events),
  l AS (SELECT e.*, o.phase_id IS NULL AND d.phase_id IS NOT NULL AS leaked FROM e LEFT JOIN p o ON o.run_id = e.run_id AND o.record_seq = e.record_seq AND o.phase_id = e.phase_id
     LEFT JOIN (SELECT DISTINCT run_id, phase_id FROM p) d ON d.run_id = e.run_id AND d.phase_id = e.phase_id)
  SELECT run_id, record_seq, event_id, CASE WHEN NOT leaked THEN phase_id END AS phase_id, leaked FROM l""")
def leaked_phases(m: Model):
    phases = m.phases.withColumn("record_seq", F.col("test_id"))
    events = m.runtime_events.select(
        "run_id", F.col("test_id").alias("record_seq"), "event_id",
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("ph"), F.floor(F.col("event_id") / 2).cast("string"))).otherwise(F.col("own_phase_id")).alias("phase_id"),
    )
    return timing.release_leaked(events, phases)


O_PLACES = """
  pl AS (SELECT 'k' || CAST(p_partkey // 100 AS VARCHAR) AS key, CAST(p_partkey % 100 AS INT) AS place, 'p' || p_partkey AS id FROM part)"""


@query("probe_places", f"""WITH {O_PLACES},
  h AS (SELECT run_id, test_id, CASE WHEN substr(hit_id, 1, 1) = 'p' THEN 'k' || CAST(CAST(substr(hit_id, 2) AS BIGINT) // 100 AS VARCHAR) END AS key,
      CASE WHEN substr(hit_id, 1, 1) = 'p' THEN CAST(CAST(substr(hit_id, 2) AS BIGINT) % 100 AS INT) END AS place, hit_id AS raw FROM hits),
  r AS (SELECT run_id, test_id, coalesce(pl.id, h.raw) AS hit_id FROM h LEFT JOIN pl ON pl.key = h.key AND pl.place = h.place
    UNION ALL SELECT run_id, test_id, pl.id FROM h JOIN pl ON pl.key = h.key AND pl.place = h.place + 1 WHERE h.place % 10 = 2)
  SELECT run_id, test_id, hit_id, count(*) AS hits FROM r GROUP BY ALL""")
def probe_places(m: Model):
    key, place = F.concat(F.lit("k"), F.floor(F.col("n") / 100).cast("string")), (F.col("n") % 100).cast("int")
    places = m.part.select(F.col("p_partkey").alias("n")).select(key.alias("key"), place.alias("place"), F.concat(F.lit("p"), F.col("n").cast("string")).alias("id"))
    follows = places.filter("place % 10 = 3").select("key", "place", (F.col("place") - 1).alias("leader"))
    hits = m.hits.withColumn("n", F.substring("hit_id", 2, 20).cast("long")).select(
        "run_id", "test_id",
        F.when(F.col("hit_id").startswith("p"), F.concat(F.lit("~p"), key, F.lit("."), place.cast("string"))).otherwise(F.col("hit_id")).alias("hit_id"),
    )
    return timing.resolve_places(hits, places, follows).groupBy("run_id", "test_id", "hit_id").agg(F.count(F.lit(1)).alias("hits"))


# Fixed mapping for this query: the phase an observation fell in, by its place in its record.
O_RELATIONS = """
  rel AS (SELECT h.run_id, h.hit_id AS id, t.role, t.kind, t.runner, h.seq % 4 = 3 AS explicit,
     CASE h.seq % 10 WHEN 1 THEN 'setup' WHEN 2 THEN 'background' WHEN 3 THEN 'action' WHEN 4 THEN 'test' END AS phase_kind
   FROM hits h JOIN tests t ON t.run_id = h.run_id AND t.test_id = h.test_id),
  conf AS (SELECT run_id, id, CASE WHEN coalesce(bool_or(phase_kind = 'action' AND explicit), FALSE) THEN 'action' ELSE 'executed' END AS level,
    CASE WHEN count(phase_kind) > 0 THEN bool_and(phase_kind = 'setup') ELSE bool_and(role = 'setup') END AS setup_only,
    CASE WHEN count(phase_kind) > 0 THEN bool_and(phase_kind = 'background') ELSE bool_and(role = 'background') END AS background_only,
    bool_or(kind = 'e2e') AS e2e, count(DISTINCT kind) AS kinds, count(DISTINCT runner) AS runners FROM rel GROUP BY ALL)"""


def relations(m: Model):
    n = F.col("seq") % 10
    phase = F.when(n == 1, "setup").when(n == 2, "background").when(n == 3, "action").when(n == 4, "test")
    return m.hits.join(m.tests.select("run_id", "test_id", "role", "kind", "runner"), ["run_id", "test_id"]).select(
        "run_id", F.col("hit_id").alias("id"), "role", "kind", "runner", phase.alias("phase_kind"), (F.col("seq") % 4 == 3).alias("explicit"))


@query("confidence", f"WITH {O_RELATIONS} SELECT * FROM conf")
def confidence(m: Model):
    return timing.confidence(relations(m))


@query("confidence_lines", f"""WITH {O_RELATIONS},
  l AS (SELECT p.run_id, p.file, p.line, max(CASE c.level WHEN 'action' THEN 2 WHEN 'executed' THEN 1 ELSE 0 END) AS r
    FROM points p LEFT JOIN conf c ON c.run_id = p.run_id AND c.id = p.id WHERE NOT p.declined GROUP BY ALL)
  SELECT run_id, CASE r WHEN 2 THEN 'action' WHEN 1 THEN 'executed' ELSE 'unexecuted' END AS level, count(*) AS lines FROM l GROUP BY ALL""")
def confidence_lines(m: Model):
    return timing.confidence_lines(m.points, timing.confidence(relations(m)))
