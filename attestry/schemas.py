"""Schemas of the evidence as it is written, field names included."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, LONG, BOOL, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


VECTOR = struct(values=T.ArrayType(BOOL), outcome=BOOL)
SCOPE = struct(version=INT, runId=STRING, workerId=STRING, testId=STRING, testKey=STRING, retry=INT, attemptId=STRING)
PHASE = struct(
    id=STRING, testId=STRING, kind=STRING, operation=STRING, source=STRING, causedByPhaseId=STRING,
    startedAtMs=LONG, endedAtMs=LONG, status=STRING, error=STRING,
)
EVENT = struct(type=STRING, id=STRING, vector=VECTOR, timestampMs=LONG, phaseId=STRING, environment=STRING)
SNAPSHOT = struct(
    hits=T.ArrayType(STRING), decisions=T.ArrayType(struct(id=STRING, vectors=T.ArrayType(VECTOR))), phaseId=STRING, events=T.ArrayType(EVENT),
)
PROVENANCE = struct(runner=STRING, kind=STRING, project=STRING, source=STRING, tags=T.ArrayType(STRING))
RECORD = struct(
    testId=STRING, test=STRING, testFile=STRING, title=STRING, retry=INT, status=STRING, expectedStatus=STRING, flaky=BOOL, role=STRING,
    attribution=STRING, provenance=PROVENANCE, scope=SCOPE, phases=T.ArrayType(PHASE), runtime=T.ArrayType(SNAPSHOT), browser=T.ArrayType(SNAPSHOT),
)
SERVER_RECORD = struct(type=STRING, vector=VECTOR, id=STRING, timestampMs=LONG, phaseId=STRING, scope=SCOPE, request=LONG, process=STRING)
POINT = struct(id=STRING, kind=STRING, file=STRING, line=INT, column=INT, source=STRING, label=STRING)
ALTERNATIVE = struct(id=STRING, label=STRING)
BRANCH = struct(id=STRING, kind=STRING, file=STRING, line=INT, column=INT, source=STRING, alternatives=T.ArrayType(ALTERNATIVE))
DECISION = struct(id=STRING, file=STRING, line=INT, column=INT, source=STRING, conditions=T.ArrayType(STRING), kind=STRING)
LIMITATION = struct(
    id=STRING, kind=STRING, file=STRING, line=INT, column=INT, source=STRING, reason=STRING, blocking=BOOL, wholeFile=BOOL,
)
SCOPE_ENTRY = struct(file=STRING, status=STRING, reason=STRING, packageRoot=STRING)
MANIFEST = struct(
    runId=STRING, points=T.ArrayType(POINT), branches=T.ArrayType(BRANCH), decisions=T.ArrayType(DECISION), unmeasured=T.ArrayType(STRING),
    limitations=T.ArrayType(LIMITATION), scope=struct(entries=T.ArrayType(SCOPE_ENTRY)),
)
RUN = struct(
    id=STRING, startedAt=STRING, durationMs=DOUBLE, command=T.ArrayType(STRING), testExitCode=INT, merged=BOOL, parents=T.ArrayType(STRING),
    supersedes=T.ArrayType(STRING), recordedBy=STRING,
)
# Event columns: an id is text, or the position of a hit; ids are read as text.
EVENT_COLUMNS = struct(
    types=T.ArrayType(STRING), phases=T.ArrayType(STRING), environments=T.ArrayType(STRING), id=T.ArrayType(STRING), type=T.ArrayType(INT),
    phase=T.ArrayType(INT), environment=T.ArrayType(INT), t=T.ArrayType(LONG), vector=T.MapType(INT, VECTOR),
)
ASSESSED_FILE = struct(
    snapshot=STRING, path=STRING, bytes=LONG, sha256=STRING, status=STRING, health=DOUBLE, checks=T.MapType(STRING, DOUBLE), error=STRING,
)
