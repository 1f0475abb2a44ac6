"""Repeated passages by a logarithmic family of suffix indexes.

A string of ``LENGTH`` bytes is represented by the suffix that starts at its minimiser: of all ``HEAD``-byte heads
inside it, the one with the smallest hash, the first of several. Equal strings choose the same suffix, and
neighbouring strings mostly share theirs, so a text is cut into stretches of strings that share a suffix, about
one for 35 bytes. These sampled suffixes, sorted by their heads (in the order of the heads' hashes,
since only equality counts), are the sparse suffix array of a batch of documents.

Suffix arrays are dealt to shards by head. In each shard arrives one sorted array for each batch; it
is merge-scanned against the levels of the shard's index family, becomes a level, and levels of equal
size merge geometrically, so a suffix is moved a logarithmic number of times. Where heads meet, stretches
of equal bytes repeat as a whole: the later is marked. Where the bytes around differ, some strings may
still be equal: these stretches, few and mostly at the ends of repeats, are sent back to their texts, and
each of their strings is compared by its hash, again by shards. Heads, stretches and strings compare by
64-bit hashes.

What repeats inside a batch is settled there, and of a head with several stretches in a batch a shard
only hears that it has several. So a passage that a third of all documents share costs a shard a row a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import flat, mixed, parts_for, prefix_hashes, release_shuffles, ship_package, span_hashes, text_of, written

LENGTH, HEAD = 100, 32
#: Bytes that one numpy pass works on; longer texts are cut there, with the strings across the cut.
PIECE = 1 << 18
#: Bytes of text for each shard of the index, and of the comparison of strings.
SHARD_BYTES = 24 << 20
_PLACE = np.uint64((1 << 22) - 1)
MARK, ASK = 0, 1


def pieces(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of (row, first byte, end byte) with about PIECE bytes: texts, or parts of
    long ones that overlap so that every string lies in one part."""
    rows, begins, ends, total = [], [], [], 0
    for row in np.flatnonzero(np.diff(offsets) >= LENGTH):
        for first in range(int(offsets[row]), int(offsets[row + 1]) - LENGTH + 1, PIECE):
            end = min(int(offsets[row + 1]), first + PIECE + LENGTH - 1)
            rows.append(row), begins.append(first), ends.append(end)
            total += end - first
            if total >= PIECE:
                yield np.array(rows), np.array(begins), np.array(ends)
                rows, begins, ends, total = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(begins), np.array(ends)


def stretches(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of all texts of a batch: row, place of the first string, number of strings, the head's place
    in the first string, head and content (hashes) of every stretch."""
    out: dict[str, list[np.ndarray]] = {name: [] for name in ("row", "start", "n", "offset", "head", "content")}
    width = LENGTH - HEAD + 1
    for rows, begins, ends in pieces(offsets):
        sizes = ends - begins
        at = np.concatenate([[0], np.cumsum(sizes)])
        text = np.concatenate([data[a:b] for a, b in zip(begins, ends)])
        sums = prefix_hashes(text)
        places = np.arange(len(text) - HEAD + 1)
        heads = span_hashes(sums, places, places + HEAD)
        least = (heads & ~_PLACE) | places.astype(np.uint64)
        reach = 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        valid = np.repeat(np.arange(len(sizes)), sizes - LENGTH + 1)
        string = np.arange(len(valid)) - np.repeat(np.cumsum(sizes - LENGTH + 1) - (sizes - LENGTH + 1), sizes - LENGTH + 1) + at[valid]
        anchor = (least[string] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])]))
        n = np.diff(np.append(first, len(valid)))
        start, chosen = string[first], anchor[first]
        content = mixed(span_hashes(sums, start, start + n + LENGTH - 1) + (chosen - start + 1).astype(np.uint64))
        out["row"].append(rows[valid[first]])
        out["start"].append(start - at[valid[first]] + begins[valid[first]] - offsets[rows[valid[first]]])
        out["n"].append(n)
        out["offset"].append(chosen - start)
        out["head"].append(heads[chosen])
        out["content"].append(content)
    kinds = {"head": np.uint64, "content": np.uint64}
    return {name: np.concatenate(parts) if parts else np.zeros(0, kinds.get(name, np.int64)) for name, parts in out.items()}


def order_of(*keys: np.ndarray) -> np.ndarray:
    """Sorting order by the first key, then the next."""
    return np.lexsort(keys[::-1])


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return new


def home_of(head: np.ndarray) -> np.ndarray:
    """Part of a head's hash by which its strings find their shard."""
    return (head >> np.uint64(33)).astype(np.int64)


def stacked(*columns: np.ndarray) -> np.ndarray:
    return np.stack([c.astype(np.int64) for c in columns])


FIELDS = ("head", "content", "doc", "tie", "start", "n", "offset", "several")


class Family:
    """The levels of one shard: arrays sorted by head, one suffix for each head."""

    def __init__(self):
        self.levels: list[dict[str, np.ndarray]] = []
        self.marks: list[np.ndarray] = []
        self.asked: list[np.ndarray] = []

    def tell(self, to: list[np.ndarray], rows: dict[str, np.ndarray], which: np.ndarray) -> None:
        if which.any():
            to.append(stacked(rows["doc"][which], rows["tie"][which], rows["start"][which], rows["n"][which], rows["offset"][which], home_of(rows["head"][which])))

    def add(self, batch: dict[str, np.ndarray]) -> None:
        """Scan a sorted batch against every level, then make it one."""
        for level in self.levels:
            at = np.minimum(np.searchsorted(level["head"], batch["head"]), len(level["head"]) - 1)
            met = np.flatnonzero(level["head"][at] == batch["head"])
            self.meet(level, at[met], batch, met)
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-1]["head"]) * 2 > len(self.levels[-2]["head"]):
            a, b = self.levels.pop(), self.levels.pop()
            both = {name: np.concatenate([b[name], a[name]]) for name in FIELDS}
            # The earlier level's suffix comes first and stands for a head that both have.
            order = np.argsort(both["head"], kind="stable")
            keep = order[changes(both["head"][order])]
            self.levels.append({name: values[keep] for name, values in both.items()})

    def meet(self, level: dict[str, np.ndarray], at: np.ndarray, batch: dict[str, np.ndarray], new: np.ndarray) -> None:
        """Suffixes of a level and of a batch with equal heads. Of equal stretches the later is
        marked and the earlier stays in the level; unequal ones ask for their strings."""
        several = level["several"][at] | batch["several"][new] | (level["content"][at] != batch["content"][new])
        silent = at[several & ~level["several"][at]]
        self.tell(self.asked, level, np.isin(np.arange(len(level["head"])), silent))
        self.tell(self.asked, batch, np.isin(np.arange(len(batch["head"])), new[several & ~batch["several"][new]]))
        level["several"][at[several]] = True
        batch["several"][new[several]] = True
        a, b = at[~several], new[~several]
        later = (batch["doc"][b] > level["doc"][a]) | (batch["doc"][b] == level["doc"][a]) & ((batch["tie"][b] > level["tie"][a]) | (batch["tie"][b] == level["tie"][a]) & (batch["start"][b] >= level["start"][a]))
        same = (batch["tie"][b] == level["tie"][a]) & (batch["start"][b] == level["start"][a]) & (batch["doc"][b] == level["doc"][a])
        self.tell(self.marks, batch, np.isin(np.arange(len(batch["head"])), b[later & ~same]))
        self.tell(self.marks, level, np.isin(np.arange(len(level["head"])), a[~later]))
        for name in ("doc", "tie", "start", "n", "offset"):
            level[name][a[~later]] = batch[name][b[~later]]
            batch[name][b[later]] = level[name][a[later]]


PACKED = "shard int, head binary, content binary, doc binary, tie binary, start binary, n binary, offset binary, several binary, told binary"
ARROW_PACKED = pa.schema([("shard", pa.int32()), *[(n, pa.binary()) for n in ("head", "content", "doc", "tie", "start", "n", "offset", "several", "told")]])
FOUND = "kind byte, doc long, tie int, start int, n int, offset int, home int"
ARROW_FOUND = pa.schema([("kind", pa.int8()), ("doc", pa.int64()), ("tie", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("offset", pa.int32()), ("home", pa.int32())])


def batch_rows(batch: pa.RecordBatch, shards: int) -> Iterator[dict[str, object]]:
    """The suffix array of a batch, packed for every shard, with what is settled already."""
    data, offsets = flat(batch.column("text"))
    rows = stretches(data, offsets)
    doc = batch.column("doc").to_numpy(zero_copy_only=False)[rows["row"]]
    tie = batch.column("tie").to_numpy(zero_copy_only=False)[rows["row"]]
    order = order_of(rows["head"], rows["content"], doc, tie, rows["start"])
    head, content, start, n, offset = (rows[name][order] for name in ("head", "content", "start", "n", "offset"))
    doc, tie = doc[order], tie[order]
    lead = changes(head, content)
    leader = np.maximum.accumulate(np.where(lead, np.arange(len(head)), 0))
    # The same place of the same document, read twice, is no repeat.
    repeat = ~lead & ~((doc == doc[leader]) & (tie == tie[leader]) & (start == start[leader]))
    told = [stacked(np.full(int(repeat.sum()), MARK), doc[repeat], tie[repeat], start[repeat], n[repeat], offset[repeat], home_of(head[repeat]))]
    head, content, start, n, offset, doc, tie = (values[lead] for values in (head, content, start, n, offset, doc, tie))
    new = changes(head)
    group = np.cumsum(new) - 1
    several = np.bincount(group, minlength=int(new.sum()))[group] > 1 if len(group) else np.zeros(0, bool)
    told.append(stacked(np.full(int(several.sum()), ASK), doc[several], tie[several], start[several], n[several], offset[several], home_of(head[several])))
    told = np.concatenate(told, axis=1)
    head, content, start, n, offset, doc, tie, several = (values[new] for values in (head, content, start, n, offset, doc, tie, several))
    shard = (head % np.uint64(shards)).astype(np.int64)
    where = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[where], np.arange(shards + 1))
    spread = np.linspace(0, told.shape[1], shards + 1).astype(int)
    for s in range(shards):
        own = where[bounds[s] : bounds[s + 1]]
        part = told[:, spread[s] : spread[s + 1]]
        if len(own) or part.shape[1]:
            yield {
                "shard": s, "head": head[own].tobytes(), "content": content[own].tobytes(), "doc": doc[own].astype(np.int64).tobytes(), "tie": tie[own].astype(np.int32).tobytes(),
                "start": start[own].astype(np.int32).tobytes(), "n": n[own].astype(np.uint8).tobytes(), "offset": offset[own].astype(np.uint8).tobytes(), "several": several[own].tobytes(), "told": np.ascontiguousarray(part).tobytes(),
            }


def found_table(parts: list[tuple[int, np.ndarray]]) -> pa.Table:
    if not parts:
        return pa.Table.from_pydict({name: [] for name in ARROW_FOUND.names}, schema=ARROW_FOUND)
    kind = np.concatenate([np.full(p.shape[1], k, np.int8) for k, p in parts])
    rows = np.concatenate([p.astype(np.int64) for _, p in parts], axis=1)
    return pa.table([pa.array(kind), pa.array(rows[0]), *(pa.array(rows[i].astype(np.int32)) for i in range(1, 6))], schema=ARROW_FOUND)


def scan_shard(table: pa.Table) -> pa.Table:
    family, parts = Family(), []
    kinds = {"head": np.uint64, "content": np.uint64, "doc": np.int64, "tie": np.int32, "start": np.int32, "n": np.uint8, "offset": np.uint8, "several": bool}
    columns = {name: table.column(name) for name in table.column_names}
    for i in range(table.num_rows):
        told = np.frombuffer(columns["told"][i].as_py(), np.int64).reshape(7, -1)
        parts += [(kind, told[1:, told[0] == kind]) for kind in (MARK, ASK)]
        batch = {name: np.frombuffer(columns[name][i].as_py(), kind).copy() for name, kind in kinds.items()}
        if len(batch["head"]):
            family.add(batch)
    parts += [(MARK, p) for p in family.marks] + [(ASK, p) for p in family.asked]
    return found_table(parts)


def joined_spans(docs: np.ndarray, ties: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(doc, tie, start, n) of runs of neighbouring strings."""
    order = order_of(docs, ties, starts)
    docs, ties, starts = docs[order].astype(np.int64), ties[order].astype(np.int64), starts[order].astype(np.int64)
    new = changes(docs, ties)
    new[1:] |= starts[1:] > starts[:-1] + 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(docs)) - 1
    nothing = np.zeros(len(first), np.int64)
    return np.stack([docs[first], ties[first], starts[first], starts[last] - starts[first] + 1, nothing, nothing]) if len(first) else np.zeros((6, 0), np.int64)


def later_strings(string: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order by string and place, and in that order which ones an earlier place has too."""
    order = order_of(string, doc, tie, start)
    lead = changes(string[order])
    leader = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
    again = ~lead & ~((doc[order] == doc[leader]) & (tie[order] == tie[leader]) & (start[order] == start[leader]))
    return order, again


def string_rows(batch: pa.RecordBatch, shards: int) -> Iterator[dict[str, object]]:
    """Hashes of all strings that a batch's texts are asked for, packed by shard. A shard is
    chosen by the head and by the head's place in the string, in eights, so neighbours mostly go
    together and are sent as a run."""
    data, offsets = flat(batch.column("text"))
    docs, ties = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("tie").to_numpy(zero_copy_only=False)
    strings, rows, starts, homes = [], [], [], []
    lists = batch.column("asked")
    bounds = lists.offsets.to_numpy()
    asked = {name: lists.values.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("start", "n", "offset", "home")}
    for row in range(batch.num_rows):
        own = slice(bounds[row], bounds[row + 1])
        n = asked["n"][own]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(asked["start"][own], n) + step
        home = np.repeat(asked["home"][own], n) * 16 + (np.repeat(asked["offset"][own], n) - step) // 8
        at, first = np.unique(at, return_index=True)
        home = home[first]
        low, high = int(at[0]), int(at[-1]) + LENGTH
        text = data[offsets[row] + low : offsets[row] + high]
        for a in range(0, len(text), PIECE):
            inside = (at - low >= a) & (at - low < a + PIECE)
            if inside.any():
                place = at[inside] - low - a
                strings.append(span_hashes(prefix_hashes(text[a : a + PIECE + LENGTH]), place, place + LENGTH))
                rows.append(np.full(len(place), row))
                starts.append(at[inside])
                homes.append(home[inside])
    if not strings:
        return
    string, row, start, home = (np.concatenate(x) for x in (strings, rows, starts, homes))
    order, again = later_strings(string, docs[row], ties[row], start)
    late, first = order[again], order[changes(string[order])]
    told = joined_spans(docs[row[late]], ties[row[late]], start[late])
    shard = (mixed(home[first].astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
    by = np.lexsort((start[first], row[first], shard))
    first, shard = first[by], shard[by]
    bounds = np.searchsorted(shard, np.arange(shards + 1))
    spread = np.linspace(0, told.shape[1], shards + 1).astype(int)
    for s in range(shards):
        own, part = first[bounds[s] : bounds[s + 1]], told[:, spread[s] : spread[s + 1]]
        if len(own) or part.shape[1]:
            new = changes(row[own])
            if len(own):
                new[1:] |= start[own][1:] != start[own][:-1] + 1
            begin = np.flatnonzero(new)
            lead = own[begin]
            yield {
                "shard": s, "string": string[own].tobytes(), "doc": docs[row[lead]].astype(np.int64).tobytes(), "tie": ties[row[lead]].astype(np.int32).tobytes(),
                "start": start[lead].astype(np.int32).tobytes(), "n": np.diff(np.append(begin, len(own))).astype(np.uint32).tobytes(), "told": np.ascontiguousarray(part).tobytes(),
            }


STRINGS = "shard int, string binary, doc binary, tie binary, start binary, n binary, told binary"
ARROW_STRINGS = pa.schema([("shard", pa.int32()), *[(n, pa.binary()) for n in ("string", "doc", "tie", "start", "n", "told")]])


def compare_strings(table: pa.Table) -> pa.Table:
    told = [np.frombuffer(v.as_py(), np.int64).reshape(6, -1) for v in table.column("told")]
    kinds = {"string": np.uint64, "doc": np.int64, "tie": np.int32, "start": np.int32, "n": np.uint32}
    rows = {name: np.concatenate([np.frombuffer(v.as_py(), kind) for v in table.column(name)]) for name, kind in kinds.items()}
    n = rows["n"].astype(np.int64)
    doc, tie, start = (np.repeat(rows[name], n) for name in ("doc", "tie", "start"))
    start = start + np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)
    order, again = later_strings(rows["string"], doc, tie, start)
    late = order[again]
    return found_table([(MARK, p) for p in told] + [(MARK, joined_spans(doc[late], tie[late], start[late]))])


def packed(source: DataFrame, make, shards: int, schema: str, arrow: pa.Schema) -> DataFrame:
    ship_package(source.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(make(batch, shards))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return source.mapInArrow(run, schema)


def repeated_strings(rows: DataFrame, total_bytes: int) -> DataFrame:
    """(doc, tie, start, n): runs of n strings from byte ``start`` on of a document that all start
    earlier too. ``rows``: doc and tie (its order), and text."""
    shards = parts_for(total_bytes, SHARD_BYTES)
    first = packed(rows, batch_rows, shards, PACKED, ARROW_PACKED)
    found = written(first.groupBy("shard").applyInArrow(scan_shard, FOUND), "found")
    release_shuffles(rows.sparkSession)
    asked = found.where(F.col("kind") == ASK).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n", "offset", "home")).alias("asked"))
    texts = rows.join(asked, ["doc", "tie"]).select("doc", "tie", "text", "asked")
    strings = packed(texts, string_rows, shards, STRINGS, ARROW_STRINGS)
    more = written(strings.groupBy("shard").applyInArrow(compare_strings, FOUND), "strings")
    release_shuffles(rows.sparkSession)
    return found.where(F.col("kind") == MARK).unionByName(more).select("doc", "tie", "start", "n")


def kept_text(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text without the spans (first byte, end byte), and how many
    separate runs they make."""
    left, at, runs, open_to = [], 0, 0, -1
    for first, end in sorted(spans):
        if first > open_to:
            left.append(text[at:first])
            runs += 1
        at = open_to = max(open_to, end)
    left.append(text[at:])
    return b"".join(left), runs


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans) for every row of ``docs``: the bytes of its
    text that no LENGTH-byte string covers which starts earlier too, by doc_id (null first), then by a 32-bit
    hash of the text, then by place.

    A null text is empty. Rows with equal doc_id and text are one document and answered alike. Texts under
    LENGTH bytes stay whole; an empty table gives no rows; other columns are not read. Kept bytes need not be
    whole characters."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    doc = F.coalesce("doc_id", F.lit(-(1 << 63)))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # Where ids tell all rows apart, ties need no hash, and rows are smaller for it.
    alike = rows.groupBy(doc.alias("doc")).count().where(F.col("count") > 1).limit(1).count()
    tie = F.hash(F.xxhash64("text")) if alike else F.lit(0)
    ordered = rows.select("doc_id", doc.alias("doc"), tie.alias("tie"), "text")
    marks = repeated_strings(ordered.drop("doc_id"), total).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    marked = ordered.join(marks, ["doc", "tie"], "left").select("doc_id", "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            kept, spans = [], []
            for row, marks in enumerate(batch.column("marks").to_pylist()):
                whole = data[offsets[row] : offsets[row + 1]].tobytes()
                left, runs = kept_text(whole, [(m["start"], m["start"] + m["n"] + LENGTH - 1) for m in marks or ()])
                kept.append(left)
                spans.append(runs)
            sizes = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes), pa.array(sizes - np.array([len(k) for k in kept], np.int64)), pa.array(spans, pa.int64())],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return marked.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op10_repeats(docs: DataFrame) -> DataFrame:
    return drop_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
