"""SentencePiece encoding and decoding by sampling distinct segmentations.

A text's lattice has an edge for every vocabulary piece that matches somewhere in it; a path from end to
end is a segmentation, and its probability is the normalised product of its pieces' weights. Gumbel
top-k without replacement draws k distinct paths: every path's log-probability is perturbed by a
standard Gumbel variable, and the k highest are emitted. They are found by an A-star search over
regions (paths that share a prefix and leave it by other edges than those already taken): the largest
perturbed value in a region is itself Gumbel, with the region's mass as location and truncated by
the value of the path taken out of it, so it can be drawn without looking inside. The region with the
highest value is opened next, its best path is drawn forward through the lattice, and the regions
along that path join the queue. Masses are exact: they come from sums over all completions.

Every random number is a hash of (seed, the row's key, the round, the place in the text), so results
do not depend on batches, partitions or retries. The (k+1)-th value is the threshold that gives each
path its inclusion probability in such a sample.

Pieces never cross most word ends, so sums over completions are taken once for each distinct stretch of
a pass over about half a megabyte of texts, for all stretches together in numpy. Texts do not move between
tasks. The vocabulary file is read by the driver and sent along (its size is fixed).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType

from attestry.llm.common import bytes_hashes, flat, mixed, passes, ship_package, with_fields

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
#: What a byte standing in for an unknown character costs beyond the rarest piece.
BYTE_PENALTY = 10.0
#: No standard Gumbel variable from 53 random bits is higher; places looked at first.
HIGHEST, EARLY = 38.0, 448
#: Bytes of text in a pass: about 210 MB of arrays.
PASS = 1 << 19
MARK = "▁"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Pieces as bytes (the blank mark as a blank), log weights, and a trie of them: up
    to two children of a node lie in ``few``, more in a row of 256."""

    pieces: list[bytes]
    weights: np.ndarray
    few: np.ndarray
    row_of: np.ndarray
    rows: np.ndarray
    piece_at: np.ndarray
    byte_ids: np.ndarray
    cuts: np.ndarray

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The children of the nodes by the bytes, -1 where there is none."""
        child = self.rows[self.row_of[node], byte]
        for j in (0, 2):
            hit = self.few[node, j] == byte
            child[hit] = self.few[node[hit], j + 1]
        return child


def build_vocabulary(entries: list[tuple[bytes, float]], byte_ids: list[int]) -> Vocabulary:
    """``entries``: bytes and score by id, an empty one for ids no text produces. Scores of
    the model fall by one from piece to piece, so a piece's rank is its score
    negated, and its weight follows Zipf's law, 1 / (rank + 2)."""
    ranks = np.array([2.0 - min(0.0, score) for _, score in entries])
    usable = np.array([bool(piece) for piece, _ in entries])
    weights = -np.log(ranks)
    weights -= np.log(np.exp(weights[usable]).sum())
    weights[byte_ids] = weights[usable & (ranks < 1e6)].min() - BYTE_PENALTY
    nodes: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for number, (piece, _) in enumerate(entries):
        node = 0
        for byte in piece:
            if byte not in nodes[node]:
                nodes[node][byte] = len(nodes)
                nodes.append({})
            node = nodes[node][byte]
        if piece:
            ends[node] = number
    piece_at = np.full(len(nodes), -1, np.int32)
    for node, number in ends.items():
        piece_at[node] = number
    few = np.full((len(nodes), 4), -1, np.int32)
    many = [node for node, kids in enumerate(nodes) if len(kids) > 2]
    row_of = np.zeros(len(nodes), np.int32)
    row_of[many] = np.arange(1, len(many) + 1)
    rows = np.full((len(many) + 1, 256), -1, np.int32)
    for node, kids in enumerate(nodes):
        if len(kids) > 2:
            rows[row_of[node], list(kids)] = list(kids.values())
        else:
            for j, (byte, child) in enumerate(kids.items()):
                few[node, 2 * j : 2 * j + 2] = byte, child
    longer = {b for piece, _ in entries if len(piece) > 1 for b in piece}
    cuts = np.array([b < 128 and b != 32 and b not in longer for b in range(256)])
    return Vocabulary([piece for piece, _ in entries], weights, few, row_of, rows, piece_at, np.array(byte_ids, np.int32), cuts)


def load_vocabulary(model: str = MODEL) -> Vocabulary:
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    entries, byte_ids = [], [0] * 256
    for number in range(processor.get_piece_size()):
        if processor.is_byte(number):
            byte_ids[int(processor.id_to_piece(number)[3:5], 16)] = number
        special = processor.is_byte(number) or processor.is_control(number) or processor.is_unknown(number)
        entries.append((b"" if special else processor.id_to_piece(number).replace(MARK, " ").encode(), processor.get_score(number)))
    vocabulary = build_vocabulary(entries, byte_ids)
    for byte, number in enumerate(byte_ids):
        vocabulary.pieces[number] = bytes([byte])
    return vocabulary


def decode(ids, pieces: list[bytes]) -> bytes:
    """The text of a piece sequence: the blank put before every text goes again."""
    return b"".join([pieces[i] for i in ids])[1:]


class Lattice:
    """Edges of all distinct stretches of a pass, with conditional probabilities."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray):
        """``data``: texts one after another, each with a blank before it."""
        self.weights = vocabulary.weights
        blank = data == 32
        starts = np.zeros(len(data), bool)
        starts[1:] = blank[1:] & ~blank[:-1]
        cut = vocabulary.cuts[data]
        starts |= cut
        starts[1:] |= cut[:-1]
        starts[offsets[:-1]] = True
        self.begins = np.flatnonzero(starts)
        ends = np.append(self.begins[1:], len(data))
        hashes = bytes_hashes(data, self.begins, ends)
        order = np.argsort(hashes)
        new = np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0
        first = order[new]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        lengths = (ends - self.begins)[first]
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        total = int(self.at[-1])
        owner = np.repeat(np.arange(len(first)), lengths)
        text = data[np.arange(total) - self.at[owner] + self.begins[first][owner]]
        stop = self.at[owner + 1]
        self.edges(vocabulary, text, stop)
        self.complete(stop, total)

    def edges(self, vocabulary: Vocabulary, text: np.ndarray, stop: np.ndarray) -> None:
        """Every match of a piece; single bytes where a character is no piece."""
        heads = (text & 0xC0) != 0x80
        heads[self.at[:-1]] = True
        here = np.flatnonzero(heads)
        char_end = np.minimum(np.append(here[1:], len(text)), stop[here])
        known = np.zeros(len(text), bool)
        end_of = np.zeros(len(text), np.int64)
        end_of[here] = char_end
        start, node, depth = here, np.zeros(len(here), np.int64), 0
        found = []
        while len(start):
            inside = start + depth < stop[start]
            start, node = start[inside], node[inside]
            child = vocabulary.step(node, text[start + depth])
            good = child >= 0
            start, node = start[good], child[good].astype(np.int64)
            depth += 1
            piece = vocabulary.piece_at[node]
            match = piece >= 0
            found.append((start[match], depth, piece[match]))
            known[start[match][end_of[start[match]] == start[match] + depth]] = True
        lone = here[~known[here]]
        widths = end_of[lone] - lone
        spread = np.repeat(lone, widths) + np.arange(int(widths.sum())) - np.repeat(np.cumsum(widths) - widths, widths)
        found.insert(0, (spread, 1, vocabulary.byte_ids[text[spread]]))
        counts = np.zeros(len(text), np.int32)
        for start, _, _ in found:
            counts[start] += 1
        # By distance to the stretch's end, then by place, shorter ones first: the order in which sums are taken.
        left = stop - np.arange(len(text))
        places = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        free = np.empty(len(text), np.int64)
        free[places] = np.cumsum(counts[places]) - counts[places]
        total = int(counts.sum())
        self.start, self.width, self.piece = np.empty(total, np.int64), np.empty(total, np.int16), np.empty(total, np.int32)
        for start, width, piece in found:
            slot = free[start]
            self.start[slot], self.width[slot], self.piece[slot] = start, width, piece
            free[start] += 1
        self.first_edge = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    def complete(self, stop: np.ndarray, total: int) -> None:
        """log of the weight of all ways from each place to its stretch's end, and each
        edge's probability among those of its place. ``stop`` places have none left."""
        weight = self.weights[self.piece]
        left = stop[self.start] - self.start
        behind = np.full(total + 1, -np.inf)
        ahead = self.start + self.width
        closing = ahead == stop[self.start]
        values = np.empty(len(self.start))
        levels = np.flatnonzero(np.diff(left, prepend=-1, append=-1))
        for a, b in zip(levels[:-1], levels[1:]):
            value = weight[a:b] + np.where(closing[a:b], 0.0, behind[ahead[a:b]])
            values[a:b] = value
            begin = np.flatnonzero(np.diff(self.start[a:b], prepend=-1))
            top = np.maximum.reduceat(value, begin)
            counts = np.diff(np.append(begin, b - a))
            behind[self.start[a:b][begin]] = np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts)), begin)) + top
        log_p = np.minimum(0.0, values - behind[self.start])
        # Edges by place, likelier ones first, with running probabilities.
        p = np.exp(log_p)
        order = np.argsort((self.start * (1 << 20) - (p * ((1 << 20) - 1)).astype(np.int64)) * 128 + self.width)
        self.start, self.width, self.piece, self.log_p = self.start[order], self.width[order], self.piece[order], log_p[order]
        self.closing = closing[order]
        sums = np.cumsum(p[order])
        before = np.concatenate([[0.0], sums])[self.first_edge[self.start]]
        self.running = np.minimum(1.0, sums - before)
        # The last edge of each place that has any.
        self.running[np.flatnonzero(np.diff(self.start, append=-1))] = 1.0

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """One edge for each place by its probability."""
        edge = self.first_edge[place]
        on = np.flatnonzero(u > self.running[edge])
        while len(on):
            edge[on] += 1
            on = on[u[on] > self.running[edge[on]]]
        return edge


def uniform(keys: np.ndarray, turn: int, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row's key, the round and the place alone."""
    bits = mixed(keys + _GOLD * (place.astype(np.uint64) + np.uint64(turn << 48)))
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@dataclass
class Found:
    """One sampled segmentation: its edges, log-probability and perturbed value."""

    edges: np.ndarray
    log_p: float
    value: float


def sample_pass(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
    """For each text of a pass its samples: (piece ids, log-probability, perturbed value,
    log inclusion probability), by falling value. An empty text has the empty
    segmentation alone."""
    rows = len(offsets) - 1
    lengths = np.diff(offsets)
    busy = lengths > 0
    shifted = offsets + np.concatenate([[0], np.cumsum(busy)])
    spaced = np.full(shifted[-1], 32, np.uint8)
    owner = np.repeat(np.arange(rows), lengths)
    spaced[np.arange(len(data)) - offsets[owner] + shifted[owner] + 1] = data
    if not busy.any():
        for _ in range(rows):
            yield [(np.zeros(0, np.int64), 0.0, 0.0, 0.0)]
        return
    busy_rows = np.flatnonzero(busy)
    lattice = Lattice(vocabulary, spaced, np.append(shifted[:-1][busy], len(spaced)))
    text_of_stretch = np.searchsorted(shifted, lattice.begins, side="right") - 1
    first_stretch = np.searchsorted(text_of_stretch, np.arange(rows + 1))
    place_of_stretch = lattice.at[lattice.which]
    found: list[list[Found]] = [[] for _ in range(rows)]
    queues: list[list[tuple]] = [[] for _ in range(rows)]
    root = -np.log(-np.log(uniform(keys, 255, np.zeros(rows))))
    # (row, prefix edges, first edge given or -1, place in the text to go on from, value)
    opened = [(int(r), None, -1, 0, float(root[r]), ()) for r in busy_rows]
    ordinal = 0
    for turn in range(k):
        walkers: list[np.ndarray] = []
        for row, prefix, edge, place, _, _ in opened:
            a, b = first_stretch[row], first_stretch[row + 1]
            inside = lattice.begins[a:b] - shifted[row]
            later = a + int(np.searchsorted(inside, place, side="left"))
            if edge >= 0 and not lattice.closing[edge]:
                walkers.append(np.array([[row], [place], [lattice.start[edge] + lattice.width[edge]]]))
            walkers.append(np.stack([np.full(b - later, row), lattice.begins[later:b] - shifted[row], place_of_stretch[later:b]]))
        row, place, at = np.concatenate(walkers, axis=1) if walkers else np.zeros((3, 0), np.int64)
        # Walkers stand in order of row and place, and each one's edges follow its steps.
        walker, row_of_walker, steps = np.arange(len(row)), row, []
        taken_by = np.zeros(len(row), np.int64)
        while len(row):
            edge = lattice.draw(at, uniform(keys[row], turn, place))
            steps.append((walker, edge))
            taken_by[walker] += 1
            more = ~lattice.closing[edge]
            width = lattice.width[edge]
            walker, row, place, at = walker[more], row[more], (place + width)[more], (at + width)[more]
        ends = np.cumsum(taken_by)
        edge = np.zeros(int(taken_by.sum()), np.int64)
        for number, (walker, chosen) in enumerate(steps):
            edge[(ends - taken_by)[walker] + number] = chosen
        bounds = np.concatenate([[0], ends])[np.searchsorted(row_of_walker, np.arange(rows + 1))]
        paths = []
        for r, prefix, given, _, value, taken in opened:
            tail = edge[bounds[r] : bounds[r + 1]]
            head = [] if prefix is None else [prefix]
            if given >= 0:
                head.append(np.array([given]))
            paths.append(np.concatenate([*head, tail]) if head else tail)
        flat_path = np.concatenate(paths) if paths else np.zeros(0, np.int64)
        sizes = np.array([len(p) for p in paths], np.int64)
        of = np.repeat(np.arange(len(paths)), sizes)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        log_p = lattice.log_p[flat_path]
        upto = np.cumsum(log_p)
        start_sum = np.concatenate([[0.0], upto])[begin[:-1]]
        before = upto - log_p - start_sum[of]
        inner = np.arange(len(flat_path)) - begin[:-1][of]
        limits, turn_keys = np.array([o[4] for o in opened]), keys[np.array([o[0] for o in opened], np.int64)]

        def drawn(at: np.ndarray) -> np.ndarray:
            """The largest perturbed value of the regions that leave a path at these places."""
            with np.errstate(divide="ignore", invalid="ignore"):
                mass = before[at] + np.log1p(-np.exp(log_p[at]))
                noise = np.log(-np.log(uniform(turn_keys[of[at]], 64 + turn, inner[at])))
                return np.where(mass > -np.inf, mass - np.logaddexp(mass - limits[of[at]], noise), -np.inf)

        # A value is at most the prefix's mass plus HIGHEST, so late places need no look
        # where enough early ones are higher. Paths where that isn't so are looked at whole.
        early = np.flatnonzero(inner < EARLY + np.array([0 if o[1] is None else len(o[1]) for o in opened], np.int64)[of])
        value = np.full(len(flat_path), -np.inf)
        value[early] = drawn(early)
        wanted, late = k - turn, []
        for i, o in enumerate(opened):
            own = 0 if o[1] is None else len(o[1]) + 1
            looked = own - 1 + EARLY if own else EARLY
            near = value[begin[i] + own : begin[i + 1]]
            if len(near) > EARLY and looked < begin[i + 1] - begin[i]:
                enough = np.partition(near, len(near) - wanted)[len(near) - wanted]
                if before[begin[i] + looked] + HIGHEST >= enough:
                    late.append(np.arange(begin[i] + looked, begin[i + 1]))
        if late:
            late = np.concatenate(late)
            value[late] = drawn(late)
        following = []
        for i, (r, prefix, given, _, bound, taken) in enumerate(opened):
            path, a, b = paths[i], begin[i], begin[i + 1]
            total = float(upto[b - 1] - start_sum[i])
            found[r].append(Found(path, total, bound))
            values = value[a:b]
            # Regions before the place where this path left another one belong to that one.
            own = 0 if prefix is None else len(prefix) + 1
            near = values[own:]
            best = np.argpartition(-near, wanted)[:wanted] if len(near) > wanted else np.arange(len(near))
            for j in best:
                if near[j] > -np.inf:
                    ordinal += 1
                    heapq.heappush(queues[r], (-float(near[j]), ordinal, path, own + int(j), (int(path[own + j]),)))
            if given >= 0:
                # The rest of the region just opened, without the edge now taken too.
                left = taken + (given,)
                e = lattice.start[given]
                others = [x for x in range(lattice.first_edge[e], lattice.first_edge[e + 1]) if x not in left]
                if others:
                    prefix_mass = float(lattice.log_p[prefix].sum()) if len(prefix) else 0.0
                    rest = prefix_mass + float(np.log(np.exp(lattice.log_p[others]).sum())) if np.exp(lattice.log_p[others]).sum() > 0 else -np.inf
                    if rest > -np.inf:
                        u = float(uniform(keys[r : r + 1], 128 + turn, np.zeros(1))[0])
                        ordinal += 1
                        heapq.heappush(queues[r], (-float(rest - np.logaddexp(rest - bound, np.log(-np.log(u)))), ordinal, path, len(prefix), left))
            if queues[r] and turn + 1 < k:
                minus, _, base, depth, left = heapq.heappop(queues[r])
                e = lattice.start[base[depth]]
                others = np.array([x for x in range(lattice.first_edge[e], lattice.first_edge[e + 1]) if x not in left])
                p = np.cumsum(np.exp(lattice.log_p[others]))
                u = float(uniform(keys[r : r + 1], 192 + turn, np.zeros(1))[0])
                new = int(others[min(len(others) - 1, int(np.searchsorted(p, u * p[-1])))])
                place = int(lattice.width[base[:depth]].sum() + lattice.width[new])
                following.append((r, base[:depth], new, place, -minus, left))
        opened = following
    for r in range(rows):
        if not busy[r]:
            yield [(np.zeros(0, np.int64), 0.0, float(root[r]), 0.0)]
            continue
        threshold = -queues[r][0][0] if len(found[r]) == k and queues[r] else -np.inf
        out = []
        for one in found[r]:
            apart = one.log_p - threshold
            inclusion = 0.0 if apart > 40 else apart if apart < -30 else float(np.log(-np.expm1(-np.exp(apart))))
            out.append((lattice.piece[one.edges], one.log_p, one.value, inclusion))
        yield out


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    numbers = ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return mixed(mixed(numbers.view(np.uint64) + _GOLD) + np.uint64(seed))


SAMPLE_FIELDS = {
    "sample": IntegerType(), "pieces": ArrayType(IntegerType()), "n_pieces": IntegerType(), "ids_crc32": LongType(),
    "log_prob": DoubleType(), "perturbed": DoubleType(), "log_inclusion": DoubleType(), "round_trip": BooleanType(),
}


def encoded(vocabulary: Vocabulary, batch: pa.RecordBatch, k: int, seed: int, pieces: bool) -> Iterator[pa.RecordBatch]:
    """The samples of a batch of (doc_id, text), a pass at a time."""
    data, offsets = flat(batch.column("text"))
    keys, ids = row_keys(batch.column("doc_id"), seed), batch.column("doc_id").cast(pa.int64())
    for a, b in passes(offsets, PASS):
        part, begin = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        owner, ranks, paths, checks, scores, same = [], [], [], [], [], []
        for i, samples in enumerate(sample_pass(vocabulary, part, begin, keys[a:b], k)):
            text = part[begin[i] : begin[i + 1]].tobytes()
            for rank, (found, log_p, value, inclusion) in enumerate(samples, 1):
                owner.append(a + i)
                ranks.append(rank)
                paths.append(found.astype("<i4", copy=False))
                checks.append(zlib.crc32(paths[-1].tobytes()))
                scores.append((log_p, value, inclusion))
                same.append(decode(found.tolist(), vocabulary.pieces) == text)
        sizes = np.array([len(path) for path in paths], np.int32)
        columns = {
            "doc_id": ids.take(pa.array(owner, pa.int64())), "sample": pa.array(ranks, pa.int32()),
            "pieces": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.concatenate(paths).astype(np.int32, copy=False)),
            "n_pieces": pa.array(sizes), "ids_crc32": pa.array(checks, pa.int64()),
            **{name: pa.array(list(part_), pa.float64()) for name, part_ in zip(("log_prob", "perturbed", "log_inclusion"), zip(*scores))},
            "round_trip": pa.array(same, pa.bool_()),
        }
        schema = ARROW_SCHEMA if pieces else ARROW_SCHEMA.remove(ARROW_SCHEMA.get_field_index("pieces"))
        yield pa.RecordBatch.from_arrays([columns[name] for name in schema.names], schema=schema)


def encode_samples(docs: DataFrame, k: int = SAMPLES, seed: int = 42, model: str = MODEL, pieces: bool = True) -> DataFrame:
    """One row for each text and sample: doc_id, the sample's rank from 1, its piece ids (left
    out with ``pieces=False``), their number and CRC-32 (as little-endian 32-bit), log-probability,
    perturbed value, log inclusion probability, and whether decoding gives the text back.

    A text with fewer than k segmentations gives all of them, with inclusion probability one. A null
    or empty text gives the empty segmentation. A null doc_id is a key like others; rows with one doc_id
    and text give the same samples. Other columns are not read. Any bytes come back exactly:
    characters the vocabulary lacks, the blank mark itself among them, become byte pieces."""
    ship_package(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))
    rows = docs.select(docs.doc_id.cast("long").alias("doc_id"), "text")
    fields = {name: kind for name, kind in SAMPLE_FIELDS.items() if pieces or name != "pieces"}
    schema = with_fields(rows.select("doc_id").schema, **fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from encoded(known.value, batch, k, seed, pieces)

    return rows.mapInArrow(run, schema)


ARROW_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("sample", pa.int32()), ("pieces", pa.list_(pa.int32())), ("n_pieces", pa.int32()), ("ids_crc32", pa.int64()),
    ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("round_trip", pa.bool_()),
])


def op9_pieces(docs: DataFrame) -> DataFrame:
    """Sampled segmentations of every document: their pieces, with digests of these."""
    return encode_samples(docs)


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every kept document's sampled piece sequences."""
    return encode_samples(docs)
