"""A byte-level convolutional network in numpy that scores a document's quality.

Every byte is embedded; filters eight bytes wide slide over the whole document in steps of four. The
filters' activations are max-pooled within overlapping chunks (64 steps, the next chunk starts 48 steps
on), and the chunks' maxima are combined over the document by mean and by maximum into one probability.

Weights are learned on the driver from a bounded sample of labelled rows: at most ``SAMPLE_ROWS`` rows
whose text has at most ``SAMPLE_BYTES`` bytes (under 160 MB, and about 8 MB of typical text). Scoring
reads every byte of every text, in Arrow batches, and moves no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import flat, held_out, passes, ship_package, table, text_of

SAMPLE_ROWS = 4800
SAMPLE_BYTES = 32_768
STEP = 4
BLOCK = 16  # steps a block; a chunk is four blocks, three blocks apart
EMBED, FILTERS = 8, 32
THRESHOLD = 0.3
FOLDS = 5


class Net:
    """Weights: byte embeddings, both halves of each filter, and the last layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, (2 / (2 * STEP * EMBED)) ** 0.5, (STEP * EMBED, 2 * FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.last = np.zeros(2 * FILTERS, np.float32)
        self.shift = np.zeros(1, np.float32)
        self.centre = np.zeros(2 * FILTERS, np.float32)
        self.scale = np.ones(2 * FILTERS, np.float32)

    def learned(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.last, self.shift]


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each filled up with value 256 to whole blocks, and
    the first block of each. At least one step of filling ends every text, so no
    filter sees two texts."""
    lengths = np.diff(offsets)
    blocks = (lengths + STEP) // (STEP * BLOCK) + 1
    first = np.concatenate([[0], np.cumsum(blocks)])
    filled = np.full(first[-1] * STEP * BLOCK, 256, np.int16)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    filled[np.arange(len(data)) - offsets[rows] + first[rows] * STEP * BLOCK] = data
    return filled, first


def chunks_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first block of every chunk, and each text's first chunk."""
    blocks = np.diff(first)
    counts = np.maximum(1, -(-(blocks - 1) // 3))
    begins = np.concatenate([[0], np.cumsum(counts)])
    rows = np.repeat(np.arange(len(blocks)), counts)
    return first[rows] + 3 * (np.arange(begins[-1]) - begins[rows]), begins


def activations(net: Net, filled: np.ndarray) -> np.ndarray:
    """Rectified filter outputs at every step; the last step of all is zero."""
    halves = net.embed[filled].reshape(-1, STEP * EMBED) @ net.filters
    out = np.zeros((len(halves), FILTERS), np.float32)
    np.add(halves[:-1, :FILTERS], halves[1:, FILTERS:], out=out[:-1])
    out[:-1] += net.bias
    return np.maximum(out, 0, out=out)


def pooled(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean and maximum over a text's chunks of each filter's maximum in the chunk."""
    filled, first = padded(data, offsets)
    acts = activations(net, filled).reshape(-1, BLOCK, FILTERS)
    acts[first[1:] - 1, -1] = 0  # a text's last step reaches into the next one
    blocks = acts.max(axis=1)
    begins, of = chunks_of(first)
    ends = np.repeat(first[1:], np.diff(of)) - 1
    tops = blocks[begins]
    for ahead in range(1, 4):
        np.maximum(tops, blocks[np.minimum(begins + ahead, ends)], out=tops)
    return np.concatenate([np.add.reduceat(tops, of[:-1]) / np.diff(of)[:, None], np.maximum.reduceat(tops, of[:-1])], axis=1)


def scores(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    for a, b in passes(offsets, 1 << 18):
        part = pooled(net, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        out[a:b] = ((part - net.centre) / net.scale) @ net.last + net.shift[0]
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, rounds: int = 600, texts_a_round: int = 48, chunks_a_text: int = 12, seed: int = 7) -> Net:
    """Adam on the logistic loss, two good texts to each bad one; long texts show
    other chunks in other rounds. Without texts of both classes the net says 0.5."""
    net, rng = Net(seed), np.random.default_rng(seed)
    classes = [np.flatnonzero(labels == k) for k in (0, 1)]
    if not all(len(c) for c in classes):
        return net
    width = STEP * BLOCK * 4 + STEP
    pieces = []
    for text in texts:
        filled, first = padded(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        begins, _ = chunks_of(first)
        filled = np.concatenate([filled, np.full(width, 256, np.int16)])
        pieces.append(filled[begins[:, None] * STEP * BLOCK + np.arange(width)])
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in net.learned()]
    for turn in range(1, rounds + 1):
        chosen = np.concatenate([rng.choice(c, texts_a_round * share // 3) for c, share in zip(classes, (1, 2))])
        shown = [p if len(p) <= chunks_a_text else p[rng.choice(len(p), chunks_a_text, replace=False)] for p in (pieces[i] for i in chosen)]
        counts = np.array([len(p) for p in shown])
        of = np.concatenate([[0], np.cumsum(counts)[:-1]])
        ids = np.concatenate(shown)
        x = net.embed[ids].reshape(len(ids), -1, STEP * EMBED)
        halves = x @ net.filters
        act = np.maximum(halves[:, :-1, :FILTERS] + halves[:, 1:, FILTERS:] + net.bias, 0)
        at = act.argmax(axis=1)
        tops = np.take_along_axis(act, at[:, None, :], 1)[:, 0]
        mean, best = np.add.reduceat(tops, of) / counts[:, None], np.maximum.reduceat(tops, of)
        features = np.concatenate([mean, best], axis=1)
        if turn == 1:
            net.centre, net.scale = features.mean(0), features.std(0) + 0.05
        scaled = (features - net.centre) / net.scale
        y = labels[chosen]
        error = (1 / (1 + np.exp(-np.clip(scaled @ net.last + net.shift[0], -30, 30))) - y) / len(y)
        down = (error[:, None] * net.last / net.scale).astype(np.float32)
        rows = np.repeat(np.arange(len(counts)), counts)
        d_tops = down[rows, :FILTERS] / counts[rows, None] + down[rows, FILTERS:] * (tops == best[rows])
        d_tops = d_tops * (tops > 0)
        here = np.arange(len(ids))[:, None]
        seen = np.concatenate([x[here, at], x[here, at + 1]], axis=2)
        d_weight = np.einsum("cf,cfd->df", d_tops, seen)
        d_filters = np.concatenate([d_weight[: STEP * EMBED], d_weight[STEP * EMBED :]], axis=1)
        whole = np.concatenate([net.filters[:, :FILTERS], net.filters[:, FILTERS:]], axis=0)
        d_seen = (d_tops[:, :, None] * whole.T[None]).reshape(-1, EMBED)
        touched = ids[here[:, :, None], at[:, :, None] * STEP + np.arange(2 * STEP)].reshape(-1)
        d_embed = np.stack([np.bincount(touched, d_seen[:, j], 257) for j in range(EMBED)], axis=1)
        steps = [d_embed, d_filters, d_tops.sum(0), scaled.T @ error + 1e-4 * net.last, np.array([error.sum()])]
        rate = 0.01 if turn < rounds * 0.7 else 0.003
        for weight, (m, v), d in zip(net.learned(), state, steps):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            weight -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return net


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Labelled training texts, up to half of ``rows`` a class, the same ones every
    time. Rows whose id's crc32 leaves 0 modulo 5 are held out."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("_label"))
    text = text_of()
    good = docs.select("doc_id", text.alias("text")).where((held_out(F.col("doc_id"), FOLDS) != 0) & (F.octet_length("text") <= most_bytes))
    found = []
    for label in (0, 1):
        wanted = known.where(F.col("_label") == label).select("doc_id").where(held_out(F.col("doc_id"), FOLDS) != 0)
        # The ids are chosen first, so only the chosen texts move. Ties cannot matter: ids are distinct.
        # Long texts are passed over, hence twice the number of ids.
        wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        found.append(good.join(wanted, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows // 2).withColumn("label", F.lit(label)))
    taken = sorted(found[0].unionByName(found[1]).collect(), key=lambda r: (r.doc_id, r.label, r.text))
    return [r.text.encode() for r in taken], np.array([r.label for r in taken], np.int64)


def score_documents(docs: DataFrame, net: Net) -> DataFrame:
    """Every row of ``docs`` with its score as ``score``; a null text scores as the
    empty one. A column of that name that was there before is replaced."""
    ship_package(docs.sparkSession)
    score = F.arrow_udf(lambda text: pa.array(scores(net, *flat(text))), "double")
    # Only texts go to Python; all other columns wait in the executor.
    return docs.drop("score").withColumn("score", score(text_of()))


def quality_net(docs: DataFrame, labels: DataFrame) -> Net:
    return train(*sample(docs, labels))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """The quality contract's columns for every document. A null text scores as the empty one; repeated rows
    are each answered alike, a null doc_id counts as the empty text for its fold; an empty table gives no rows;
    columns other than doc_id and text are not read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality_net(docs, table(spark, sf_dir, "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(net, data, offsets))], names=["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (held_out(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go. Each row is judged by its text alone, a null
    one as the empty text, so repeated rows go or stay together; columns of any name are handed on as they are."""
    net = quality_net(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_of().alias("text"))
    return score_documents(rows, net).where(F.col("score") >= THRESHOLD).select(*[F.col("row")[c].alias(c) for c in docs.columns])
