"""A hierarchical Pitman-Yor language model of word pairs, trained and applied on Spark.

Words fall into classes by a hash (words that alone make up a good part of the text are a class of their
own), and a word's probability after a context is that of its class there times its probability within
the class. Both are of hierarchical Pitman-Yor restaurants: over classes every context has one, whose
dishes are the classes, and all share one parent with a uniform base; within a class every context has
one, and all of them share one parent, whose base is uniform over the class's known words and one unknown. Seating is sampled by Gibbs: in every
sweep each context's customers of a word leave and are seated anew, one after another, given all others;
the parent's customers are the contexts' tables. Restaurants do not reach over classes, so classes are
sampled in parallel, without approximation between them. Predictive probabilities are averaged
over the sweeps after the burn-in.

Contexts are the ``CONTEXTS`` most frequent words, and for all other words ``SHARED`` contexts that they
share by hash. Both are bounds of the model, so their counts can go to every task; classes, words, pairs
and their counts grow with the text. A class's rows come together by one shuffle, packed into arrays; what a
word contributes goes back to its document's block in another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import bytes_hashes, flat, held_out, lowered, mixed, parts_for, passes, ship_package, words, written

CONTEXTS, SHARED = 65_535, 1024
#: Tokens a class holds about; the part of a class's tokens that makes a word a class of its own.
CLASS_TOKENS, OWN_PART = 1_000_000, 0.25
#: Bytes of text whose tokens are packed together.
BLOCK_BYTES = 6 << 20
FOLDS, HELD_OUT = 5, 1
DISCOUNT, STRENGTH = 0.8, 1.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.7, 5.0
CLASS_DISCOUNT, CLASS_STRENGTH = 0.5, 20.0
#: Customers of the restaurants over classes that are seated in one group.
PART_TOKENS = 4_000_000
BURN_IN, SAMPLES = 2, 3
#: Customers of one pair that are seated one by one; more follow in steps of a 16th of those seated.
ONE_BY_ONE = 64
END = np.uint64(0x5EED0FE4D0FD0C55)
SEED = 2024


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts of a pass, each text's end included, and each token's row."""
    low = lowered(data)
    starts, ends, rows = words(low, offsets)
    hashes = bytes_hashes(low, starts, ends)
    texts = len(offsets) - 1
    out = np.full(len(hashes) + texts, END)
    out[np.arange(len(hashes)) + rows] = hashes
    return out, np.repeat(np.arange(texts), np.bincount(rows, minlength=texts) + 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each token stands in the training texts; word is its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            train = batch.column("train").to_numpy(zero_copy_only=False)
            found = []
            for a, b in passes(offsets):
                tokens, rows = tokens_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                found.append(np.unique(tokens[train[a:b][rows]], return_counts=True))
            if found:
                names, counts = (np.concatenate(part) for part in zip(*found))
                names, which = np.unique(names, return_inverse=True)
                counts = np.bincount(which, counts, len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts)], names=["word", "n"])

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Frequent:
    """The frequent words, sorted by hash, and what every task needs to know of contexts."""

    def __init__(self, words_: np.ndarray, counts: np.ndarray, shared: np.ndarray, texts: int, tokens: int):
        order = np.argsort(words_)
        self.words, self.counts = words_[order], counts[order]
        self.tokens = tokens
        self.classes = parts_for(tokens, CLASS_TOKENS)
        #: By context: the frequent words, those shared by hash, and a text's beginning.
        self.context_counts = np.concatenate([self.counts, shared, [texts]]).astype(np.float64)
        self.own = self.counts > OWN_PART * tokens / self.classes

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Each token's place among the frequent words, or -1."""
        if not len(self.words):
            return np.full(len(tokens), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return np.where(self.words[at] == tokens, at, -1)

    def contexts(self, tokens: np.ndarray, places: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each token's context: the word before it, or the beginning."""
        own = np.where(places >= 0, places, len(self.words) + (tokens % np.uint64(SHARED)).astype(np.int64))
        out = np.empty(len(tokens), np.int32)
        out[1:] = own[:-1]
        out[first] = len(self.words) + SHARED
        return out


    @property
    def dishes(self) -> int:
        """Dishes of the restaurants over classes: the classes, then the words that are classes of their own."""
        return self.classes + int(self.own.sum())

    def dish_of_own(self, places: np.ndarray) -> np.ndarray:
        return self.classes + (np.cumsum(self.own) - 1)[places]

    def alone(self, places: np.ndarray) -> np.ndarray:
        return (places >= 0) & self.own[places] if len(self.own) else np.zeros(len(places), bool)

    def class_of(self, tokens: np.ndarray, context: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """The class whose group samples each token; a word that is its own class is dealt over all by context."""
        kind = mixed(tokens ^ np.uint64(0xC1A55))
        kind[alone] = mixed(kind[alone] + context[alone].astype(np.uint64))
        return (kind % np.uint64(self.classes)).astype(np.int32)


def first_of_rows(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])


PACKED = "class int, block long, header binary, context binary, frequent binary, rare binary, doc binary"


def blocks_of(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for low, high in passes(offsets, BLOCK_BYTES):
        for first in range(low, high, 1 << 16):
            yield first, min(high, first + (1 << 16))


def packed_tokens(docs: DataFrame, known) -> DataFrame:
    """Tokens by class, packed for each batch of texts. A header row carries the
    batch's ids, what is already known of its scores, and its rows' part in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: Frequent = known.value
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            # A document's place in its block is stored in two bytes.
            for low, high in blocks_of(flat(batch.column("text"))[1]):
                block, number = (task << 32) + number, number + 1
                part = batch.slice(low, high - low)
                data, offsets = flat(part.column("text"))
                found = []
                n_tokens, n_known, logs = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                for a, b in passes(offsets):
                    tokens, rows = tokens_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    places = frequent.find(tokens)
                    context = frequent.contexts(tokens, places, first_of_rows(rows))
                    often = places >= 0
                    n_tokens[a:b] += np.bincount(rows, minlength=b - a)
                    n_known[a:b] += np.bincount(rows[often], minlength=b - a)
                    logs[a:b] += np.bincount(rows[often], np.log10(frequent.counts[places[often]] + 0.5), b - a)
                    found.append((context, places, tokens, rows + a, frequent.class_of(tokens, context, frequent.alone(places))))
                context, places, tokens, rows, kind = (np.concatenate(p) for p in zip(*found))
                order = np.lexsort((places, context, kind))
                context, places, tokens, rows, kind = context[order], places[order], tokens[order], rows[order], kind[order]
                bounds = np.searchsorted(kind, np.arange(frequent.classes + 1))
                out = {name: [] for name in ("class", "block", "header", "context", "frequent", "rare", "doc")}
                ids, train = part.column("doc_id"), part.column("train").to_numpy(zero_copy_only=False)
                head = b"".join([
                    np.array([part.num_rows], np.int64).tobytes(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int8).tobytes(), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                    train.astype(np.int8).tobytes(), n_tokens.tobytes(), n_known.tobytes(), logs.tobytes(),
                ])
                for c in np.flatnonzero(np.diff(bounds)):
                    a, b = bounds[c], bounds[c + 1]
                    row = int(c), block, None, context[a:b].tobytes(), places[a:b].astype(np.int32).tobytes(), tokens[a:b][places[a:b] < 0].tobytes(), (rows[a:b].astype(np.uint32) * 2 + train[rows[a:b]]).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
                    for values, value in zip(out.values(), row):
                        values.append(value)
                for values, value in zip(out.values(), (int(block % frequent.classes), block, head, None, None, None, None)):
                    values.append(value)
                yield pa.RecordBatch.from_pydict(out, schema=ARROW_PACKED)

    return docs.mapInArrow(run, PACKED)


ARROW_PACKED = pa.schema([("class", pa.int32()), ("block", pa.int64()), *[(n, pa.binary()) for n in ("header", "context", "frequent", "rare", "doc")]])
BACK = "block long, header binary, doc binary, score binary, rare binary, known binary, logs binary"
ARROW_BACK = pa.schema([("block", pa.int64()), *[(n, pa.binary()) for n in ("header", "doc", "score", "rare", "known", "logs")]])


def seated(counts: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that each group of customers of one dish opens when it is seated anew in
    its restaurant, where ``others`` tables of other dishes stand; ``base``: the dish's
    probability above. Groups come by falling size."""
    tables = np.minimum(counts, 1).astype(np.float64)
    sitting, step = 1.0, 1.0
    active = int(np.searchsorted(-counts, -1, side="left"))
    while active:
        t = tables[:active]
        fresh = (strength + discount * (others[:active] + t)) * base[:active]
        p = fresh / (fresh + np.maximum(sitting - discount * t, 1e-12))
        # One customer, or as many as come at once to a long row that is seated already.
        coming = np.minimum(step, counts[:active] - sitting)
        tables[:active] += rng.random(active) < p if step == 1 else np.minimum(rng.binomial(coming.astype(np.int64), p), coming)
        sitting += step
        if sitting >= ONE_BY_ONE:
            step = float(int(sitting) // 16)
        active = int(np.searchsorted(-counts, -sitting, side="left"))
    return tables


def parent_shares(upper: np.ndarray, tables: np.ndarray, base: float) -> np.ndarray:
    """Probabilities in a parent restaurant with ``upper`` customers at ``tables`` of each dish."""
    over = (PARENT_STRENGTH + PARENT_DISCOUNT * tables.sum()) * base
    return (np.maximum(upper - PARENT_DISCOUNT * tables, 0) + over) / (PARENT_STRENGTH + upper.sum())


def parent_seated(upper: np.ndarray, tables: np.ndarray, base: float, rng: np.random.Generator) -> np.ndarray:
    order = np.argsort(-upper, kind="stable")
    again = np.empty(len(upper))
    again[order] = seated(upper[order], (tables.sum() - tables)[order], np.full(len(upper), base), PARENT_DISCOUNT, PARENT_STRENGTH, rng)
    return again


@dataclass(frozen=True)
class Shares:
    """What every task needs of the restaurants over classes: by context its customers and, by sample, the mass it
    leaves to the parent; by sample the parent's probabilities. The tables of a context and class lie with the class."""

    customers: np.ndarray
    left: np.ndarray
    parent: np.ndarray

    def of(self, context: np.ndarray, dish: np.ndarray, served: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """P(dish | context) where the context served the dish so often, at so many tables on average."""
        direct = (served - CLASS_DISCOUNT * tables) / (CLASS_STRENGTH + self.customers[context])
        return direct + sum(left[context] * parent[dish] for left, parent in zip(self.left, self.parent)) / len(self.left)


def class_customers(docs: DataFrame, known) -> DataFrame:
    """(context, dish, n): how often each class, or word that is one, follows each context in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: Frequent = known.value
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in passes(offsets):
                tokens, rows = tokens_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                places = frequent.find(tokens)
                alone = frequent.alone(places)
                dish = (mixed(tokens ^ np.uint64(0xC1A55)) % np.uint64(frequent.classes)).astype(np.int64)
                dish[alone] = frequent.dish_of_own(places[alone])
                pairs, n = np.unique(frequent.contexts(tokens, places, first_of_rows(rows)).astype(np.int64) * frequent.dishes + dish, return_counts=True)
                columns = pa.array((pairs // frequent.dishes).astype(np.int32)), pa.array((pairs % frequent.dishes).astype(np.int32)), pa.array(n.astype(np.int64))
                yield pa.RecordBatch.from_arrays(list(columns), names=["context", "dish", "n"])

    return docs.mapInArrow(run, "context int, dish int, n long").groupBy("context", "dish").agg(F.sum("n").alias("n"))


SEATED = "part int, context int, dish int, n long, tables double, kept double"


def reseated(table: pa.Table, base: np.ndarray, sweep: int) -> pa.Table:
    """A part's contexts with every customer seated anew, given the parent's probabilities of the dishes."""
    part, context, dish, n, tables, kept = (table[name].to_numpy() for name in ("part", "context", "dish", "n", "tables", "kept"))
    order = np.lexsort((dish, context, -n))
    context, dish, n, tables, kept = (x[order] for x in (context, dish, n, tables, kept))
    places, here = np.unique(context, return_inverse=True)
    others = np.bincount(here, tables, len(places))[here] - tables
    rng = np.random.default_rng([SEED, sweep, int(part[0])])
    tables = seated(n.astype(np.float64), others, base[dish], CLASS_DISCOUNT, CLASS_STRENGTH, rng)
    kept = kept + tables / SAMPLES if sweep >= BURN_IN else kept
    return pa.table({"part": part, "context": context, "dish": dish, "n": n, "tables": tables, "kept": kept})


def class_restaurants(docs: DataFrame, known, frequent: Frequent) -> tuple[Shares, DataFrame]:
    """The restaurants over classes, sampled in sweeps as those within them: contexts are seated in groups side by side,
    and the parent, which has a dish for a class and so grows with the classes alone, between sweeps."""
    parts, dishes, contexts = parts_for(frequent.tokens, PART_TOKENS), frequent.dishes, len(frequent.context_counts)
    one, none = F.lit(1.0), F.lit(0.0)
    state = written(class_customers(docs, known).select(F.pmod("context", F.lit(parts)).alias("part"), "context", "dish", "n", one.alias("tables"), none.alias("kept")), "seats")

    def customers_above() -> np.ndarray:
        rows = state.groupBy("dish").agg(F.sum("tables").alias("tables")).toPandas()
        upper = np.zeros(dishes)
        upper[rows["dish"].to_numpy(np.int64)] = rows["tables"].to_numpy(np.float64)
        return upper

    rng, upper = np.random.default_rng(SEED), customers_above()
    above = np.minimum(upper, 1.0)
    customers, left, parent = np.zeros(contexts), [], []
    for sweep in range(BURN_IN + SAMPLES):
        base = parent_shares(upper, above, 1.0 / dishes)

        def seat(table):
            return reseated(table, base, sweep)

        state = written(state.groupBy("part").applyInArrow(seat, SEATED), "seats")
        upper = customers_above()
        above = parent_seated(upper, above, 1.0 / dishes, rng)
        if sweep >= BURN_IN:
            rows = state.groupBy("context").agg(F.sum("n").alias("n"), F.sum("tables").alias("tables")).toPandas()
            at, tables = rows["context"].to_numpy(np.int64), np.zeros(contexts)
            customers[at], tables[at] = rows["n"], rows["tables"]
            left.append((CLASS_STRENGTH + CLASS_DISCOUNT * tables) / (CLASS_STRENGTH + customers))
            parent.append(parent_shares(upper, above, 1.0 / dishes))

    def by_class(table):
        """A part's tables, packed for the groups that sample the classes."""
        frequent: Frequent = known.value
        context, dish, kept = (table[name].to_numpy() for name in ("context", "dish", "kept"))
        single = dish >= frequent.classes
        kind = dish.astype(np.int32)
        words_ = frequent.words[frequent.own][dish[single] - frequent.classes]
        kind[single] = frequent.class_of(words_, context[single], np.ones(len(words_), bool))
        order = np.argsort(kind, kind="stable")
        numbers, starts = np.unique(kind[order], return_index=True)
        rows = [[x[part].astype(t).tobytes() for part in np.split(order, starts[1:])] for x, t in ((context, np.int32), (dish, np.int32), (kept, np.float64))]
        nothing = [None] * len(numbers)
        return pa.table([numbers, [-1] * len(numbers), nothing, *rows, nothing], schema=ARROW_PACKED)

    return Shares(customers, np.array(left), np.array(parent)), state.groupBy("part").applyInArrow(by_class, PACKED)


def class_probabilities(
    frequent: Frequent, number: int, context: np.ndarray, word: np.ndarray, own: np.ndarray, count: np.ndarray,
    shares: Shares | None = None, seats: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
) -> np.ndarray:
    """Averaged probabilities of a class's distinct pairs (sorted by word). ``own``: the
    place of a word that is its own class, or -1; ``count``: the pair in training. ``seats``: the contexts, dishes and
    tables of the restaurants over classes that lie with this class; without ``shares`` there is no other class."""
    out = np.zeros(len(context))
    single = own >= 0

    def share(context: np.ndarray, dish: np.ndarray, served: np.ndarray) -> np.ndarray:
        if shares is None:
            return np.ones(len(context))
        keys = seats[0].astype(np.int64) * frequent.dishes + seats[1]
        order, wanted = np.argsort(keys), context.astype(np.int64) * frequent.dishes + dish
        tables = np.zeros(len(context))
        if len(keys):
            at = order[np.minimum(np.searchsorted(keys[order], wanted), len(keys) - 1)]
            tables = np.where(keys[at] == wanted, seats[2][at], 0.0)
        return shares.of(context, dish, served, tables)

    if single.any():
        out[single] = share(context[single], frequent.dish_of_own(own[single]), count[single])
    rest = np.flatnonzero(~single)
    if not len(rest):
        return out
    rng = np.random.default_rng([SEED, number])
    context, word, count = context[rest], word[rest], count[rest].astype(np.int64)
    places, here = np.unique(context, return_inverse=True)
    dish = np.concatenate([[0], np.cumsum(word[1:] != word[:-1])])
    dishes = int(dish[-1]) + 1
    in_class = np.bincount(here, count, len(places))
    known = np.bincount(dish, count, dishes) > 0
    types = int(known.sum())
    train = np.flatnonzero(count)
    train = train[np.argsort(-count[train], kind="stable")]
    c, d, r = count[train].astype(np.float64), dish[train], here[train]
    tables = np.ones(len(train))
    upper = np.bincount(d, tables, dishes)
    upper_tables = np.minimum(upper, 1.0)
    uniform = 1.0 / (types + 1)

    averaged = np.zeros(len(context))
    for sweep in range(BURN_IN + SAMPLES):
        base, all_tables = parent_shares(upper, upper_tables, uniform), np.bincount(r, tables, len(places))
        tables = seated(c, all_tables[r] - tables, base[d], DISCOUNT, STRENGTH, rng)
        upper = np.bincount(d, tables, dishes)
        upper_tables = parent_seated(upper, upper_tables, uniform, rng)
        if sweep >= BURN_IN:
            all_tables = np.bincount(r, tables, len(places))
            direct = np.zeros(len(context))
            direct[train] = c - DISCOUNT * tables
            averaged += (direct + (STRENGTH + DISCOUNT * all_tables[here]) * parent_shares(upper, upper_tables, uniform)[dish]) / (STRENGTH + in_class[here])
    out[rest] = averaged / SAMPLES * share(context, np.full(len(context), number), in_class[here])
    return out


def score_class(frequent: Frequent, shares: Shares, number: int, table: pa.Table) -> pa.Table:
    """A class's answers: for every block the documents it has words of, the sums of their
    words' log10 probabilities, and of rare words how many are known and sum log10(c + 0.5)."""
    back: dict[str, list] = {name: [] for name in ARROW_BACK.names}

    def give(*row) -> None:
        for values, value in zip(back.values(), row):
            values.append(value)

    blocks, context, word, place, doc, seats = [], [], [], [], [], []
    for row in table.select(["block", "header", "context", "frequent", "rare", "doc"]).to_pylist():
        if row["header"] is not None:
            give(row["block"], row["header"], None, None, None, None, None)
            continue
        if row["block"] < 0:
            seats.append([np.frombuffer(row[name], kind) for name, kind in (("context", np.int32), ("frequent", np.int32), ("rare", np.float64))])
            continue
        places = np.frombuffer(row["frequent"], np.int32)
        hashes = np.empty(len(places), np.uint64)
        hashes[places < 0] = np.frombuffer(row["rare"], np.uint64)
        hashes[places >= 0] = frequent.words[places[places >= 0]] if len(frequent.words) else 0
        three = np.zeros((len(places), 4), np.uint8)
        three[:, :3] = np.frombuffer(row["doc"], np.uint8).reshape(-1, 3)
        blocks.append(row["block"])
        context.append(np.frombuffer(row["context"], np.int32))
        word.append(hashes)
        place.append(places)
        doc.append(three.view("<u4")[:, 0])
    if not blocks:
        return pa.Table.from_pydict(back, schema=ARROW_BACK)
    sizes = [len(p) for p in place]
    context, word, place, doc = (np.concatenate(x) for x in (context, word, place, doc))
    order = np.lexsort((context, word))
    w, u = word[order], context[order]
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (u[1:] != u[:-1])])
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    lead = order[new]
    train = (doc & 1).astype(np.float64)
    count = np.bincount(pair, train, len(lead))
    own = np.where((place[lead] >= 0) & (frequent.own[place[lead]] if len(frequent.own) else False), place[lead], -1)
    seats = [np.concatenate(x) for x in zip(*seats)] if seats else [np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0)]
    score = np.log10(class_probabilities(frequent, number, context[lead], word[lead], own, count, shares, seats))
    dish = np.concatenate([[0], np.cumsum(word[lead][1:] != word[lead][:-1])])
    of_word = np.bincount(dish, count, int(dish[-1]) + 1)[dish]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for i, block in enumerate(blocks):
        a, b = begin[i], begin[i + 1]
        docs, which = np.unique(doc[a:b] >> 1, return_inverse=True)
        rare = np.flatnonzero(place[a:b] < 0)
        rare_docs, whose = np.unique(doc[a:b][rare] >> 1, return_inverse=True)
        c = of_word[pair[a:b][rare]]
        give(
            block, None, docs.astype("<u2").tobytes(), np.bincount(which, score[pair[a:b]], len(docs)).astype(np.float32).tobytes(),
            rare_docs.astype("<u2").tobytes(), np.bincount(whose, c > 0, len(rare_docs)).astype(np.int32).tobytes(), np.bincount(whose, np.log10(c + 0.5), len(rare_docs)).tobytes(),
        )
    return pa.Table.from_pydict(back, schema=ARROW_BACK)


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Training leaves out rows whose id's crc32 gives 1 modulo 5. A null text is empty: one end. A null
    doc_id hashes like an empty id and stays null. Repeated rows are each scored (and each counted in
    training); an empty table gives no rows; other columns are not read. Without any
    training text all words are unknown and scores come from the base alone."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (held_out(F.col("doc_id"), FOLDS) != HELD_OUT).alias("train"))
    counts = written(word_counts(rows.where("train")), "words")
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = counts.where(F.col("word") == int(END.view(np.int64))).first()
    texts = end.n if end else 0
    # The lowest count that leaves at most CONTEXTS words: from a table of how many words have each
    # count, of which there can be no more than the square root of twice the tokens.
    above = counts.groupBy("n").count().orderBy(F.desc("n"))
    least, seen = 1, 0
    for row in above.limit(CONTEXTS).collect():
        seen += row["count"]
        if seen > CONTEXTS:
            least = row.n + 1
            break
    often = counts.where(F.col("n") >= least).toPandas()
    shared = np.zeros(SHARED)
    rest = counts.where(F.col("n") < least).withColumn("slot", F.pmod("word", F.lit(SHARED))).groupBy("slot").agg(F.sum("n").alias("n"))
    for row in rest.collect():
        shared[row.slot] = row.n
    frequent = Frequent(often["word"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.float64), shared, texts, tokens)
    known = spark.sparkContext.broadcast(frequent)
    shares, seats = class_restaurants(rows.where("train"), known, frequent)
    given = spark.sparkContext.broadcast(shares)

    def by_class(key, table):
        return score_class(known.value, given.value, key[0].as_py(), table)

    def by_block(table):
        head, answers = None, []
        for row in table.select(["header", "doc", "score", "rare", "known", "logs"]).to_pylist():
            if row["header"] is not None:
                head = row["header"]
            else:
                answers.append(row)
        n = int(np.frombuffer(head, np.int64, 1)[0])
        at, parts = 8, []
        for kind in (np.int8, np.int64, np.int8, np.int64, np.int64, np.float64):
            parts.append(np.frombuffer(head, kind, n, at))
            at += n * np.dtype(kind).itemsize
        nothing, ids, train, n_tokens, n_known, logs = parts
        n_known, logs, score = n_known.copy(), logs.copy(), np.zeros(n)
        for row in answers:
            score[np.frombuffer(row["doc"], "<u2")] += np.frombuffer(row["score"], np.float32)
            rare = np.frombuffer(row["rare"], "<u2")
            n_known[rare] += np.frombuffer(row["known"], np.int32)
            logs[rare] += np.frombuffer(row["logs"], np.float64)
        base = logs - n_tokens * np.log10(tokens + 0.5 * (types + 1))
        return pa.table({
            "doc_id": pa.array(ids, mask=nothing.astype(bool)), "held_out": pa.array(train == 0), "n_tokens": n_tokens, "n_known": n_known,
            "train_tokens": np.full(n, tokens, np.int64), "base_score": base, "score": score,
        })

    back = packed_tokens(rows, known).unionByName(seats).groupBy("class").applyInArrow(by_class, BACK)
    return back.groupBy("block").applyInArrow(by_block, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_language_model(docs: DataFrame) -> DataFrame:
    return score_texts(docs)
