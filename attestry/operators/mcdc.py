"""MC/DC: distinct observations of a decision and the pairs that show a
condition turning its outcome.

``vectors`` hold run_id, test_id, decision_id, seq, outcome and ``vals``, an
array of booleans with null where short-circuiting left a condition unevaluated.
``keys`` are the columns results are kept apart by: ``run_id``, or a run with a
test dimension when coverage is recomputed per group.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def letters(vals: Column) -> Column:
    return F.array_join(F.transform(vals, lambda v: F.when(v.isNull(), "-").when(v, "T").otherwise("F")), "")


def vector_key(vals: Column, outcome: Column) -> Column:
    """``TF-:T``: each condition's value, then the outcome."""
    return F.concat(letters(vals), F.lit(":"), F.when(outcome, "T").otherwise("F"))


def vector_text(vals: Column) -> Column:
    """``T F -`` as a reader sees it."""
    return F.array_join(F.transform(vals, lambda v: F.when(v.isNull(), "-").when(v, "T").otherwise("F")), " ")


def observations(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Each distinct vector of a decision once, at its first sighting.

    The partial aggregation before the shuffle leaves at most a handful of rows
    per decision and task, whatever share of all vectors one decision holds. What
    is left is put by decision, so all that is asked of a decision's vectors
    afterwards happens where they are.
    """
    return (
        vectors.groupBy(*keys, "decision_id", "vals", "outcome")
        .agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("sightings"))
        .withColumn("vector_key", vector_key(F.col("vals"), F.col("outcome")))
        .repartition(*keys, "decision_id")
    )


# Conditions are packed into longs, this many to each; a decision has as many longs as it needs.
WORD = 62


def _words(observed: DataFrame, keys: list[str]) -> DataFrame:
    """Observations as arrays of words: ``k`` the conditions evaluated, ``v`` those true."""
    return observed.select(
        *keys, "decision_id", "outcome", "vector_key", *[c for c in ("seq", "rank") if c in observed.columns], F.size("vals").alias("n"),
        _packed(F.col("vals"), lambda v: v.isNotNull()).alias("k"), _packed(F.col("vals"), lambda v: F.coalesce(v, F.lit(False))).alias("v"))


def _packed(vals: Column, wanted) -> Column:
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(vals), F.lit(1)), F.lit(WORD)), lambda i: i <= F.size(vals))

    def word(start: Column) -> Column:
        bits = F.transform(
            F.slice(vals, start, WORD),
            lambda v, i: F.when(wanted(v), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, bit: acc.bitwiseOR(bit))

    return F.transform(starts, word)


def _index() -> Column:
    return F.floor(F.col("condition") / WORD).cast("int")


def _place() -> Column:
    return (F.col("condition") % WORD).cast("int")


def _bit(name: str) -> Column:
    """Whether the bit of the row's ``condition`` is set in its words."""
    return F.getbit(F.get(name, _index()), _place()) == 1


def _shared() -> Column:
    """The values both masks evaluated, the target's left out."""
    target = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), _place()))

    def both(k: Column, w: Column) -> Column:
        values = k.bitwiseAND(F.get("o", w)).bitwiseAND(F.get("v", w))
        return F.when(w == _index(), values.bitwiseAND(target)).otherwise(values)

    return F.transform("k", both)


def is_independence_pair(left: Column, left_outcome: Column, right: Column, right_outcome: Column, condition: Column) -> Column:
    """Outcomes and the target differ; every other condition agrees or was left
    unevaluated on a side. ``condition`` counts from zero."""
    place = condition + 1
    differing = F.filter(
        F.sequence(F.lit(1), F.size(left)),
        lambda i: F.coalesce(F.element_at(left, i) != F.element_at(right, i), F.lit(False)),
    )
    in_range = (F.size(left) == F.size(right)) & (condition >= 0) & (condition < F.size(left))
    return F.coalesce(in_range & (left_outcome != right_outcome) & (differing == F.array(place)), F.lit(False))


def _against(words: DataFrame, others: DataFrame, decision: list[str]) -> DataFrame:
    """Words once per evaluation mask among the others, per condition both evaluate,
    with the shared values."""
    masks = others.select(*decision, F.col("k").alias("o")).distinct()
    each = words.filter("n > 0").join(masks, decision).filter(F.size("k") == F.size("o")).withColumn("condition", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return each.filter(_bit("k") & _bit("o")).select("*", _shared().alias("s"), _bit("v").alias("target"))


def _ranked(observed: DataFrame, keys: list[str]) -> DataFrame:
    """Observations numbered within their decision by first sighting."""
    return observed.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "decision_id").orderBy("seq", "vector_key")))


def _first_pairs(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Per condition the ranks of its first independence pair, as one long.

    A pair exists where two vectors agree on the conditions both evaluated, so
    each vector is filed under every evaluation mask seen at its decision, once
    per condition, keyed by the values both masks share. Within such a group the
    earliest vector per side, target value and outcome decides the first pair:
    no two vectors are ever joined, and the cost is vectors x masks, not
    vectors squared. Ranks keep the aggregation buffers of fixed width.
    """
    decision = [*keys, "decision_id"]
    seen = _words(ranked, keys).drop("vector_key")
    filed = _against(seen, seen, decision)
    on_low = F.col("k") <= F.col("o")
    sided = filed.select(
        *decision, "condition", "rank", "target", "outcome", "s", on_low.alias("_low"), (~on_low | (F.col("k") == F.col("o"))).alias("_high"),
        F.when(on_low, F.col("k")).otherwise(F.col("o")).alias("lo"), F.when(on_low, F.col("o")).otherwise(F.col("k")).alias("hi"))

    def first(side: str, target: bool, outcome: bool) -> Column:
        return F.min(F.when(F.col(side) & (F.col("target") == target) & (F.col("outcome") == outcome), F.col("rank")))

    combos = [(t, o) for t in (True, False) for o in (True, False)]
    grouped = sided.groupBy(*decision, "condition", "lo", "hi", "s").agg(
        *[first("_low", t, o).alias(f"l{int(t)}{int(o)}") for t, o in combos],
        *[first("_high", t, o).alias(f"h{int(t)}{int(o)}") for t, o in combos],
    )

    def pair(t: bool, o: bool) -> Column:
        left, right = F.col(f"l{int(t)}{int(o)}"), F.col(f"h{int(not t)}{int(not o)}")
        both = F.least(left, right).cast("long") * F.lit(2**31) + F.greatest(left, right)
        return F.when(left.isNotNull() & right.isNotNull(), both)

    return (
        grouped.select(*decision, "condition", F.least(*[pair(t, o) for t, o in combos]).alias("pair"))
        .filter(F.col("pair").isNotNull()).groupBy(*decision, "condition").agg(F.min("pair").alias("pair"))
    )


def shown_conditions(observed: DataFrame, keys: list[str]) -> DataFrame:
    """Conditions some independence pair shows deciding their decision."""
    return _first_pairs(_ranked(observed, keys), keys).drop("pair")


# Vectors of up to this many conditions have numbers below 64, so all a decision saw of them is one long.
NARROW = 3
_NUMBERS = [(vals, outcome) for outcome in (False, True) for vals in product((None, False, True), repeat=NARROW)]


def _seen_any(wanted) -> Column:
    """Whether one of the numbered vectors that ``wanted(vals, outcome)`` names was seen."""
    mask = sum(1 << i for i, vector in enumerate(_NUMBERS) if wanted(*vector))
    return F.col("seen").bitwiseAND(F.lit(mask).cast("long")) != 0


def _number(vals: Column, outcome: Column) -> Column:
    """A narrow vector's place in ``_NUMBERS``; conditions it does not have count as unevaluated."""
    def digit(i: int) -> Column:
        value = F.get(vals, i)
        return F.when(value.isNull(), 0).when(value, 2).otherwise(1) * 3 ** (NARROW - 1 - i)

    return sum((digit(i) for i in range(NARROW)), F.when(outcome, 3**NARROW).otherwise(0))


def _narrow_shown(condition: int) -> Column:
    """Whether a pair of the vectors seen turns the outcome with the condition and nothing else."""
    def agrees(left: tuple, right: tuple) -> bool:
        return all(a is None or b is None or (a != b) == (i == condition) for i, (a, b) in enumerate(zip(left, right))) and None not in (left[condition], right[condition])

    ways = [
        _seen_any(lambda vals, outcome, one=one: outcome and vals == one) & _seen_any(lambda vals, outcome, one=one: not outcome and agrees(one, vals))
        for one in product((None, False, True), repeat=NARROW) if one[condition] is not None]
    return reduce(lambda a, b: a | b, ways)


def decision_facts(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Per decision seen: how many of its outcomes and of its conditions' values were seen, and the ``shown`` conditions.

    What a decision saw of vectors of up to three conditions is a set of numbers in one long: one partial aggregation,
    with nothing sorted and no vector kept. A decision with any wider vector takes all of its vectors, unpacked again."""
    decision = [*keys, "decision_id"]
    narrow = F.coalesce(F.size("vals").between(0, NARROW) & F.col("outcome").isNotNull(), F.lit(False))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _number(F.col("vals"), F.col("outcome")))
    seen = vectors.filter(narrow).groupBy(*decision).agg(F.bit_or(bit).alias("seen"))
    broad = observations(vectors.filter(~narrow), keys).select(*decision, "vals", "outcome", "seq", "vector_key")
    wide = broad.select(*decision).distinct()
    whens = [F.when(_narrow_shown(c), F.lit(c)) for c in range(NARROW)]
    packed = seen.join(wide, decision, "left_anti").select(
        *decision,
        sum(_seen_any(lambda vals, outcome, o=o: outcome == o).cast("int") for o in (True, False)).alias("outcomes_seen"),
        sum(_seen_any(lambda vals, outcome, c=c, v=v: vals[c] is v).cast("int") for c in range(NARROW) for v in (True, False)).cast("long").alias("condition_values_seen"),
        F.array_compact(F.array(*whens)).alias("shown"))
    numbers = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(v).cast("boolean") for v in vals]).alias("vals"), F.lit(outcome).alias("outcome")) for i, (vals, outcome) in enumerate(_NUMBERS)])
    lifted = seen.join(wide, decision, "left_semi").withColumn("n", F.explode(numbers)).filter(F.getbit("seen", F.col("n.i")) == 1).select(
        *decision, "n.vals", "n.outcome", F.lit(0).cast("long").alias("seq"), vector_key(F.col("n.vals"), F.col("n.outcome")).alias("vector_key"))
    every = lifted.unionByName(broad)
    shown = shown_conditions(every, keys).groupBy(*decision).agg(F.array_sort(F.collect_list("condition")).alias("shown"))
    general = condition_outcomes(every, keys).join(shown, decision, "left").select(
        *decision, "outcomes_seen", "condition_values_seen", F.coalesce("shown", F.array().cast("array<int>")).alias("shown"))
    return packed.unionByName(general)


def witnesses(observed: DataFrame, keys: list[str]) -> DataFrame:
    """The first independence pair of each condition that has one."""
    ranked, decision = _ranked(observed, keys), [*keys, "decision_id"]
    pairs = _first_pairs(ranked, keys).select(
        *decision, "condition", F.floor(F.col("pair") / F.lit(2**31)).cast("int").alias("_one"), (F.col("pair") % F.lit(2**31)).cast("int").alias("_two"))
    one = ranked.select(*decision, F.col("rank").alias("_one"), F.col("seq").alias("first_seq"), F.col("vector_key").alias("first_vector"))
    two = ranked.select(*decision, F.col("rank").alias("_two"), F.col("seq").alias("second_seq"), F.col("vector_key").alias("second_vector"))
    return pairs.join(one, [*decision, "_one"]).join(two, [*decision, "_two"]).drop("_one", "_two")


def with_values(keyed: DataFrame) -> DataFrame:
    """Vectors given by their key alone, with values and outcome read off it."""
    text = F.filter(F.split(F.substring_index("vector_key", ":", 1), ""), lambda c: c != "")
    return keyed.withColumn("vals", F.transform(text, lambda c: F.when(c == "T", True).when(c == "F", False))).withColumn(
        "outcome", F.substring_index("vector_key", ":", -1) == "T")


def independence_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every independence pair of a left and a right vector of one decision.

    Both sides hold keys, decision_id, vals, outcome, vector_key and ``rank``.
    Vectors meet by equality on what both masks evaluate, so only pairs that hold
    are formed.
    """
    decision = [*keys, "decision_id"]
    one, two = _words(left, keys), _words(right, keys)

    def filed(words: DataFrame, others: DataFrame, side: str, own: str, other: str, flip: bool) -> DataFrame:
        return _against(words, others, decision).select(
            *decision, "condition", F.col("k").alias(own), F.col("o").alias(other), "s", (F.col("target") != flip).alias("target"), (F.col("outcome") != flip).alias("outcome"),
            F.col("vector_key").alias(f"{side}_vector"), F.col("rank").alias(f"{side}_rank"))

    on = [*decision, "condition", "l", "r", "s", "target", "outcome"]
    return filed(one, two, "left", "l", "r", False).join(filed(two, one, "right", "r", "l", True), on).select(
        *decision, "condition", "left_vector", "left_rank", "right_vector", "right_rank")


def condition_outcomes(observed: DataFrame, keys: list[str]) -> DataFrame:
    """Per decision: how many of its outcomes and of its conditions' values were seen."""
    decision = [*keys, "decision_id"]
    values = observed.select(*decision, "outcome", F.posexplode_outer("vals").alias("condition", "value"))
    each = values.groupBy(*decision, "condition").agg(
        F.bool_or("outcome").alias("_true"), F.bool_or(~F.col("outcome")).alias("_false"), F.max("value").alias("_on"), F.max(~F.col("value")).alias("_off"))
    told = lambda name: F.coalesce(F.col(name), F.lit(False)).cast("int")
    return each.groupBy(*decision).agg(
        (F.bool_or("_true").cast("int") + F.bool_or("_false").cast("int")).alias("outcomes_seen"), F.sum(told("_on") + told("_off")).alias("condition_values_seen"))
