"""The restaurants over classes of the language model: one distribution, seated and not a plain count."""

import numpy as np
import pytest

pytest.importorskip("pyarrow")

from attestry.llm import pitmanyor as py  # noqa: E402


def test_class_shares_of_every_context_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(py, "CLASS_TOKENS", 60)
    monkeypatch.setattr(py, "PART_TOKENS", 200)
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.6, 20) % 60) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    counts = py.word_counts(docs).toPandas()
    frequent = py.Frequent(counts["word"].to_numpy().view(np.uint64), counts["n"].to_numpy(float), np.zeros(py.SHARED), len(texts), int(counts["n"].sum()))
    assert frequent.classes > 5 and 0 < frequent.own.sum()
    known = spark.sparkContext.broadcast(frequent)
    customers = py.class_customers(docs, known).toPandas()
    assert customers["n"].sum() == frequent.tokens
    shares, packed = py.class_restaurants(docs, known, frequent)
    seats = {}
    for row in packed.collect():
        context, dish, tables = (np.frombuffer(row[n], t) for n, t in (("context", np.int32), ("frequent", np.int32), ("rare", np.float64)))
        assert all(d == row["class"] or d >= frequent.classes for d in dish)
        seats |= {(c, d): t for c, d, t in zip(context.tolist(), dish.tolist(), tables.tolist())}
    n = {(r.context, r.dish): r.n for r in customers.itertuples()}
    assert set(seats) == set(n) and all(1 <= seats[k] <= n[k] for k in n)
    assert any(seats[k] < n[k] for k in n)
    every = np.arange(frequent.dishes)
    for context in {c for c, _ in n} | {len(frequent.words) + 3}:
        served, tables = (np.array([of.get((context, d), 0.0) for d in every]) for of in (n, seats))
        chances = shares.of(np.full(len(every), context), every, served, tables)
        assert np.isclose(chances.sum(), 1.0) and (chances > 0).all()
