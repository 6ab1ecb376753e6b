"""The Pareto set against all pairs."""

import random

import pytest

from quillon.operators import skyline


def better(a, b):
    return all(x >= y for x, y in zip(a, b)) and any(x > y for x, y in zip(a, b))


def measures(row):
    bad = float("-inf")
    a, b, c = row[1:]
    return tuple(bad if v is None or v != v else s * v for v, s in ((a, 1), (b, 1), (c, -1)))


@pytest.mark.parametrize("block", [1 << 13, 7])
def test_skyline_by_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(skyline, "BLOCK", block)
    r = random.Random(2)
    value = lambda: r.choice([None, float("nan"), *range(12)]) if r.random() < 0.2 else r.choice([r.random() * 12, float(r.randrange(12))])
    rows = [(k, *(float(v) if v is not None else None for v in (value(), value(), value()))) for k in range(300)]
    rows += [(k, float(k % 40), float(40 - k % 40), 0.0) for k in range(300, 400)]  # many that none dominates, and ties
    want = [row[0] for row in rows if not any(better(measures(o), measures(row)) for o in rows)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double").repartition(5)
    got = skyline.skyline(df, ["a", "b"], ["c"])
    assert got.columns == df.columns and sorted(r.k for r in got.collect()) == want and len(want) > 60


def test_edges(spark):
    schema = "k long, a double"
    assert skyline.skyline(spark.createDataFrame([], schema), ["a"], []).collect() == []
    assert sorted(r.k for r in skyline.skyline(spark.createDataFrame([(1, None), (2, None)], schema), ["a"], []).collect()) == [1, 2]
    assert [r.k for r in skyline.skyline(spark.createDataFrame([(1, None), (2, 3.0), (3, 4.0)], schema), [], ["a"]).collect()] == [2]
    with pytest.raises(ValueError):
        skyline.skyline(spark.createDataFrame([], schema), [], [])


def test_reservoir_is_stable_and_uniform(spark):
    """A rerun draws the same rows, whatever their order, and over many seeds every row is drawn about as often."""
    from collections import Counter

    from quillon.operators import evaluate

    rows = spark.range(40).withColumnRenamed("id", "k")
    draw = lambda df, seed: sorted(r.k for r in evaluate.reservoir(df, "k", 10, seed).collect())
    assert draw(rows, 1) == draw(rows.repartition(5).orderBy(rows.k.desc()), 1) != draw(rows, 2)
    counts = Counter(k for seed in range(60) for k in draw(rows, seed))
    assert len(counts) == 40 and sum(counts.values()) == 600
    assert sum((n - 15) ** 2 / 15 for n in (counts[k] for k in range(40))) < 76  # chi square of 39 degrees, 1 in 3,000; a draw without repeats varies less
