"""Whitening against numpy over all rows, in exact arithmetic where the result is exact."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, id string, component string, deviation string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z", "w") for i, v in rows], SCHEMA).repartition(3)


def usable(rows):
    return [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(np.float32(c)) for c in v)]


def brute(rows, most=8):
    rows = usable(rows)
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, size = len(x), len(x[0])
    sums = [sum(v[k] for v in x) for k in range(size)]
    cov = [[float(Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in x), n**3)) for j in range(size)] for i in range(size)]
    values, vectors = np.linalg.eigh(np.array(cov))
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    centred = np.array([[float(Fraction(n * v[k] - sums[k], n)) for k in range(size)] for v in x])
    deviation = [sum((n * v[k] - sums[k]) ** 2 for k in range(size)) for v in x]
    return n, deviation, centred @ vectors / np.sqrt(values), values / np.trace(np.array(cov))


def random_rows(seed, n=60, size=6):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, size)) @ rng.normal(size=(size, size)) + rng.normal(size=size) * 5
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]


@pytest.mark.parametrize("most", [2, 8])
def test_equals_exact_statistics(spark, most):
    rows = random_rows(1)
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] + [0.0] * 5), (903, [float("inf")] + [0.0] * 5), (904, []), (905, [-float("inf")] * 6)]
    more = [(None, rows[0][1]), (7, rows[7][1])]  # no id, a repeated row
    got = whitening.whiten(spark, frame(spark, [*rows, *bad, *more]), components=most).collect()
    n, deviation, whitened, explained = brute([*rows, *more], most)
    assert len(got) == n * min(most, 6) and all(r["n"] == n for r in got)
    want = {}
    for (i, _), d, w in zip([*rows, *more], deviation, whitened, strict=True):
        want.setdefault(i, []).append((d, w))
    for r in got:
        assert int(r["deviation"]) == want[r["vec_id"]][0][0]
        assert abs(abs(r["whitened"]) - abs(want[r["vec_id"]][0][1][r["component"] - 1])) < 1e-8
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
        assert r["identity_error"] < 1e-9
    # One sign for all rows of a component.
    for k in range(min(most, 6)):
        own = [(r["whitened"], want[r["vec_id"]][0][1][k]) for r in got if r["component"] == k + 1]
        assert len({np.sign(a * b) for a, b in own if abs(b) > 1e-6}) == 1


def test_small_variance_at_large_offset(spark):
    rows = [(i, [1000.0 + (i % 2) / 1024, 2.0 - (i % 3) / 1024]) for i in range(30)]
    got = whitening.whiten(spark, frame(spark, rows)).collect()
    _, deviation, whitened, _ = brute(rows)
    assert len(got) == 60
    for r in got:
        assert int(r["deviation"]) == deviation[r["vec_id"]]
        assert abs(abs(r["whitened"]) - abs(whitened[r["vec_id"]][r["component"] - 1])) < 1e-8


def test_immense_entries_stay_exact(spark):
    rows = random_rows(3, 20, 3) + [(100, [3e12, 1.0, 2.0]), (101, [-3e12, 1e9, 2.0])]
    got = {r["vec_id"]: r for r in whitening.whiten(spark, frame(spark, [*rows, (102, [1e30, 0.0, 0.0])])).where("component = 1").collect()}
    _, deviation, _, _ = brute(rows)
    assert set(got) == {i for i, _ in rows}
    for (i, _), d in zip(rows, deviation, strict=True):
        assert int(got[i]["deviation"]) == d if d < 10**38 else got[i]["deviation"] is None


def test_without_variance_or_rows(spark):
    assert whitening.whiten(spark, frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    empty = whitening.whiten(spark, frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = whitening.whiten(spark, frame(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])).collect()
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12


def test_other_lengths_are_left_out(spark):
    rows = random_rows(5, 10, 4)
    got = whitening.whiten(spark, frame(spark, [*rows, (50, [1.0]), (51, [1.0] * 5)])).select("vec_id").distinct().collect()
    assert {r[0] for r in got} == {i for i, _ in rows}


def test_triangle_is_one_aggregation(spark):
    rows, size = whitening.whole_vectors(frame(spark, random_rows(2)).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "v", ["id"])
    stats = whitening.statistics(rows, size)
    assert stats.products.shape == (6, 6) and np.allclose(stats.covariance(), np.cov(np.array([[math.floor(1024 * c) for c in v] for _, v in random_rows(2)]).T, bias=True))
