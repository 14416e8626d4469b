"""Whitening: exact sums against Python numbers, the whole query against numpy, odd vectors."""

import math

import numpy as np
import pytest

from foliospark.llm import QUERIES, whitening
from foliospark.llm.whitening import MOST, scatter, whiten, whole

SCHEMA = "vec_id long, embedding array<double>, n long"


@pytest.mark.parametrize("high", [1, 1000, 1 << 40, MOST])
@pytest.mark.parametrize("rows", [1, 63, 64, 700])
def test_scatter_is_exact(high, rows):
    x = np.random.default_rng(rows).integers(-high, high, (rows, 5))
    x[:, 3] = 7
    sums, products = scatter(x)
    plain = x.astype(object)
    assert sums == [int(v) for v in plain.sum(0)]
    assert products == [int((plain[:, d] * plain[:, e]).sum()) for d in range(5) for e in range(d, 5)]


def plainly(vectors, components):
    """n, exact deviations, whitened values up to sign, shares: Python numbers for sums, numpy for the components."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, width = len(x), len(x[0])
    total = [sum(row[d] for row in x) for d in range(width)]
    deviations = [sum((n * row[d] - total[d]) ** 2 for d in range(width)) for row in x]
    centred = np.array([[row[d] - total[d] / n for d in range(width)] for row in x])
    covariance = centred.T @ centred / n
    values, parts = np.linalg.eigh(covariance)
    keep = np.argsort(-values)[:components]
    return n, deviations, centred @ parts[:, keep] / np.sqrt(values[keep]), values[keep] / np.trace(covariance)


def test_query_against_numpy(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op12_embedding_whitening"](spark, folder).toPandas()
    given = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    n, deviations, white, shares = plainly(given["embedding"].tolist(), 8)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[given["vec_id"]].to_numpy()
    assert (got["n"] == n).all() and list(got.columns)[:3] == ["vec_id", "component", "n"]
    assert got[got["component"] == 1].set_index("vec_id").loc[given["vec_id"], "deviation"].tolist() == deviations
    assert np.abs(wide * np.sign((white * wide).sum(0)) - white).max() < 1e-9
    assert np.allclose(got.groupby("component")["explained"].first(), shares, rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_odd_vectors(table):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=3)], 1) for i in range(30)]
    rows = good + good[:2] + [(None, [1.0, 2.0, 3.0], None), (50, None, 1), (51, [1.0, None, 2.0], 1), (52, [1.0, float("nan"), 2.0], 1)]
    rows += [(53, [1.0, 2.0, float("-inf")], 1), (54, [], 1), (55, [1.0, 2.0], 1), (56, [0.0, 0.0, 0.0], 1)]
    got = whiten(table(rows, SCHEMA)).collect()
    used = [r for r in rows if r[0] in (None, 56, *range(30))]
    n, deviations, _, _ = plainly([r[1] for r in used], 3)
    assert len(got) == 3 * n and {r["n"] for r in got} == {n}
    assert sorted(r["deviation"] for r in got) == sorted(deviations * 3)
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_constant_single_and_empty(table):
    same = whiten(table([(1, [2.0, 2.0], 1), (2, [2.0, 2.0], 1)], SCHEMA)).collect()
    assert len(same) == 4 and {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same} == {(None, 0.0, None, 0)}
    flat = whiten(table([(1, [2.0, 5.0], 1), (2, [2.0, 7.0], 1)], SCHEMA)).collect()
    assert sorted((r["component"], r["whitened"] is None) for r in flat) == [(1, False), (1, False), (2, True), (2, True)]
    assert {round(abs(r["whitened"]), 12) for r in flat if r["component"] == 1} == {1.0}
    assert len(whiten(table([(1, [1.0], 1)], SCHEMA)).collect()) == 1
    assert whiten(table([], SCHEMA)).collect() == [] and whiten(table([(1, None, 1)], SCHEMA)).collect() == []


def test_extreme_entries(table):
    rows = [(1, [1e300, 0.5], 1), (2, [-1e300, 0.25], 1), (3, [0.0, 1.0], 1)]
    got = {r["vec_id"]: r for r in whiten(table(rows, SCHEMA)).where("component = 1").collect()}
    x = whole(np.array([r[1] for r in rows])).astype(object)
    total = x.sum(0)
    want = [int(((3 * row - total) ** 2).sum()) for row in x]
    assert [got[i]["deviation"] for i in (1, 2, 3)] == [d if d < 2**63 else None for d in want]
    assert [got[i]["deviation_exact"] for i in (1, 2, 3)] == [d if d < 10**38 else None for d in want]


def test_more_rows_than_a_block(table, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=4)], 1) for i in range(200)]
    got = whiten(table(rows, SCHEMA).repartition(3)).where("component = 1").collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == dict(enumerate(plainly([r[1] for r in rows], 4)[1]))
