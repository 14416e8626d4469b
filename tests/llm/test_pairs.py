"""Embedding near-duplicates, the n-gram join and components."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from foliospark.llm import ngram_join, rp_forest
from foliospark.llm.components import components


def united(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 470)] + [(500, 500 + i) for i in range(200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = united({x for link in links for x in link}, links)
    assert got == {n: c for n, c in expected.items() if n != c}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(rng, n, size):
    base = rng.standard_normal((n, size))
    near = base[rng.integers(0, n // 3, n)] + rng.standard_normal((n, size)) * rng.uniform(0.05, 0.45, (n, 1))
    return np.r_[base, near]


@pytest.mark.parametrize("block", [rp_forest.BLOCK, 32])
def test_forest_finds_links(spark, monkeypatch, block):
    monkeypatch.setattr(rp_forest, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = vectors(rng, 600, 32)
    x = np.r_[x, x[:5], x[:1] + rng.standard_normal((120, 32)) * 0.02]
    labels = [int(v) if v < 3 else None for v in rng.integers(0, 4, len(x))]
    labels[-125:] = labels[:5] + [0] * 120
    odd = [(5000, None, 1), (5001, [0.0] * 32, 1), (5002, [float("nan")] + [1.0] * 31, 1), (5003, [None] + [1.0] * 31, 1), (5004, [float("inf")] * 32, 1), (None, x[0].tolist(), 0), (5005, [], 1), (5006, [1.0] * 8, 1)]
    rows = [(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, labels))] + odd
    table = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    got = {r["vec_id"]: r for r in rp_forest.near_duplicates(table, leaf=24).collect()}
    assert len(got) == len(rows)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    true = [(i, j) for i in range(len(x)) for j in range(i) if labels[i] is not None and labels[i] == labels[j] and cos[i, j] >= 0.93]
    links = Counter(i for pair in true for i in pair)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found >= 0.99 * 2 * len(true) and all(got[i]["n_links"] <= links[i] for i in range(len(x)))
    parts = united(range(len(x)), true)
    assert np.mean([got[i]["component_id"] == parts[i] for i in range(len(x))]) > 0.99
    for i, _, _ in odd:
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert rp_forest.near_duplicates(table.limit(0)).count() == 0


def test_extreme_finite_vectors(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.0001e200]), (3, [1e-200, 1e-200]), (4, [1.0, 1.0]), (5, [1e-310, -1e-310]), (6, [3.0, -3.0]), (7, [1e308, 0.0]), (8, [1e308, 1e308])]
    got = rp_forest.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 8: (4, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def brute(rows, percent=80):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in united(sets, links).items()}, len(links)


def edited(rng, words, rate):
    return [rng.choice(VOCABULARY) if rng.random() < rate else w for w in words]


VOCABULARY = [f"w{i}" for i in range(400)] + ["Straße", "ÉTÉ", "été", "\xa0x"]


def test_shingles_by_plain_sets():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "B", "b ", " ", "\n", "É", "\x0b", "x\x00", "日 "]) for _ in range(rng.randrange(60))) for _ in range(400)] + ["", " "]
    own = ngram_join.shingle_sets(texts)
    plain = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        plain.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    assert [len(s) for s in own] == [len(s) for s in plain]
    for i in range(0, len(texts), 7):
        for j in range(i):
            assert len(set(own[i].tolist()) & set(own[j].tolist())) == len(plain[i] & plain[j])


@pytest.mark.parametrize("longest", [14, 160])
def test_join_by_brute_force(spark, longest):
    rng = random.Random(longest)
    passage = [rng.choice(VOCABULARY) for _ in range(max(4, longest // 4))]
    rows = []
    for i in range(60):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randrange(4, longest))]
        for k in range(rng.choice([1, 2, 6])):
            text = edited(rng, words, rng.choice([0, 0.01, 0.02, 0.05]))
            if rng.random() < 0.3:
                text = text + passage
            rows.append((len(rows) * 3, rng.choice([" ", "\n", "  "]).join(text)))
    hot = [rng.choice(VOCABULARY) for _ in range(longest)]
    rows += [(2000 + i, " ".join(edited(rng, hot, 0.01))) for i in range(120)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one"), (3004, "ONE"), (3005, "one two"), (3006, "x " * 30_000)]
    rows += [(3010 + i, rows[0][1]) for i in range(5)]
    expected, links = brute(rows)
    assert links > 100
    table = spark.createDataFrame([(*r, "extra") for r in rows] + [(None, "one", "extra"), (rows[4][0], rows[4][1], "again")], "doc_id long, text string, n_shingles string")
    answers = ngram_join.jaccard_join(table).collect()
    assert len(answers) == len(rows) + 2
    for r in answers:
        if r["doc_id"] is None:
            assert (r["n_shingles"], r["component_id"]) == (1, None)
        else:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]], r["doc_id"]
    assert ngram_join.jaccard_join(table.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0, 5, 12])
def test_light_limit_changes_nothing(spark, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "light_limit", lambda *a: limit)
    rng = random.Random(limit)
    rows = []
    for _ in range(50):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randrange(6, 22))]
        rows += [(len(rows) + k, " ".join(words[k % 2 : len(words) - k // 2])) for k in range(4)]
    expected, links = brute(rows)
    assert links > 20
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected


def test_light_limit_follows_cost():
    assert ngram_join.light_limit({}, 1.0, 80) == 0
    assert ngram_join.light_limit({3: 10, 4: 10, 200: 10}, 50.0, 80) >= 4
    assert ngram_join.light_limit({12: 10_000}, 0.0, 80) < 12
