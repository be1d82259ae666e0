import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, i int, score string"


def brute(rows, every=50):
    ok = []
    for vec_id, vector, label, *_ in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            ok.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    dim = max((len(v[1]) for v in ok), default=0)
    ok = [(i, v + [0] * (dim - len(v)), c) for i, v, c in ok]
    out = Counter()
    for a, (anchor, v, label) in enumerate(ok):
        if anchor is None or anchor % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), (i is None, i), c) for k, (i, w, c) in enumerate(ok) if k != a), key=lambda s: s[:2])
        for ps, positive, _ in [s for s in scored if s[2] == label][:5]:
            found = [s for s in scored if s[2] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            for rank, (ns, negative, _) in enumerate(found, 1):
                out[anchor, positive[1], rank, negative[1], -ps, -ns] += 1
    return out


def got(df, **how):
    found = N.hard_negatives(df, F.col("vec_id") % 50 == 0, **how)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in found.collect())


def clustered(n, dim, groups, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (groups, dim))
    which = rng.integers(0, groups, n)
    return [(int(k), [float(x) for x in (centres[g] + rng.normal(0, spread, dim)).astype(np.float32)], int(rng.integers(0, 4)), 1, "x") for k, g in enumerate(which)]


@pytest.mark.parametrize("shard_rows", [(40, 60), (2048, 65536)])
def test_matches_brute_force_over_shards(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(N, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(N, "CELL_ROWS", 8)
    rows = clustered(600, 10, 12, 1)
    rows += [(1000 + k, rows[3][1], k % 3, 1, "copy") for k in range(250)]  # one very common vector
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_nulls_repeats_short_vectors_and_empty_tables(spark):
    rows = clustered(120, 5, 3, 2)
    rows += [rows[0], rows[50], rows[7], (None, rows[3][1], 1, 1, "x"), (150, None, 1, 1, "x"), (200, [0.1, None, 0.2, 0.0, 0.1], 1, 1, "x"),
             (250, [0.1, float("nan"), 0.2, 0.0, 0.1], 1, 1, "x"), (300, [float("inf")] * 5, 1, 1, "x"), (350, [0.2] * 5, None, 1, "x"), (400, [0.5, 0.5], 2, 1, "x"), (450, [], 1, 1, "x")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == Counter()
    assert got(spark.createDataFrame(rows[1:40], SCHEMA)) == Counter()


def test_large_components_stay_exact(spark):
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-3e4, 3e4) for _ in range(6)], k % 3, 1, "x") for k in range(101)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_products_choose_exact_arithmetic():
    rng = np.random.default_rng(0)
    for most in (100, 2**20, 2**30):
        a, b = (rng.integers(-most, most, (7, 9)).astype(float) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(r, q, strict=True)) for q in b] for r in a]
        assert [[int(x) for x in line] for line in N.products(a, b)] == [[max(min(w, N._FAR), -N._FAR) for w in line] for line in want]


def test_multi_sequence_visits_pairs_by_falling_sum():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=6), rng.normal(size=9)
    seen = list(N.multi_sequence(a, b))
    assert len({(i, j) for _, i, j in seen}) == 54
    assert [s for s, _, _ in seen] == sorted((s for s, _, _ in seen), reverse=True)
    assert all(s == a[i] + b[j] for s, i, j in seen)


def test_certified_windows_skip_most_cells_of_clustered_rows(monkeypatch):
    rows = clustered(3000, 16, 40, 3, 0.01)
    vectors = N.scaled(np.array([r[1] for r in rows]))
    books = (N.fit_codebook(vectors[:, :8], 40), N.fit_codebook(vectors[:, 8:], 40))
    i, j = N.nearest(vectors[:, :8], books[0]), N.nearest(vectors[:, 8:], books[1])
    ids, labels = np.arange(3000), np.array([r[2] for r in rows])
    shard = N.Shard(16, books, ids, ids, labels, vectors, i, j)
    met = []
    real = N.products
    monkeypatch.setattr(N, "products", lambda r, q: met.append(len(r)) or real(r, q))
    found = shard.search(ids[:1], labels[:1], vectors[:1], [[(-N._FAR, N._FAR)]], 5, True)
    score = vectors @ vectors[0]
    want = [k for k in np.lexsort((ids, -score)) if k != 0 and labels[k] == labels[0]][:5]
    assert [f[3] for f in found] == want and sum(met) < 1000
