import random
import re

import numpy as np
import pytest

from pairlab.llm import near
from pairlab.llm.components import components

SCHEMA = "doc_id long, text string, band string, id int"


def brute(rows):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    top = {i: i for i in sets}
    changed = True
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(top[a], top[b])
            changed |= top[a] != low or top[b] != low
            top[a] = top[b] = low
    return {i: (len(sets[i]), top[i]) for i in sets}


def variants(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = variants(rng, 150, 120, 5) + variants(rng, 40, 60, 3) + [t for _ in range(60) for t in variants(rng, 1, 80, 0)]
    texts += ["same text here with seven words now"] * 20 + ["Short one"] * 3 + ["short ONE", "a b c d e", "A B C D E", None, "", " \n\t", None]
    step = " ".join(f"s{i}" for i in range(60)).split()
    texts += [" ".join(step[i: i + 40]) for i in range(0, 18, 2)]  # a chain: neighbours are alike, ends are not
    rng.shuffle(texts)
    return list(enumerate(texts, start=100))


def test_components_match_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_small_blocks_lose_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_nulls_repeats_and_empty_tables(spark):
    text = "one two three four five six"
    rows = [(None, text), (7, text), (7, text), (9, text), (8, None), (None, None)]
    got = sorted(near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == [(7, 7, True), (7, 7, True), (8, 8, True), (9, 7, False)]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 2
    assert near.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keep_one_keeps_columns_of_clashing_names(spark):
    rows = [(1, "a b c d e f", "x", 1, 5), (2, "a b c d e f", "y", 2, 6), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string, kept int, gone_id int")
    out = near.keep_one(df)
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} == {1, None}


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (5, 5), (None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).read().collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99}


def test_pruning_keeps_pairs_at_the_threshold():
    table = near.prune_table(288, 48, 75, 1e-4)
    rng = np.random.default_rng(0)
    left = rng.integers(0, 60000, (4000, 288)).astype("<u2")
    same = rng.random(left.shape) < 0.75
    assert near.survives(left, np.where(same, left, left + 1), table).mean() > 0.998
    far = rng.random(left.shape) < 0.5
    assert near.survives(left, np.where(far, left, left + 1), table).mean() < 0.001


def test_one_id_with_two_texts_in_a_bucket_is_judged_by_both(spark):
    rng = random.Random(8)
    first, second = variants(rng, 12, 100, 2), variants(rng, 12, 100, 2)
    rows = [(k, t) for k, t in enumerate(first)] + [(100 + k, t) for k, t in enumerate(second)]
    rows += [(50, first[0] + " tail one"), (50, second[0] + " tail two"), (50, second[0] + " tail two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df).collect()}
    alike = brute([(k, t) for k, t in rows if k < 50])
    # the id's texts are like both groups, so both lead to the smallest id of the first
    assert {got[k] for k in alike if alike[k][1] == alike[0][1]} == {got[0]} == {0}
    assert got[50] == 0 and got[100] == 0
    assert sum(r["doc_id"] == 50 for r in near.near_duplicates(df).collect()) == 3


def group_of(n, seed=0):
    """Keys, components, signatures and sets of near copies that are alike below the threshold, mostly."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**62, 200, dtype=np.uint64)
    sets = []
    for _ in range(n):
        own = base.copy()
        at = rng.choice(200, rng.integers(10, 40), replace=False)
        own[at] = rng.integers(0, 2**62, len(at), dtype=np.uint64)
        sets.append(np.sort(own))
    c, a = near.minima(near.BANDS * near.ROWS)
    x = [(s >> np.uint64(32)).astype(np.uint32) for s in sets]
    signature = np.array([[((v ^ c[k]) * a[k]).min() for k in range(len(c))] for v in x]).astype("<u2")
    return np.arange(n), signature, [s.view(np.int64) for s in sets]


@pytest.mark.parametrize("blocks", [None, 2])
def test_links_that_leave_a_block_are_a_forest_and_lose_no_component(blocks):
    table = near.prune_table(288, 48, 75, 1e-4)
    counts = []
    for n in (60, 120, 240):
        keys, signature, sets = group_of(n)
        mine = None if blocks is None else keys % blocks
        links = near.joining_links(keys, keys, mine, signature, [np.sort(s) for s in sets], table, 75)
        assert len(links) < n
        counts.append(len(links))
        top = dict(zip(keys.tolist(), keys.tolist(), strict=True))

        def root(k):
            while top[k] != k:
                k = top[k]
            return k

        for a, b in links:
            assert root(a) != root(b)  # none joins what is joined already
            top[root(a)] = root(b)
        for a in range(n):
            for b in range(a + 1, n):
                common = len(np.intersect1d(sets[a], sets[b]))
                if (mine is None or mine[a] != mine[b]) and 100 * common >= 75 * (400 - common):
                    assert root(a) == root(b)
    assert counts[2] <= 5 * counts[0] + 10


def test_rows_grow_in_proportion_to_a_group_of_near_copies(spark, monkeypatch):
    """Rows that leave the block comparison for one group of near copies, at growing sizes."""
    found = {}
    for n in (250, 500, 1000, 2000):
        rng = random.Random(n)
        base = [f"w{k}" for k in range(200)]
        rows = []
        for k in range(n):
            copy = list(base)
            for _ in range(5):
                copy[rng.randrange(200)] = f"x{rng.randrange(10**9)}"
            rows.append((k, " ".join(copy)))
        out = []
        for name in ("_likeliest", "_verified"):
            real = getattr(near, name)

            def counted(*args, real=real, out=out):
                df = real(*args)
                out.append(df.count())
                return df

            monkeypatch.setattr(near, name, counted)
        near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).write.format("noop").mode("overwrite").save()
        monkeypatch.undo()
        found[n] = sum(out)
    for n in (250, 500, 1000):
        assert found[2 * n] <= 2.6 * found[n] + 200, found
