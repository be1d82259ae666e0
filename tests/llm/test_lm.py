import math
import random

import numpy as np

from pairlab.llm import lm


def test_gradient_matches_differences():
    net = {k: v.astype(np.float64) for k, v in lm.first_network().items()}
    rng = np.random.default_rng(1)
    around, target = rng.integers(0, lm.VOCABULARY + 1, (40, 4)), rng.integers(0, lm.VOCABULARY, 40)
    grad = lm.gradient(net, around, target)
    for k, g in grad.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        step = 1e-5
        net[k][at] += step
        up = -lm.log_probs(net, around, target).mean()
        net[k][at] -= 2 * step
        down = -lm.log_probs(net, around, target).mean()
        net[k][at] += step
        assert math.isclose((up - down) / (2 * step), g[at], rel_tol=1e-3, abs_tol=1e-7)


def test_probabilities_sum_to_one():
    net = lm.first_network()
    around = np.array([[1, 2, lm.VOCABULARY, 9]])
    total = sum(np.exp(lm.log_probs(net, np.repeat(around, 256, 0), np.arange(a, a + 256))).sum() for a in range(0, lm.VOCABULARY, 256))
    assert abs(total - 1) < 1e-4


def test_learns_order_and_scores_defined_cases(spark):
    rng = random.Random(2)
    days = [f"d{i}" for i in range(20)]
    texts = []
    for _ in range(300):
        at = rng.randrange(20)
        texts.append(" ".join(days[(at + i) % 20] for i in range(30)))
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(500, None, 1), (501, "", 1), (502, "d3", 1), (None, texts[0], 1), (503, " ".join(rng.sample(days, 20)), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, log_prob int").repartition(3)
    model = lm.train(docs.select("text"), rounds=3, rate=0.02, batch=16)
    got = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    mean = np.mean([got[i]["mean_log_prob"] for i in range(300)])
    assert mean > -math.log(20) + 1  # far better than word frequencies alone
    assert got[503]["mean_log_prob"] < mean - 1
    assert got[500]["n_tokens"] == 0 and got[501]["log_prob"] == 0 and got[501]["mean_log_prob"] is None and got[502]["n_tokens"] == 1
    assert got[None]["log_prob"] == got[0]["log_prob"]
    empty = docs.limit(0)
    assert lm.pseudo_likelihood(empty).collect() == []


def test_every_word_has_its_own_probability(spark):
    named = " ".join(f"n{i}" for i in range(lm.NAMED))
    rare = {f"r{i}": 1 + i % 7 for i in range(900)}
    texts = [named] * 9 + [" ".join([w] * n) for w, n in rare.items()]
    corpus = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    rows = [(i, w) for i, w in enumerate(rare)] + [(1000, "n5 r1 r2 n6 R1"), (1000, "n5 r1 r2 n6 R1"), (1001, "unseen"), (1002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = []
    for cached in (lm.CACHED, lm.NAMED):
        model = lm.train(corpus, rounds=1, cached=cached)
        got = sorted((r["doc_id"], r["n_tokens"], r["log_prob"]) for r in lm.score(docs, model).collect())
        assert len(got) == len(rows) and got[900] == got[901] and got[900][1] == 5 and got[-1] == (1002, 0, 0.0)
        found.append(got)
    assert all(math.isclose(a[2], b[2], rel_tol=1e-6) for a, b in zip(*found, strict=True))
    score = dict(enumerate(x[2] for x in found[0][:900]))
    word_hash = {w: int(h) for w, h in zip(rare, _hashes(list(rare)), strict=True)}
    by_class = {}
    for i, w in enumerate(rare):
        by_class.setdefault(word_hash[w] % lm.BUCKETS, []).append(i)
    names, of_class = list(rare), {}
    for b, members in by_class.items():  # one-word texts: the class is as likely for all, the words are as their counts
        first = members[0]
        for i in members:
            assert math.isclose(score[i] - score[first], math.log(rare[names[i]] / rare[names[first]]), abs_tol=1e-4)
        of_class[b] = sum(math.exp(score[i]) for i in members)
    assert sum(of_class.values()) < 1


def _hashes(words):
    (part,) = lm.W.slices(lm.pa.array(words))
    return part.hashes(lower=True)


def test_rows_far_below_the_largest_keep_their_softmax():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (50, 32)).astype(np.float32)
    x[7] -= 5000.0  # would vanish beside the others
    exact = x.astype(np.float64) - x.max(axis=1, keepdims=True)
    exact = np.exp(exact) / np.exp(exact).sum(axis=1, keepdims=True)
    assert np.allclose(lm._softmax(x.copy()), exact, rtol=1e-5) and lm._log_share(x[:0].copy(), np.zeros(0, dtype=int)).shape == (0,)
    at = rng.integers(0, 32, 50)
    assert np.allclose(lm._log_share(x.copy(), at), np.log(exact[np.arange(50), at]), atol=1e-3)


def test_words_are_found_whatever_their_leading_bits():
    rng = np.random.default_rng(5)
    near = np.arange(2**62, 2**62 + 40, 3, dtype=np.uint64)  # one range of leading bits
    keys = np.unique(np.concatenate([near, rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2), np.array([0, 2**64 - 1], dtype=np.uint64)]))
    hashes = np.concatenate([keys, keys + np.uint64(1), keys - np.uint64(1), rng.integers(0, 2**63, 500, dtype=np.uint64)])
    at, known = lm.Places(keys).of(hashes)
    assert (known == np.isin(hashes, keys)).all() and (keys[at[known]] == hashes[known]).all()
    assert not lm.Places(keys[:0]).of(hashes)[1].any()
