"""The causal letter network: gradient, padding, batches, training."""

import numpy as np
import pytest

from pairlab.operators import causal as N
from pairlab.operators import scoring as C


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    weights = {k: rng.normal(0, 0.5, s) for k, s in N._SHAPES.items()}
    codes = rng.integers(0, 256, 40)
    around = N.before(codes)
    found = N.gradient(weights, around, codes)
    for name, value in weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name == "embed":
                at = (int(codes[rng.integers(0, 30)]), at[1])
            moved = []
            for step in (1e-5, -1e-5):
                value[at] += step
                moved.append(-N.log_probs(weights, around, codes).mean())
                value[at] -= step
            assert found[name][at] == pytest.approx((moved[0] - moved[1]) / 2e-5, rel=1e-4, abs=1e-8)


@pytest.mark.parametrize("size", [0.5, 5.0])
def test_a_stretch_gives_the_gradient_of_its_places_in_either_precision(size):
    rng = np.random.default_rng(6)
    weights = {k: rng.normal(0, size, s) for k, s in N._SHAPES.items()}
    for n, own in ((1, 0), (3, 0), (1500, 0), (700, 6)):
        codes = np.concatenate([np.full(N.CONTEXT - own, N.SYMBOLS), rng.integers(0, 256, n + own)])
        around = np.stack([codes[N.CONTEXT - 1 - k: len(codes) - 1 - k] for k in range(N.CONTEXT)], axis=1)
        want = N.gradient(weights, around, codes[N.CONTEXT:])
        for kind, near in ((np.float64, 1e-11), (np.float32, 1e-5 * size)):
            found = N.stretch_gradient({k: v.astype(kind) for k, v in weights.items()}, codes)
            assert all(np.allclose(found[k], want[k], rtol=0, atol=near) for k in want)


def test_a_task_trains_in_single_precision_on_every_letter(monkeypatch):
    met = []
    layers = N._layers
    monkeypatch.setattr(N, "_layers", lambda w, x, target: met.append((x.dtype, target)) or layers(w, x, target))
    monkeypatch.setattr(N.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    texts = ["the dog saw the cat " * 30, None, "", "a", "ab" * 50]
    batch = N.pa.RecordBatch.from_arrays([N.pa.array(texts)], names=["t"])
    (out,) = N._fit(N.first_weights(), 0.01, 64)(iter([batch]))
    assert all(kind == np.float32 for kind, _ in met) and max(len(t) for _, t in met) == 64
    assert (np.concatenate([t for _, t in met]) == np.concatenate([N.letters(t or "") for t in texts])).all()
    got = np.concatenate([np.frombuffer(v) for v in out.column(3).to_pylist()]) / out.column(2)[0].as_py()

    own, mean, square = N.first_weights(), {}, {}
    turn = 0
    for text in texts:
        codes = N.letters(text or "")
        for a in range(0, len(codes), 64):
            turn += 1
            for k, g in N.gradient(own, N.before(codes)[a: a + 64], codes[a: a + 64]).items():
                mean[k] = 0.9 * mean.get(k, 0) + 0.1 * g
                square[k] = 0.999 * square.get(k, 0) + 0.001 * g * g
                own[k] = own[k] - 0.01 * np.sqrt(1 - 0.999**turn) / (1 - 0.9**turn) * mean[k] / (np.sqrt(square[k]) + 1e-8)
    assert got == pytest.approx(N.flatten(own), abs=1e-3)


def plain(weights, text):
    codes = N.letters(text)
    return N.log_probs(weights, N.before(codes), codes).mean() if len(codes) else np.nan


TEXTS = ["", "a", "ab", "Hello there", "x" * 700, "日本語 text", "same", "same", "the longest of them all " * 40]


def test_letters_see_only_what_is_before_them():
    a, b = N.before(N.letters("abcdefghij")), N.before(N.letters("abcdeXXXXX"))
    assert (a[:6] == b[:6]).all() and a[0].tolist() == [N.SYMBOLS] * N.CONTEXT and a[2][:3].tolist() == [98, 97, N.SYMBOLS]


@pytest.mark.parametrize("cells", [1, 50, 5000, N.CELLS])
def test_padding_and_batches_change_nothing(cells):
    rng = np.random.default_rng(1)
    weights = {k: rng.normal(0, 0.5, s) for k, s in N._SHAPES.items()}
    want = [plain(weights, t) for t in TEXTS]
    assert N.padded_scores(weights, TEXTS, cells) == pytest.approx(want, abs=1e-6, nan_ok=True)
    assert N.padded_scores(weights, TEXTS[::-1], cells)[::-1] == pytest.approx(want, abs=1e-6, nan_ok=True)


def test_training_learns_and_scoring_does_not_depend_on_partitions(spark):
    rows = [(k, "the cat sat on the mat and the dog sat on the log. " * 6) for k in range(60)] + [(60, None), (61, ""), (62, "zqzq xjxj vvvv")]
    df = spark.createDataFrame(rows, "id int, t string").repartition(3)
    weights = N.train_network(df, "t", rounds=3, rate=0.02, step=256)
    make = N.network_scorer(spark, weights)
    one = {r["id"]: r["score"] for r in C.score_texts(df, "t", make).collect()}
    two = {r["id"]: r["score"] for r in C.score_texts(df.repartition(7), "t", make).collect()}
    assert one[60] is None and one[61] is None and one[0] > -1.5 > one[62]
    assert {k: v for k, v in one.items() if v is not None} == pytest.approx({k: v for k, v in two.items() if v is not None}, abs=1e-9)
    untrained = N.train_network(df.limit(0), "t")
    assert all((untrained[k] == v).all() for k, v in N.first_weights().items())


@pytest.mark.parametrize("size", [1.0, 4000.0])
def test_equal_contexts_are_met_once_in_blocks(monkeypatch, size):
    weights = {k: v * size for k, v in N.first_weights(5).items()}
    codes = N.letters("the dog and the cat and the dog " * 40)
    around = N.before(codes)
    x = weights["embed"][around].reshape(len(codes), -1)
    logit = np.tanh(x @ weights["w1"] + weights["b1"]) @ weights["w2"] + weights["b2"]
    logit -= logit.max(axis=1, keepdims=True)
    want = logit[np.arange(len(codes)), codes] - np.log(np.exp(logit).sum(axis=1))
    met, forward = [], N._forward
    monkeypatch.setattr(N, "_forward", lambda w, some, safe: met.append(len(some)) or forward(w, some, safe))
    assert np.allclose(N.log_probs(weights, around, codes), want, rtol=1e-12, atol=1e-9)
    assert sum(met) == len(np.unique(around, axis=0)) < len(codes) / 10 and max(met) <= N.BLOCK
