import random

import pytest

from pairlab.llm import toxicity as T


def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "grumpfeln", "grumpfelt", "grumpfelst", "grumpfelig"])
        rows.append((i, " ".join(w), "x", 1))
        if i % 3 != 1:
            labels.append((i, int(toxic)))
    return rows + [(1000, None, "x", 1), (1001, "", "x", 1), (None, "you idiot", "x", 1), (1002, "fine " * 20000 + "grumpfelnd", "x", 1)], labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, row int").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_defined_cases(tables):
    docs, labels = tables
    got = {r["doc_id"]: r for r in T.toxicity(docs, labels).collect()}
    held = [i for i in range(900) if got[i]["held_out"]]
    assert 150 < len(held) < 300
    right = sum(got[i]["predicted"] == int(i % 6 == 0) for i in held)
    assert right / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 904
    assert got[1000]["score"] == got[1001]["score"] < 0.3 and got[None]["predicted"] == 1 and got[None]["held_out"] is False


def test_labels_of_one_kind_or_none(tables):
    docs, labels = tables
    few = docs.limit(5)
    assert {r["score"] for r in T.toxicity(few, labels.limit(0)).collect()} == {0.0}
    assert T.toxicity(docs.limit(0), labels).collect() == []


def test_removal_keeps_columns(tables):
    docs, labels = tables
    out = T.remove_toxic(docs, labels)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert None not in kept and {1000, 1001} <= kept


def test_features():
    words, stems = frozenset({"idiot"}), frozenset({"grump"})
    one = dict(zip(T.FEATURES, T.Measure(words, stems)("You are an 1d10t!! GRUMPY i.d.i.o.t idiooot"), strict=True))
    assert one["hidden_any"] == 1 and one["stem_any"] == 1 and one["second_near"] > 0 and one["exclamations"] > 0
    assert T.Measure(words, stems)("") == [0.0] * len(T.FEATURES)
