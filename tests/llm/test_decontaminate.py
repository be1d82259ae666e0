import time

import pytest

from pairlab.llm import decontaminate as D

ITEM = "The quick brown fox jumps over the lazy dog and then it sleeps all day long, truly"
BENCH = [(1, ITEM), (2, "tiny item"), (3, None), (4, "?!"), (10, ITEM), (None, "null id item here")]
DOCS = [
    (1, "Before " + ITEM.upper() + " after.", "x"), (2, "one two tiny; ITEM three", "x"), (3, None, "x"), (4, "", "x"), (5, "clean words only", "x"),
    (5, "clean words only", "x"), (None, ITEM, "x"), (6, ITEM + " " + "filler " * 600, "x"), (7, "THE quick brown fox jumps", None),
]


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, found string")
    return docs, spark.createDataFrame(BENCH, "item_id long, text string")


def test_contract_columns(tables):
    got = {}
    for r in D.contamination(*tables).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]))
    assert got == {
        1: [(19, 17, 2, True)], 2: [(5, 2, 1, True)], 3: [(0, 0, 0, False)], 4: [(0, 0, 0, False)], 5: [(3, 0, 0, False)] * 2,
        None: [(17, 17, 2, True)], 6: [(617, 17, 2, False)], 7: [(5, 0, 0, False)],
    }


def test_large_benchmarks_take_the_join_with_equal_results(tables, monkeypatch):
    first = sorted(map(tuple, D.contamination(*tables).collect()), key=str)
    monkeypatch.setattr(D.with_hits, "__defaults__", ("text", 1))
    assert sorted(map(tuple, D.contamination(*tables).collect()), key=str) == first


def test_removal_of_documents_and_spans(tables):
    docs, bench = tables
    kept = D.remove_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 5, 6, 7]
    cut = {r["doc_id"]: r["text"] for r in D.remove_spans(docs, bench).collect()}
    assert cut[1] == "Before after." and cut[2] == "one two three" and cut[3] is None and cut[5] == "clean words only"


def test_empty_tables(tables, spark):
    docs, bench = tables
    assert D.contamination(docs.limit(0), bench).collect() == []
    assert not any(r["contaminated"] for r in D.contamination(docs, bench.limit(0)).collect())


def test_clashing_columns_pass_on_both_paths(tables, monkeypatch):
    docs, bench = tables
    odd = docs.selectExpr("*", *[f"1 AS {c}" for c in ("__spans", "spans_of", "_spans_of", "text_key", "windows", "n_words", "n_hit", "near", "id")])
    kept = sorted(map(tuple, D.remove_documents(odd, bench).collect()), key=str)
    cut = sorted(map(tuple, D.remove_spans(odd, bench).collect()), key=str)
    assert len(kept) == 6 and len(cut) == len(DOCS)
    monkeypatch.setattr(D.with_hits, "__defaults__", ("text", 0))
    assert sorted(map(tuple, D.remove_documents(odd, bench).collect()), key=str) == kept
    assert sorted(map(tuple, D.remove_spans(odd, bench).collect()), key=str) == cut
    assert D.remove_documents(odd, bench).columns == odd.columns


def test_words_covered_by_many_runs_are_counted_in_one_pass(spark):
    """Every third word of a long text is hit: counts equal brute force, and twice the runs don't take four times the time."""
    bench = spark.createDataFrame([(1, "hit"), (2, "hit two"), (3, "two words more")], "item_id long, text string")
    times = []
    for n in (16_000, 64_000):
        text = "hit two miss " * n + "two words more"
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        started = time.time()
        row = D.contamination(docs, bench).first()
        times.append(time.time() - started)
        assert (row["n_words"], row["n_hit"], row["n_items"]) == (3 * n + 3, 2 * n + 3, 3)
    assert times[1] < 8 * times[0] + 5
    small = spark.createDataFrame([(1, "a hit, two; miss hit. end")], "doc_id long, text string")
    assert D.remove_spans(small, bench).first()["text"] == "a miss end"
