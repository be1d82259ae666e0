import re

import pytest

import corpus_pipeline
from pairlab.llm.tables import Staged, table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows of the input and of each stage."""
    docs = table(spark, SMALL, "documents")
    out = [(docs.columns, docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = Staged(stage(spark, docs, SMALL), name).read()
        out.append((docs.columns, docs.collect()))
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_filters_keep_columns_and_only_remove(stages):
    for (before, rows), (after, kept) in zip(stages[:4], stages[1:5], strict=True):
        assert after == before
        assert {r["doc_id"] for r in kept} <= {r["doc_id"] for r in rows}


def test_near_duplicates_are_gone(stages):
    sets = []
    for r in stages[2][1]:
        w = words(r["text"].lower())
        sets.append({tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    assert not any(100 * len(a & b) >= 75 * len(a | b) for k, a in enumerate(sets) if a for b in sets[k + 1:])


def test_no_passage_repeats(stages):
    before, after = stages[2][1], stages[3][1]
    assert len(before) == len(after)
    seen = {}
    for r in before:
        w = words(r["text"])
        for i in range(len(w) - 34):
            seen.setdefault(tuple(w[i: i + 35]), []).append(r["doc_id"])
    cut = {d for places in seen.values() if len(places) > 1 for d in places}
    texts = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        assert (r["text"] != texts[r["doc_id"]]) == (r["doc_id"] in cut)
        assert r["n_chars"] == len(r["text"])


def test_last_stage_packs_every_document(stages):
    assert {r["doc_id"] for r in stages[5][1]} == {r["doc_id"] for r in stages[4][1]}


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages[5][1])


ODD = "doc_id long, text string, lang string, component string, kept int, n_words int, score double, id long, __spans int, label int"


def odd_rows():
    twin = " ".join(f"word{k}" for k in range(60))
    texts = [(1, twin), (1, twin), (2, twin + " end"), (3, None), (4, ""), (5, " \n\t"), (None, "no id here"), (None, None), (6, "short"), (7, "Short"), (8, "x" * 50_000)]
    return [(i, t, None, "c", 1, 2, 0.5, 7, 3, None) for i, t in texts]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_input(spark, name):
    """Null ids and texts, repeated rows, clashing names, no n_chars; and empty tables."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    out = stage(spark, docs, SMALL)
    got = out.collect()
    empty = stage(spark, docs.limit(0), SMALL)
    assert empty.columns == out.columns and empty.collect() == []
    ids = sorted((r["doc_id"] or -1 for r in got))
    if name == "packing":
        assert set(ids) == {-1, 1, 2, 3, 4, 5, 6, 7, 8}
        return
    assert out.columns == docs.columns
    if name == "near_dedup":  # the smallest id of a group stays, with its repeated rows
        assert ids == [-1, -1, 1, 1, 3, 4, 5, 6, 8]
    else:
        assert ids == [-1, -1, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    texts = {r["doc_id"]: r["text"] for r in got}
    assert texts[3] is None and texts[6] == "short"
    if name == "substring_dedup":
        assert not texts[1] and texts[2] == "end"
