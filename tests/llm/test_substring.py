import hashlib
import random
import re
from collections import Counter

import pytest

from pairlab.llm import substring


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i: i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i: i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("local", [200, 1 << 20])
def test_matches_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(substring, "LOCAL_BYTES", local)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(14)]
    texts = []
    for _ in range(60):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(4): 14 - rng.randrange(4)]
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
    texts += [texts[0], None, "", "  ", "é " * 30, "a b c a b c a b c a b c a b c"]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, dedup_key int").repartition(4)
    out = substring.remove_repeated(df, window=6)
    got = sorted(out.collect(), key=lambda r: r["doc_id"])
    assert [(r["_n_words"], r["n_removed"], r["kept_sha256"]) for r in got] == brute(texts, 6)
    for r, t in zip(got, texts, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        assert hashlib.sha256(" ".join(w).encode()).hexdigest() == r["kept_sha256"]
        assert r["n_removed"] or r["text"] == t


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (None, text + " tail"), (2, "other words"), (None, None)]
    got = substring.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["n_words"], r["n_removed"], r["text"]) for r in got if r["text"] is not None) == [(2, 0, "other words"), (40, 40, ""), (40, 40, ""), (41, 40, "tail")]
    assert substring.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_places_of_one_passage_are_dealt_out(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text) for i in range(160)]
    keyed = spark.createDataFrame(rows, "key long, text string").repartition(40)
    dealt = keyed.mapInArrow(substring._hash_rows(35, 24), "bucket int, hashes binary, keys binary, counts binary, gaps binary")
    local = Counter(r["bucket"] for r in dealt.where("length(hashes) = 0").collect())
    assert sum(local.values()) >= 30 and max(local.values()) <= sum(local.values()) // 4
    found = {r["key"]: b"".join(r["places"]) for r in substring.repeated_windows(keyed).collect()}
    assert set(found) == set(range(160)) and all(len(p) == 4 * 6 for p in found.values())
