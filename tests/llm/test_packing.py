import zlib
from collections import defaultdict

import numpy as np
import pytest

from pairlab.llm import packing
from pairlab.llm.queries import tokenizer_path
from pairlab.llm.tokens import WordTokens

PATH = tokenizer_path("word_bpe_49k.json")


def check(fillings, counts, capacity):
    placed = np.zeros_like(counts)
    for sizes, times in fillings:
        assert sum(sizes) <= capacity and times > 0
        for s in sizes:
            placed[s] += times
    assert (placed == counts).all()
    return sum(n for _, n in fillings)


@pytest.mark.parametrize("seed", range(8))
def test_every_piece_is_placed_within_a_bin_of_the_bound(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(3, 1, rng.integers(1, 3000)).astype(int), 1, 100)
    counts = np.bincount(sizes, minlength=101)
    assert check(packing.best_fit_decreasing(counts, 100), counts, 100) >= -(-sizes.sum() // 100)
    assert check(packing.bin_completion(counts, 100), counts, 100) <= -(-int(sizes.sum()) // 100) + 1


def test_search_beats_best_fit_decreasing():
    counts = np.zeros(101, dtype=np.int64)
    for size, n in ((44, 4), (24, 4), (22, 4), (27, 4), (21, 8), (20, 4), (42, 0)):
        counts[size] += n
    best = check(packing.best_fit_decreasing(counts, 100), counts, 100)
    assert check(packing.bin_completion(counts, 100), counts, 100) <= best
    assert packing.bin_completion(np.zeros(101, dtype=np.int64), 100) == []


TEXTS = ["Hello, world's  BEST\nday!", "éÀ ß²½ _x_ <|endoftext|> a<|startoftext|>b", "ΑΣ ΟΔΟΣ İstanbul ﬁne   é 'S 'll don't", "", " \t\n", "\x1c\x85 日本語 テキスト 12345", "x" * 500]


def test_ids_equal_the_tokenizer_on_whole_texts():
    tokens = WordTokens(PATH)
    for _ in range(2):  # new words, then known ones
        ids, n = tokens.encode([t.encode() for t in TEXTS])
        want = [tokens.whole.encode(t, add_special_tokens=False).ids for t in TEXTS]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_pack_reads_back(spark):
    rng = np.random.default_rng(2)
    texts = [*TEXTS, None, *(" ".join(f"w{k}" for k in rng.integers(0, 50, rng.integers(1, 60))) for _ in range(80)), "same text"] + ["same text"] * 30
    rows = [(i, t, 3) for i, t in enumerate(texts)] + [(None, "no id", 3), (0, TEXTS[0], 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(6)
    got = packing.pack(df, PATH, capacity=64, with_ids=True).collect()
    tokens = WordTokens(PATH)
    pieces = defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"]].append(r)
    for doc_id, text in [(r[0], r[1]) for r in rows[1:-1]]:
        mine = sorted(pieces[doc_id], key=lambda r: r["piece"])
        ids = np.frombuffer(b"".join(r["ids"] for r in mine), dtype="<u4").tolist()
        assert ids == [*tokens.whole.encode(text or "", add_special_tokens=False).ids, 0]
        assert [r["start"] for r in mine] == list(range(0, len(ids), 64))
    assert len(pieces[0]) == 2 * len({r["piece"] for r in pieces[0]})
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= -(-sum(r["length"] for r in got) // 64) + 1
    assert packing.pack(df.limit(0), PATH).collect() == []


def fewest(sizes, capacity):
    """Fewest bins by trying every way, largest first, with bins told apart by their room only."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def place(at, rooms):
        if len(rooms) >= best[0]:
            return
        if at == len(sizes):
            best[0] = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= sizes[at]}):
            left = list(rooms)
            left.remove(room)
            place(at + 1, sorted([*left, room - sizes[at]]))
        place(at + 1, sorted([*rooms, capacity - sizes[at]]))

    place(0, [])
    return best[0]


def test_small_cases_end_at_the_optimum():
    rng = np.random.default_rng(17)
    for _ in range(400):
        sizes = rng.integers(18, 60, rng.integers(8, 15))
        counts = np.bincount(sizes, minlength=101)
        assert check(packing.bin_completion(counts, 100), counts, 100) == fewest(sizes.tolist(), 100)
