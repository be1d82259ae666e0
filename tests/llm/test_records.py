import glob
import io
import zlib

import numpy as np
import pytest

from pairlab.llm import records as R
from pairlab.llm.queries import tokenizer_path
from pairlab.llm.tokens import WordTokens
from pairlab.sources.staging import new_folder

PATH = tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start int, shard string"


def rows():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"Word{k}," for k in rng.integers(0, 400, n)) for n in rng.integers(0, 80, 90)]
    texts += [None, "", " \n", "it's ß 日本 <|endoftext|>", "same", "same", "x" * 3000, "long text " * 4000]
    found = [(int(i), t, 1, "s") for i, t in zip(rng.permutation(len(texts)) - 5, texts, strict=True)]
    return found + [(None, "no id", 1, "s"), (3, "another text of id 3", 1, "s"), (3, "another text of id 3", 1, "s")]


def wanted(data):
    """(doc_id, start, ids) by brute force, up to the order of equal ids."""
    whole, at, out = WordTokens(PATH).whole, 0, []
    for name, text, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((name, at, ids))
        at += len(ids)
    return out


@pytest.fixture(scope="module")
def folder(spark):
    path = new_folder(spark, "records")
    R.write_records(spark.createDataFrame(rows(), SCHEMA).repartition(7), PATH, path, shard_bytes=9000)
    return path


def test_files_hold_every_text_in_order(spark, folder):
    got = sorted(R.read_records(spark, folder).collect(), key=lambda r: r["start"])
    want = wanted(rows())
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    at = 0
    for r in got:
        ids = np.frombuffer(r["ids"], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(r["ids"]))
        at += len(ids)
    assert sorted((r["doc_id"] or -99, np.frombuffer(r["ids"], dtype="<u4").tolist()) for r in got) == sorted((w[0] or -99, w[2]) for w in want)
    assert len({r["shard"] for r in got}) > 2


def test_index_leads_to_each_record(spark, folder):
    files = {path.split("/")[-1]: path for path in glob.glob(f"{folder}/shards/part-*")}
    index = R.read_index(spark, folder).collect()
    assert len(index) == len(rows())
    for row in index:
        with open(files[row["shard"]], "rb") as file:
            name, ids = R.record_at(file, row["offset"])
        assert name == row["doc_id"] and len(ids) == row["n_tokens"]
    ends = {row["shard"]: 0 for row in index}
    for row in sorted(index, key=lambda r: (r["shard"], r["record"])):
        assert row["offset"] == ends[row["shard"]]
        ends[row["shard"]] += row["bytes"]


def test_shuffled_reads_are_a_permutation_of_the_seed(spark, folder):
    first = [(r["shard"], r["record"]) for r in R.read_shuffled(spark, folder, 1).collect()]
    again = [(r["shard"], r["record"]) for r in R.read_shuffled(spark, folder, 1).collect()]
    other = [(r["shard"], r["record"]) for r in R.read_shuffled(spark, folder, 2).collect()]
    assert first == again and first != other and sorted(first) == sorted(other)


def test_damage_is_noticed():
    good = R.frame(R.payload_of(5, 2, b"\x01\x00\x02\x00")) + R.frame(R.payload_of(None, 4, b""))
    payload, after = R.payload_at(good, 0)
    assert R.record(payload)[0] == 5 and R.record(payload)[1].tolist() == [1, 2]
    assert R.record(R.payload_at(good, after)[0])[0] is None
    for place in range(after):
        bad = bytearray(good)
        bad[place] ^= 4
        with pytest.raises(ValueError):
            R.payload_at(bytes(bad), 0)
        with pytest.raises(ValueError):
            R.record_at(io.BytesIO(bytes(bad)), 0)
    with pytest.raises(ValueError):
        R.payload_at(good[: after - 3], 0)


def test_empty_table(spark):
    path = new_folder(spark, "records")
    R.write_records(spark.createDataFrame([], SCHEMA), PATH, path)
    assert R.read_records(spark, path).collect() == [] and R.read_index(spark, path).collect() == []


@pytest.mark.parametrize("slice_bytes", [7, 64, 1 << 20])
def test_ids_don_t_depend_on_slices_or_the_cache(monkeypatch, slice_bytes):
    from pairlab.llm import tokens, words

    monkeypatch.setattr(words, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(tokens, "CACHED_PARTS", 40)
    rng = np.random.default_rng(1)
    letters = list("aAbB'st1 29.,<|>éÉÀß×÷ ÿ\t\n\x1c\x85ĿIİµ日 '' ")
    texts = ["".join(rng.choice(letters, n)) for n in rng.integers(0, 60, 120)] + ["don't 'S 's's !'s", "y" * 300, ""]
    own = WordTokens(PATH)
    ids, n = own.encode([t.encode() for t in texts])
    want = [own.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_bases_add_up_over_groups_of_shards(spark, folder, monkeypatch):
    want = sorted(map(tuple, R.read_index(spark, folder).collect()))
    monkeypatch.setattr(R, "GROUP", 2)
    assert sorted(map(tuple, R.read_index(spark, folder).collect())) == want
    assert len({row[0] for row in want}) > 4
