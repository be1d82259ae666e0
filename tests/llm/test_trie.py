import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from pairlab.llm import trie


def brute(talks):
    """{(depth, smallest member): row} of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for conv, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in members}
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def total(p):
        below = [total(q) for q in children[p]]
        return (sum(b[0] for b in below) or 1, (len(members[p]) - 1) * words[p] + sum(b[1] for b in below))

    out = {}
    for p, convs in members.items():
        leaves, saved = total(p)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(talks[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        out[len(p), min(convs)] = (parent, len(convs), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def rows_of(df):
    got = df.collect()
    out = {(r["depth"], r["conv_id"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got}
    assert len(out) == len(got)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, before string, node int"


def talks(seed, n, longest, kinds):
    rng = random.Random(seed)
    found = {}
    for c in range(n):
        start = found[rng.randrange(c)][: rng.randrange(longest)] if c and rng.random() < 0.7 else []
        found[c] = start + [(rng.choice(["user", "assistant", ""]), " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(kinds)))) for _ in range(rng.randrange(longest))]
    return {c * 7 - 40: t for c, t in found.items()}


def frame(spark, found):
    rows = [(c, k * 2, r, t, "x", 1) for c, turns in found.items() for k, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


@pytest.mark.parametrize("width", [1, 2, 8])
def test_nodes_match_brute_force(spark, width):
    found = talks(width, 70, 21, 3)
    members = spark.createDataFrame([(c,) for c in found], "conv_id long")
    got = rows_of(trie.prefix_trie(members, trie.numbered_turns(frame(spark, found)), width))
    assert got == brute(found)


def test_many_copies_and_a_long_conversation(spark):
    line = [("user", f"turn {k}") for k in range(60)]
    found = {c: line[:30] for c in range(200)} | {500: line, 501: line, 502: [], 503: line[:1] + [("user", "else")]}
    members = spark.createDataFrame([(c,) for c in found] * 2, "conv_id long")
    assert rows_of(trie.prefix_trie(members, trie.numbered_turns(frame(spark, found)))) == brute(found)


def test_nulls_ties_repeats_and_empty_tables(spark):
    data = [(1, 5, "user", "b", None, None), (1, None, "user", "first", None, None), (1, 5, None, "z", None, None), (1, 5, "user", "a", None, None),
            (2, 1, "user", None, None, None), (2, 1, "user", None, None, None), (None, 1, "user", "lost", None, None)]
    talk = spark.createDataFrame(data, SCHEMA)
    got = rows_of(trie.prefix_trie(talk.select("conv_id"), trie.numbered_turns(talk)))
    want = {1: [("user", "first"), ("", "z"), ("user", "a"), ("user", "b")], 2: [("user", ""), ("user", "")]}
    assert got == brute(want)
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(empty.select("conv_id"), trie.numbered_turns(empty)).collect() == []


def test_borrowed_starts(spark):
    found = talks(9, 60, 9, 3)
    talk = frame(spark, found)
    turns = trie.numbered_turns(talk)
    want = {}
    for c, own in ((c, t) for c, t in found.items() if t):
        h, lender = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c > 0 else -1)
        want[c] = found.get(lender, [])[:h] + own[h:]
    got = rows_of(trie.prefix_trie(talk.select("conv_id"), trie.with_borrowed_starts(talk, turns)))
    assert got == brute(want)
