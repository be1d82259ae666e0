import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlab.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té \x1cß", max_size=30)), max_size=8)


@given(TEXTS, st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_words_of_slices_match_a_regular_expression(texts, limit):
    found = []
    for part in W.slices(pa.array(texts, pa.string()), limit):
        raw = part.buf.tobytes()
        for i in range(part.n_docs):
            a, b = part.first[i], part.first[i + 1]
            found.append([raw[x:y].decode() for x, y in zip(part.starts[a:b], part.ends[a:b], strict=True)])
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_hashes_do_not_depend_on_place_and_lower_only_ascii():
    (one,) = W.slices(pa.array(["x Foo bar É", "foo BAR é"]))
    a, b = one.hashes(lower=True)[1:3], one.hashes(lower=True)[4:6]
    assert (a == b).all()
    assert one.hashes(lower=True)[3] != one.hashes(lower=True)[6]
    assert one.hashes()[1] != one.hashes()[4]


def test_window_hashes_equal_only_for_equal_windows():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abc"), 40)) for _ in range(6)]
    (part,) = W.slices(pa.array(texts))
    where = W.inside_document(part.first, 5)
    values = part.hashes()
    hashes = W.window_hashes(values, 5)[where]
    words = [w for t in texts for w in t.split()]
    grams = [tuple(words[i: i + 5]) for i in where]
    assert len(set(zip(grams, hashes.tolist(), strict=True))) == len(set(grams)) == len(set(hashes.tolist()))
    assert len(where) == 6 * 36
    assert (W.run_hashes(values, where, where + 5) == hashes).all()


def test_slice_of_an_array_and_empty_array():
    column = pa.array(["skip", "a b", None, "c"]).slice(1)
    parts = list(W.slices(column))
    assert sum(p.counts().sum() for p in parts) == 3
    assert list(W.slices(pa.array([], pa.string()))) == []


def test_covered():
    assert W.covered(np.array([1, 2, 8]), 3, 10).tolist() == [False, True, True, True, True, False, False, False, True, True]
