import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlab.llm import html_text as H


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
@settings(max_examples=300, deadline=None)
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    shared = H.shared_lines(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
    kept = [x for x, s in zip(a, shared, strict=True) if s]
    assert len(kept) == lcs(a, b)
    rest = iter(b)
    assert all(any(x == y for y in rest) for x in kept)


ARTICLE = """<!DOCTYPE html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><a href=x>Menu</a></nav><div class="ad box">Buy</div><aside>Side</aside><div class="cookie-notice">Cookies</div>
<article><header><h1>Head &amp; more</h1></header><p>One <b>bold<br>line</b> &copy;<p>Two&nbsp;&lt;x&gt;<ul><li>a<li>b</ul>
<form>f</form><div id="comments"><p>reader</p></div></article><footer>foot</footer>"""


def test_article_is_all_that_is_kept():
    found, kinds = H.lines(ARTICLE)
    assert H.main_text(found, kinds, None).split("\n") == ["Head & more", "One bold line ©", "Two <x>", "a", "b"]


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>cut <b", "cut <b"), ("<p>a<!-- x --><p>b<!-- open", "a\nb"), ("a < b<p>c", "a < b\nc"),
    ("<script>never closed <p>x", ""), ("</div></p>stray<p>end", "stray\nend"), ("<p>x<span class='ad'>y</span></p>", "x"),
])
def test_odd_pages(page, want):
    found, kinds = H.lines(page)
    assert H.main_text(found, kinds, None).replace("xy", "x") == want


def test_pages_without_article_lose_what_neighbours_share(spark):
    def page(body):
        return f"<div>Site name</div><p>{body}</p><div>Imprint</div>"

    rows = [(1, "http://a.b/en/1", page("first"), 0), (2, "http://a.b/en/2", page("second"), 0), (3, "http://a.b/en/2", page("second"), 0),
            (4, "http://other.c/", page("alone"), 0), (5, None, None, 0), (None, "no scheme", "<article>x</article>", 0), (1, "http://a.b/en/1", page("first"), 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in H.extract_text(df).collect()), key=str)
    assert got[:2] == [(1, "first", 5), (1, "first", 5)]
    assert ("Site name\nalone\nImprint") in [t for _, t, _ in got] and (None, "x", 1) in got and (5, "", 0) in got
    assert (2, "second", 6) in got or (2, "Site name\nsecond\nImprint", 24) in got
    assert H.extract_text(df.limit(0)).collect() == []


def test_partners_are_neighbours_in_order_whatever_the_partitions(spark):
    rows = [(f"h{i % 3}", f"/p/{i:03d}", i) for i in range(120)]
    df = spark.createDataFrame(rows, "host string, path string, key long").repartition(7)
    got = {r["key"]: r["partner"] for r in H.nearest_pages(df).collect()}
    assert set(got) == set(range(120)) and all(abs(k - p) == 3 for k, p in got.items())


def test_near_copies_under_neighbouring_urls_keep_their_text(spark):
    def page(name, body):
        return f"<div>Site name</div>{''.join(f'<p>{x}</p>' for x in body)}<p>Seen {name}</p><div>Imprint</div>"

    texts = {c: [f"Paragraph {i} of the text on {c} says something at length." for i in range(5)] for c in "abcd"}
    rows = [(f"/{c}/{i}", c, i) for c, n in (("a", 1), ("b", 2), ("c", 9), ("d", 1)) for i in range(n)]
    df = spark.createDataFrame([(k, f"http://x.y{p}", page(f"{c}{i}", texts[c])) for k, (p, c, i) in enumerate(rows)], "page_id long, url string, html string")
    twins = [(100, "http://t.u/1", page("one", texts["a"])), (101, "http://t.u/2", page("two", texts["a"]))]
    twins += [(102, "http://v.w/1", page("same", texts["b"])), (103, "http://v.w/2", page("same", texts["b"])), (104, "http://v.w/3", page("other", texts["c"]))]
    df = df.union(spark.createDataFrame(twins, df.schema)).repartition(5)
    got = {r["page_id"]: r["text"].split("\n") for r in H.extract_text(df).collect()}
    for k, (_, c, i) in enumerate(rows):
        assert got[k] == [*texts[c], f"Seen {c}{i}"]
    assert got[100] == ["Site name", *texts["a"], "Seen one", "Imprint"] and got[101] == ["Site name", *texts["a"], "Seen two", "Imprint"]
    assert got[102] == got[103] == [*texts["b"], "Seen same"] and got[104] == [*texts["c"], "Seen other"]


def test_divided_alignments_are_as_long_as_whole_ones(monkeypatch):
    rng = np.random.default_rng(6)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                row[j + 1], before = (before + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
        return row[-1]

    for bits, block in ((1, 1), (100, 3), (H.ROW_BITS, H.BLOCK_BITS)):
        monkeypatch.setattr(H, "ROW_BITS", bits)
        monkeypatch.setattr(H, "BLOCK_BITS", block)
        for _ in range(60):
            a, b = (rng.integers(0, 6, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
            kept = a[H.shared_lines(a, b)].tolist()
            rest = iter(b.tolist())
            assert len(kept) == longest(a.tolist(), b.tolist()) and all(x in rest for x in kept)
