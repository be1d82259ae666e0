"""Main text of web pages: structure first, then line differences with the nearest page of the host.

A page is parsed into lines, one per block.  Lines in menus, headers, footers, sidebars, notices,
adverts, forms, comments and the like are marked by element, role and class; lines inside an article or
main element are its content.  Pages are ordered by path within their host, and each is paired
with the neighbour whose path shares the longer beginning with its own.  A neighbour that holds most of a page's
text is a copy and tells nothing about furniture: pages without an article look past copies, on both sides, to
the nearest page that is none, and keep all their text if there is none.  The lines of the two pages are aligned
by a longest common subsequence, and shared lines outside an article are deleted.  Lines inside an
article are never deleted as shared: two articles may well quote the same passage.

No host is gathered anywhere: neighbours come from a range partitioning of short rows, whose
partition ends are stitched together through one row per partition.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from pairlab.llm.native import LOWER, UPPER
from pairlab.llm.tables import Staged
from pairlab.operators.numbering import number_rows

# Element names and class words, as HTML and common page templates use them.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset(
    "aside button canvas dialog footer form head header iframe menu nav noscript object script select style svg template textarea title".split()
)
RAW = frozenset("script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
CLASSES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related "
    "replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[A-Za-z]+")

ARTICLE, OTHER, FURNITURE = 2, 1, 0
#: Percent of the characters of a page's text lines that make another page a copy of it.
COPY = 80


def _is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED:
        return not (tag == "header" and in_article)
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return True
        if name in ("class", "id"):
            words = [w for part in re.split(r"[\s]+", value) for w in re.split(r"[-_]+", part)]
            if any(w in CLASSES for w in words) and tag not in ("article", "main"):
                return True
            if tag == "article" and ("comment" in words or "comments" in words):
                return True
    return False


def lines(page: str | None) -> tuple[list[str], list[int]]:
    """Lines of a page in order, and the kind of each: ARTICLE, OTHER or FURNITURE."""
    out: list[str] = []
    kinds: list[int] = []
    text: list[str] = []
    kind = OTHER
    stack: list[tuple[str, int]] = []  # open block elements and the kind outside each
    at = 0
    page = page or ""

    def close_line() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            out.append(line)
            kinds.append(kind)

    while True:
        match = _TAG.search(page, at)
        if not match:
            text.append(page[at:])
            break
        if match.start() > at:
            text.append(page[at: match.start()])
        at = match.end()
        tag = match[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCKS and tag not in DROPPED:
            # an inline element may carry a furniture class of its own
            if match[1] or tag in VOID or not match[3] or not _is_furniture(tag, match[3], kind == ARTICLE):
                if match[1] and any(name == tag for name, _ in stack):
                    close_line()
                    kind = _pop(stack, tag, kind)
                continue
        close_line()
        if match[1]:
            kind = _pop(stack, tag, kind)
            continue
        if tag in VOID or match[3].endswith("/"):
            continue
        if tag in ("p", "li", "option", "dt", "dd", "tr", "td", "th"):
            if stack and stack[-1][0] == tag:  # its end tag is optional
                kind = stack.pop()[1]
        stack.append((tag, kind))
        if kind != FURNITURE:
            if _is_furniture(tag, match[3], kind == ARTICLE):
                kind = FURNITURE
            elif tag in ("article", "main"):
                kind = ARTICLE
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            if tag in ("textarea", "title"):
                text.append(page[at: end.start() if end else len(page)])
                close_line()
            at = end.end() if end else len(page)
            kind = _pop(stack, tag, kind)
    close_line()
    return out, kinds


def _pop(stack: list[tuple[str, int]], tag: str, kind: int) -> int:
    """Close ``tag`` and what is open inside it; an end tag of nothing open is ignored."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == tag:
            kind = stack[k][1]
            del stack[k:]
            break
    return kind


def line_hashes(found: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x) for x in found], dtype=np.uint64)


#: Bits of the rows that an alignment keeps at once, and lines of one block of bits where it keeps lengths only.
ROW_BITS, BLOCK_BITS = 100_000_000, 4096


def shared_lines(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of ``mine`` lie on a longest common subsequence with ``other``.

    Bit-parallel, one row of bits per line, where the rows fit ``ROW_BITS``; longer alignments are divided at the middle line
    of ``mine``, at the place of ``other`` that halves leave the longest, from two rows of lengths only.
    """
    shared = np.zeros(len(mine), dtype=bool)
    n, m = len(mine), len(other)
    head = 0
    while head < min(n, m) and mine[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and mine[n - 1 - tail] == other[m - 1 - tail]:
        tail += 1
    shared[:head] = True
    shared[n - tail:] = True
    todo = [(head, n - tail, head, m - tail)]
    while todo:
        a, z, c, y = todo.pop()
        if a == z or c == y:
            continue
        if z - a == 1 or (z - a) * (y - c) <= ROW_BITS:
            shared[a:z] = _on_common(mine[a:z].tolist(), other[c:y].tolist())
            continue
        middle = (a + z) // 2
        upper = _common_lengths(mine[a:middle].tolist(), other[c:y].tolist())
        lower = _common_lengths(mine[middle:z][::-1].tolist(), other[c:y][::-1].tolist())[::-1]
        cut = c + int(np.argmax(upper + lower))
        todo += [(a, middle, c, cut), (middle, z, cut, y)]
    return shared


def _common_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` with each prefix of ``b``; bits of ``b`` go in blocks, with a carry for each line of ``a``."""
    known, carry, steps = set(a), bytearray(len(a)), [np.zeros(1, dtype=np.int64)]
    for at in range(0, len(b), BLOCK_BITS):
        block = b[at: at + BLOCK_BITS]
        size, places = len(block), {}
        for j, x in enumerate(block):
            if x in known:
                places[x] = places.get(x, 0) | 1 << j
        full = (1 << size) - 1
        v = full
        for i, x in enumerate(a):
            u = v & places.get(x, 0)
            total = v + u + carry[i]
            carry[i] = total >> size
            v = (total & full) | (v - u)
        bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-size // 8), "little"), dtype=np.uint8), bitorder="little")[:size]
        steps.append(1 - bits.astype(np.int64))
    return np.cumsum(np.concatenate(steps))


def _on_common(a: list[int], b: list[int]) -> np.ndarray:
    """Which of ``a`` lie on a longest common subsequence with ``b``."""
    shared = np.zeros(len(a), dtype=bool)
    known, places = set(a), {}
    for j, x in enumerate(b):
        if x in known:
            places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [full], full
    for x in a:
        # a zero bit j of v: the best alignment of the lines so far with b[:j + 1] beats that with b[:j]
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    j = len(b)
    for i in range(len(a), 0, -1):
        if a[i - 1] not in places:
            continue
        mask = (1 << j) - 1
        if (~rows[i] & mask).bit_count() > (~rows[i - 1] & mask).bit_count():
            shared[i - 1] = True
            best = (~rows[i] & mask).bit_count()
            while (~rows[i - 1] & ((1 << j) - 1)).bit_count() != best - 1 or b[j - 1] != a[i - 1]:
                j -= 1
            j -= 1
    return shared


def main_text(found: list[str], kinds: list[int], partner: np.ndarray | None) -> str:
    """Article lines if there are any; else the lines that are neither furniture nor shared with the partner.

    Where that leaves nothing, because the pages are alike, every line that is no furniture stays.
    """
    kind = np.array(kinds, dtype=np.int64)
    if (kind == ARTICLE).any():
        keep = kind == ARTICLE
    else:
        content = kind == OTHER
        keep = content.copy()
        if partner is not None and len(partner) and len(found):
            keep &= ~shared_lines(line_hashes(found), partner)
        keep = keep if keep.any() else content
    return "\n".join(x for x, k in zip(found, keep, strict=True) if k)


def text_weights(found: list[str], kinds: list[int]) -> bytes:
    """Characters of each line that is no furniture, else 0; nothing for a page that needs no partner."""
    if ARTICLE in kinds or OTHER not in kinds:
        return b""
    return np.array([len(x) if k == OTHER else 0 for x, k in zip(found, kinds, strict=True)], dtype="<i4").tobytes()


@F.pandas_udf(BooleanType())
def _is_copy(lines: pd.Series, weights: pd.Series, other: pd.Series) -> pd.Series:
    """Whether the lines of the other page hold most of the text of this one."""
    out = []
    for mine, weight, theirs in zip(lines, weights, other, strict=True):
        weight = np.frombuffer(weight, dtype="<i4").astype(np.int64)
        shared = np.isin(np.frombuffer(mine, dtype=np.uint64), np.frombuffer(theirs, dtype=np.uint64))
        out.append(100 * int(weight[shared].sum()) >= COPY * int(weight.sum()))
    return pd.Series(out, dtype=bool, index=lines.index)


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [lines(x.as_py()) for x in batch.column(3)]
        arrays = [pa.array([line_hashes(x).tobytes() for x, _ in found], pa.binary()), pa.array([text_weights(*x) for x in found], pa.binary())]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *arrays], names=["key", "host", "path", "lines", "weights"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, partner in zip(batch.column(2), batch.column(3), strict=True):
            other = partner.as_py()
            texts.append(main_text(*lines(page.as_py()), None if other is None else np.frombuffer(other, dtype=np.uint64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


@F.pandas_udf(BooleanType())
def _before_is_nearer(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    """Ties go to the page before; a missing neighbour is never nearer."""
    pairs = zip(path, before.fillna(""), after.fillna(""), strict=True)
    return (pd.Series([_common(p, x) >= _common(p, y) for p, x, y in pairs], dtype=bool, index=path.index) | after.isna()) & ~before.isna()


def nearest_pages(places: DataFrame) -> DataFrame:
    """(key, partner): the neighbour of each page in order of (host, path, key) within its host."""
    ranged = places.select("host", "path", "key").repartitionByRange("host", "path", "key").withColumn("part", F.spark_partition_id())
    ranged = Staged(ranged, "places").read()
    ends = ranged.groupBy("part").agg(F.min(F.struct("host", "path", "key")).alias("low"), F.max(F.struct("host", "path", "key")).alias("high"))
    order = Window.orderBy("part")  # one row per partition
    ends = ends.select("part", F.lag("high").over(order).alias("before_part"), F.lead("low").over(order).alias("after_part"))
    within = Window.partitionBy("part").orderBy("host", "path", "key")
    me = F.struct("host", "path", "key")
    near = ranged.select("*", F.lag(me).over(within).alias("b"), F.lead(me).over(within).alias("a")).join(ends, "part")
    near = near.withColumns({"b": F.coalesce("b", "before_part"), "a": F.coalesce("a", "after_part")})
    same = near.select(
        "key", "path", F.when(F.col("b.host") == F.col("host"), F.col("b")).alias("b"), F.when(F.col("a.host") == F.col("host"), F.col("a")).alias("a")
    )
    chosen = F.when(_before_is_nearer("path", "b.path", "a.path"), F.col("b.key")).otherwise(F.col("a.key"))
    return same.select("key", chosen.alias("partner")).where("partner is not null")


def past_copies(hashed: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (key, partner) with the partners that are copies replaced by the nearest page of the host that is none, if any.

    Pages are numbered in order.  A page looks both ways; where it meets a copy, it goes on where that
    copy has got to on the same side, so a run of n copies takes about log n rounds.
    """
    texts = hashed.select("key", "lines", "weights")
    other = hashed.select(F.col("key").alias("partner"), F.col("lines").alias("other"))
    copied = texts.where("length(weights) > 0").join(pairs, "key").join(other, "partner").where(_is_copy("lines", "weights", "other")).select("key")
    copied = Staged(copied, "copied").read()
    if copied.isEmpty():
        return pairs
    numbered = Staged(number_rows(hashed.select("key", "host", "path"), ["host", "path", "key"], "number"), "numbered").read()
    looking = numbered.join(copied, "key").select(
        "key", "host", "path", (F.col("number") - 1).alias("before"), (F.col("number") + 1).alias("after"), F.lit(True).alias("before_open"), F.lit(True).alias("after_open")
    )
    looking = Staged(looking, "looking").read()
    while not looking.where("before_open or after_open").isEmpty():
        moved = looking
        for side, step in (("before", -1), ("after", 1)):
            there = numbered.select(F.col("number").alias(side), F.col("key").alias("partner"), "host")
            met = looking.where(f"{side}_open").select("key", "host", side).join(there, [side, "host"]).join(texts, "key").join(other, "partner")
            met = met.where(_is_copy("lines", "weights", "other")).select("key", "partner", (F.col(side) + step).alias("next"))
            seen = looking.select(F.col("key").alias("partner"), F.col(side).alias("seen"))
            met = met.join(seen, "partner", "left").select("key", F.coalesce("seen", "next").alias("next"))
            moved = moved.join(met, "key", "left").withColumns({side: F.coalesce("next", side), f"{side}_open": F.col("next").isNotNull()}).drop("next")
        looking = Staged(moved, "looking").read()
    for side, name in (("before", "b"), ("after", "a")):
        there = numbered.select(F.col("number").alias(side), "host", F.struct("path", "key").alias(name))
        looking = looking.join(there, [side, "host"], "left")
    chosen = F.when(_before_is_nearer("path", "b.path", "a.path"), F.col("b.key")).otherwise(F.col("a.key"))
    found = looking.select("key", chosen.alias("partner")).where("partner is not null")
    return pairs.join(copied, "key", "left_anti").select("key", "partner").unionByName(found)


def extract_text(pages: DataFrame, id_column: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    Defined cases: a null or empty page has an empty text; a null url, or one without ``://``, has an
    empty host and path and is paired among its like; equal rows are one page for the pairing and
    get a result each; a page alone on its host, or with nothing but copies there, has no partner; cut-off markup is read to its end; an
    empty table gives an empty table; other columns are left out.
    """
    text = F.coalesce(F.col(url), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    keyed = pages.select(
        F.xxhash64(id_column, url, page).alias("key"), F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(text, pattern, 2).alias("path"), F.col(id_column).alias("id"), F.col(url).alias("url"), F.col(page).alias("page"),
    )
    hashed = keyed.select("key", "host", "path", "page").mapInArrow(_hash_lines, "key long, host string, path string, lines binary, weights binary")
    hashed = Staged(hashed.dropDuplicates(["key"]), "lines").read()
    pairs = past_copies(hashed, Staged(nearest_pages(hashed), "pairs").read())
    pairs = pairs.join(hashed.select(F.col("key").alias("partner"), "lines"), "partner").select("key", "lines")
    joined = keyed.select("key", "id", "url", "page").join(pairs, "key", "left").select("id", "url", "page", "lines")
    schema = f"id {dict(pages.dtypes)[id_column]}, url string, text string"
    out = joined.mapInArrow(_extract, schema)
    return out.select(F.col("id").alias(id_column), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))
