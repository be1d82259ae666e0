"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

A document is the set of its distinct 5-word shingles.  Documents with equal sets are one
class, told by a 128-bit fingerprint, and only one of each class goes on, under a key of its own.  48 bands of 6 minima
name candidates: a pair at the similarity of 0.75 shares no band once in 12,000 times.  Candidate
pairs compare their signatures a batch of rows at a time and are dropped as soon as the posterior
probability of a similarity of 0.75 or more, from a uniform prior, is below ``MISS``.  Survivors
are confirmed on full sets.

No bucket is expanded into all its pairs.  First every member meets only the smallest key of
its bucket, and then, where a bucket's members are still in different components, the member that is
likeliest to be like it.  Buckets that are split even then are compared inside tasks, in blocks of bounded
size that bring the full sets along: every pair of different components that survives the Bayesian test is
verified there, and only links that join two components leave the task, so a block of n members gives n - 1 rows
at most and no link is lost.  Hot buckets are split into pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm import words as W
from pairlab.llm.components import components
from pairlab.llm.tables import Staged, fresh

SHINGLE = 5
BANDS, ROWS = 48, 6
#: Rows compared between two looks at the posterior, and the chance at which a pair is given up.
BATCH, MISS = 48, 1e-4
#: Members of one block when a bucket is compared inside a task, and shingles of a block that brings sets along.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: Similarity threshold in percent.
PERCENT = 75

_SKETCH = "id long, n_shingles long, print_a long, print_b long, bands array<long>, signature binary"


def minima(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of the minimum hashes: x -> (x ^ c) * a modulo 2**32, a odd."""
    c = (W.spread(count, 101) >> np.uint64(32)).astype(np.uint32)
    a = (W.spread(count, 202) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return c, a


def shingle_sets(part: W.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted within it, and where each document's begin.

    A document of fewer words than a shingle, but not none, has its whole sequence as one.
    """
    values = part.hashes(lower=True)
    counts = part.counts()
    where = W.inside_document(part.first, size)
    doc = part.doc_of_word()[where]
    short = np.flatnonzero((counts > 0) & (counts < size))
    hashes = np.concatenate([
        W.window_hashes(values, size)[where] if len(where) else np.zeros(0, dtype=np.uint64),
        W.run_hashes(values, part.first[short], part.first[short + 1]),
    ])
    doc = np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, doc = hashes[keep], doc[keep]
    return hashes, np.searchsorted(doc, np.arange(part.n_docs + 1))


def _sketch(bands: int, rows: int):
    c, a = minima(bands * rows)
    row_weight = W.spread(rows, 303)
    band_salt = W.spread(bands, 404)[:, None]
    out = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("print_a", pa.int64()), ("print_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column(1)):
                hashes, at = shingle_sets(part)
                n = np.diff(at)
                full = np.flatnonzero(n)
                low = np.zeros((len(full), len(c)), dtype=np.uint32)
                begin = at[full]
                x = (hashes >> np.uint64(32)).astype(np.uint32)
                prints = _prints(hashes, at)
                if len(full):
                    for k in range(len(c)):
                        low[:, k] = np.minimum.reduceat((x ^ c[k]) * a[k], begin)
                grouped = low.reshape(len(full), bands, rows).astype(np.uint64)
                names = W.mix((grouped * row_weight).sum(axis=2, dtype=np.uint64) ^ band_salt.T).view(np.int64)
                position = np.full(part.n_docs, -1)
                position[full] = np.arange(len(full))
                lists, signatures = [], []
                small = low.astype("<u2")
                for p in position:
                    lists.append(names[p] if p >= 0 else None)
                    signatures.append(small[p].tobytes() if p >= 0 else None)
                rows_of = batch.slice(part.at, part.n_docs)
                yield pa.RecordBatch.from_arrays([
                    rows_of.column(0), pa.array(n, pa.int64()), pa.array(prints[0]),
                    pa.array(prints[1]), pa.array(lists, pa.list_(pa.int64())), pa.array(signatures, pa.binary()),
                ], schema=out)

    return run


def prune_table(total: int, batch: int, percent: int, miss: float) -> list[tuple[int, int]]:
    """(rows compared, fewest matches to go on): below that, P(similarity >= percent | matches) < miss.

    With a uniform prior the posterior tail is a binomial sum: P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(batch, total + 1, batch):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def survives(left: np.ndarray, right: np.ndarray, table: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature matrices pass every look at the posterior."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int64)
    done = 0
    for n, least in table:
        matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        alive = alive[matches[alive] >= least]
        done = n
    out = np.zeros(len(left), dtype=bool)
    out[alive] = True
    return out


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(len(column), -1)


def _likely(pairs: DataFrame, signatures: DataFrame, table: list[tuple[int, int]]) -> DataFrame:
    """Pairs (a, b) that survive the comparison of their signatures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keep = survives(_signatures(batch["left"]), _signatures(batch["right"]), table)
                yield batch.loc[keep, ["a", "b"]]

    left = signatures.select(F.col("key").alias("a"), F.col("signature").alias("left"))
    right = signatures.select(F.col("key").alias("b"), F.col("signature").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInPandas(run, "a long, b long").distinct()


def _blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """Copies of members for each pair of blocks (i, j) of their bucket that their own block is in."""
    mine = F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int")
    copies = members.withColumn("blocks", blocks.cast("int")).withColumn("mine", mine)
    copies = copies.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = [F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")]
    return copies.select("band", *pair, *[c for c in copies.columns if c not in ("band", "blocks", "other", "n", "size")])


def _likeliest(members: DataFrame, table: list[tuple[int, int]]) -> DataFrame:
    """Each member's pair with the most equal rows, of those of other components in its bucket that survive.

    ``members`` has band, key, component, signature, n (members of the bucket).
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        signature = _signatures(group["signature"])
        keys, component, mine = (group[c].to_numpy() for c in ("key", "component", "mine"))
        one_block = group["i"].iloc[0] == group["j"].iloc[0]
        found = set()
        for k in range(len(keys)):
            rows = np.flatnonzero((component != component[k]) & (one_block | (mine != mine[k])))
            if len(rows):
                rows = rows[survives(np.broadcast_to(signature[k], (len(rows), signature.shape[1])), signature[rows], table)]
            if len(rows):
                best = rows[np.argmax((signature[rows] == signature[k]).sum(axis=1))]
                found.add((min(keys[k], keys[best]), max(keys[k], keys[best])))
        return pd.DataFrame(sorted(found), columns=["a", "b"]).astype("int64")

    copies = _blocks(members.drop("size"), F.ceil(F.col("n") / BLOCK))
    return copies.groupBy("band", "i", "j").applyInPandas(run, "a long, b long").distinct()


def joining_links(keys: np.ndarray, component: np.ndarray, mine: np.ndarray | None, signature: np.ndarray, sets: list[np.ndarray], table: list[tuple[int, int]], percent: int) -> list[tuple[int, int]]:
    """Verified links that join components, a forest: one less than there are members at most.

    Without ``mine`` all members meet each other, else those of different blocks.  Sets are sorted.
    """
    _, part = np.unique(component, return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    found = []
    for k in range(len(keys)):
        others = np.arange(k + 1, len(keys))
        others = others[(part[others] != part[k]) & (True if mine is None else mine[others] != mine[k])]
        if not len(others):
            continue
        others = others[survives(np.broadcast_to(signature[k], (len(others), signature.shape[1])), signature[others], table)]
        if not len(others):
            continue
        flat = np.concatenate([sets[r] for r in others])
        at = np.minimum(np.searchsorted(sets[k], flat), sizes[k] - 1)
        common = np.add.reduceat((sets[k][at] == flat).astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
        for r in others[100 * common >= percent * (sizes[others] + sizes[k] - common)]:
            if part[r] != part[k]:
                part[part == part[r]] = part[k]
                found.append((int(min(keys[k], keys[r])), int(max(keys[k], keys[r]))))
    return found


def _verified(members: DataFrame, table: list[tuple[int, int]], percent: int) -> DataFrame:
    """Links between different components of a bucket, found and verified in blocks inside tasks.

    ``members`` has band, key, component, signature, shingles, and n and size, members and shingles of the bucket.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys, component, mine = (group[c].to_numpy() for c in ("key", "component", "mine"))
        one_block = group["i"].iloc[0] == group["j"].iloc[0]
        sets = [np.sort(x) for x in group["shingles"]]
        links = joining_links(keys, component, None if one_block else mine, _signatures(group["signature"]), sets, table, percent)
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    copies = _blocks(members, F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)))
    return copies.groupBy("band", "i", "j").applyInPandas(run, "a long, b long").distinct()


def _prints(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128-bit fingerprint of each non-empty set, 0 for empty ones."""
    full = np.flatnonzero(np.diff(at))
    prints = np.zeros((2, len(at) - 1), dtype=np.uint64)
    if len(full):
        for p, salt in enumerate(W.spread(2, 505)):
            prints[p, full] = np.add.reduceat(W.mix(hashes ^ salt), at[full])
    return prints.view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch.column(0)):
            hashes, at = shingle_sets(part)
            sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, _prints(hashes, at)), sets], names=["print_a", "print_b", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("right"))
    common = F.size(F.array_intersect("left", "right"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(100 * common >= percent * (F.size("left") + F.size("right") - common)).select("a", "b")


def _split(members: DataFrame, final: DataFrame) -> DataFrame:
    """Members of the buckets of three or more that lie in several components, with their component."""
    placed = members.where("n > 2").join(final.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    split = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    return placed.join(split, "band").select("band", "key", "component", "n", "size")


def _same_id(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between classes that hold different texts of one id."""
    several = nodes.groupBy("id").agg(*[f(c).alias(f"{n}_{c}") for c in ("print_a", "print_b") for n, f in (("low", F.min), ("high", F.max))])
    several = several.where("low_print_a <> high_print_a or low_print_b <> high_print_b").select("id")
    keyed = nodes.select("id", "print_a", "print_b", "n_shingles").join(several, "id", "left_semi").join(classes, ["print_a", "print_b", "n_shingles"]).select("id", "key").distinct()
    return keyed.groupBy("id").agg(F.min("key").alias("a")).join(keyed.withColumnRenamed("key", "b"), "id").where("a <> b").select("a", "b")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    component_id is the smallest id that links lead to, the document's own included; kept says
    that it is the document's own.

    Defined cases: null, empty and blank texts have no shingles, link with nothing and are kept;
    a text of fewer than five words is one shingle; rows with a null id link with nothing, have a
    null component_id and are kept; rows that share an id are judged each by its own text, and what
    links to one of them leads to that id; an empty table gives an empty table.  Long texts are read whole, one slice of memory each.
    """
    table = prune_table(BANDS * ROWS, BATCH, percent, MISS)
    prints = ["print_a", "print_b", "n_shingles"]
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    sketched = Staged(source.mapInArrow(_sketch(BANDS, ROWS), _SKETCH), "sketches")
    sketches = sketched.read()
    nodes = sketches.where("n_shingles > 0 and id is not null")
    classes = Staged(nodes.groupBy(*prints).agg(F.min("id").alias("head")).withColumn("key", F.monotonically_increasing_id()), "classes")
    heads = nodes.join(classes.read(), prints).where("id = head")
    heads = Staged(heads.select("key", "id", *prints, "bands", "signature").dropDuplicates(["key"]), "heads")
    signatures = heads.read().select("key", "signature")
    banded = heads.read().select("key", "n_shingles", F.explode("bands").alias("band"))
    buckets = Staged(
        banded.groupBy("band").agg(F.min("key").alias("a"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size")).where("n > 1"), "buckets"
    )
    members = Staged(banded.join(buckets.read(), "band").select("band", "key", "a", "n", "size"), "members")
    wanted = heads.read().join(members.read().select("key").distinct(), "key", "left_semi").select("id", "print_a", "print_b", "key")
    texts = source.join(wanted.select("id").distinct(), "id", "left_semi").select("text")
    told = texts.mapInArrow(_sets, "print_a long, print_b long, shingles array<long>").dropDuplicates(["print_a", "print_b"])
    sets = Staged(told.join(wanted, ["print_a", "print_b"]).select("key", "shingles"), "shingles")
    stars = members.read().where("key <> a").select("a", F.col("key").alias("b")).distinct()
    likely = Staged(_likely(stars, signatures, table), "likely")
    links = Staged(_confirmed(likely.read(), sets.read(), percent).unionByName(_same_id(nodes, classes.read())), "links")
    likely.remove()
    final = components(links.read())
    for verify in (False, True):
        rest = Staged(_split(members.read(), final.read()), "split")
        more = None
        if rest.read().limit(1).count():
            signed = rest.read().join(signatures, "key")
            if verify:
                more = Staged(_verified(signed.join(sets.read(), "key"), table, percent), "links")
            else:
                pairs = Staged(_likeliest(signed, table), "pairs")
                more = Staged(_confirmed(pairs.read(), sets.read(), percent), "links")
                pairs.remove()
            if more.read().limit(1).count():
                both = Staged(links.read().union(more.read()), "links")
                links.remove()
                final.remove()
                links, final = both, components(both.read())
            more.remove()
        rest.remove()
        if more is None:
            break
    tops = classes.read().join(final.read().withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    tops = Staged(tops.select(*prints, "head", "component"), "tops")
    named = tops.read().groupBy("component").agg(F.min("head").alias("component_id"))
    placed = tops.read().join(named, "component").select(*prints, "component_id")
    out = sketches.select("id", *prints).join(placed, prints, "left")
    for old in (links, sets, heads, buckets, members, final, classes):
        old.remove()
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_column), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without all but the smallest id of each group; its columns are unchanged.

    Repeated rows of one id all stay if that id is kept; rows with a null id stay.
    """
    gone = near_duplicates(docs, id_column, text).where("not kept").select(F.col(id_column).alias(fresh(docs.columns, "gone_id"))).distinct()
    return docs.join(gone, docs[id_column] == gone[gone.columns[0]], "left_anti")
