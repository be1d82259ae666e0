"""Hard negatives by an inverted multi-index: two half-space codebooks, cells visited in order of certified bounds.

A vector is cut into two halves, and each half is assigned to the nearest centre of a codebook of its
own; a pair of centres is a cell.  The score of a query with any row of a cell is at most the sum of two half
bounds, each the product of the query's half with the centre plus its length times the radius of the half's
cluster.  A heap over both sorted lists of half bounds (a multi-sequence) gives cells by falling
sum, and a query stops when no cell left can change what it has found: its window is certified, so
results are exact.  A window is a range of scores from which the first few rows are wanted.

Codebooks are fitted on ``SAMPLE`` rows at most; every row is indexed.  Cells are dealt to shards, small ones
together and large ones split, so a shard holds a bounded number of rows however hot a cell is.  A shard's rows come
to a task first and stay in memory; then queries stream past them, a batch at a time, and a batch meets
a cell's rows in one matrix product.  Queries go to their own shard first; what they find there is the
threshold below which other shards, like cells, are not visited.  Where bounds are loose, as for vectors without
clusters, all shards are visited, so work then grows with queries times rows.

Components are integers; products run in single precision where that is exact, else in double precision,
else on Python numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairlab.llm.tables import Staged

#: Rows on which codebooks are fitted at most, rounds of fitting, and rows of a cell that the codebooks aim at.
SAMPLE, ROUNDS, CELL_ROWS = 16_384, 10, 256
#: Bounds of a codebook's size, and of a shard's rows.
CENTRES, SHARD_ROWS = (2, 64), (2048, 65_536)
#: Queries that meet a cell together, and rows of a cell that they meet at once.
BATCH, STEP = 64, 4096
#: Each anchor's positives, each positive's negatives, and the range of a negative's score in percent of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95

_FAR = 1 << 62


# --- vectors -----------------------------------------------------------------------


def scaled(values: np.ndarray, scale: float = 256.0) -> np.ndarray:
    """floor(scale * x) of each component, in double precision."""
    return np.floor(scale * values.astype(np.float64))


def _pack(vector: np.ndarray) -> bytes:
    """Integers of 32 bits, or doubles behind one more byte where they don't fit."""
    if len(vector) and np.abs(vector).max() >= 2**31:
        return b"\x00" + vector.astype("<f8").tobytes()
    return vector.astype("<i4").tobytes()


def _unpack(data: Sequence[bytes], dim: int) -> np.ndarray:
    """Matrix of vectors, shorter ones filled up with zeros."""
    if data and all(len(d) == 4 * dim for d in data):
        return np.frombuffer(b"".join(data), dtype="<i4").reshape(len(data), dim).astype(np.float64)
    out = np.zeros((len(data), dim))
    for row, d in zip(out, data, strict=True):
        own = np.frombuffer(d, dtype="<f8", offset=1) if len(d) % 4 else np.frombuffer(d, dtype="<i4")
        row[: len(own)] = own
    return out


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer products, kept in the range of 64-bit numbers."""
    if not len(rows) or not len(queries):
        return np.zeros((len(rows), len(queries)))
    most = float(np.sqrt((rows**2).sum(axis=1).max()) * np.sqrt((queries**2).sum(axis=1).max()))
    if most < 2**24:
        return (rows.astype(np.float32) @ queries.astype(np.float32).T).astype(np.float64)
    if most < 2**53:
        return rows @ queries.T
    exact = [[sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for q in queries] for r in rows]
    return np.array([[max(min(s, _FAR), -_FAR) for s in line] for line in exact], dtype=object)


# --- codebooks ---------------------------------------------------------------------


def fit_codebook(points: np.ndarray, centres: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centres by Lloyd's rounds from distinct points; fewer where there are fewer distinct points."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    book = distinct[np.sort(rng.choice(len(distinct), min(centres, len(distinct)), replace=False))]
    for _ in range(rounds):
        mine = nearest(points, book)
        total = np.zeros_like(book)
        np.add.at(total, mine, points)
        n = np.bincount(mine, minlength=len(book))
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
    return book


def nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(axis=1) - 2 * points @ book.T).argmin(axis=1)


def half_bounds(queries: np.ndarray, book: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest product of each query's half with any point of each cluster."""
    middle, reach = queries @ book.T, np.sqrt((queries**2).sum(axis=1))[:, None] * radius
    slack = 1e-9 * (np.abs(middle) + reach) + 1e-3
    return middle - reach - slack, middle + reach + slack


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs by falling sum of first[i] + second[j]."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, seen = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        total, x, y = heapq.heappop(heap)
        yield -total, int(a[x]), int(b[y])
        for x, y in ((x + 1, y), (x, y + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(first[a[x]] + second[b[y]]), x, y))


# --- one shard ---------------------------------------------------------------------


class Shard:
    """Rows of a shard in order of cell, label and id, and the search among them."""

    def __init__(self, dim: int, books: tuple[np.ndarray, np.ndarray], rid, vec_id, label, vectors: np.ndarray, i, j):
        self.half, self.vectors = books[0].shape[1], vectors
        order = np.lexsort((vec_id, label, j, i))
        self.rid, self.vec_id, self.label, self.vectors, i, j = rid[order], vec_id[order], label[order], vectors[order], i[order], j[order]
        self.used = (np.unique(i), np.unique(j))
        self.books = tuple(book[u] for book, u in zip(books, self.used, strict=True))
        parts = (self.vectors[:, : self.half], self.vectors[:, self.half:])
        self.radius = []
        for part, code, book, used in zip(parts, (i, j), self.books, self.used, strict=True):
            radius = np.zeros(len(used))
            at = np.searchsorted(used, code)
            np.maximum.at(radius, at, np.sqrt(((part - book[at]) ** 2).sum(axis=1)))
            self.radius.append(radius)
        edge = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(j) != 0), True])
        self.cells = {(int(np.searchsorted(self.used[0], i[s])), int(np.searchsorted(self.used[1], j[s]))): (s, e) for s, e in zip(edge, edge[1:], strict=False)}

    def search(self, rid, label, vectors: np.ndarray, windows: list[list[tuple[int, int]]], count: int, same: bool):
        """(query, window, row) of the first ``count`` rows in each window; ``same``: of the query's label, else of others.

        Rows come by falling score, then by id; a query's own row is never among them.
        """
        owner = np.array([q for q, w in enumerate(windows) for _ in w], dtype=np.int64)
        if not len(owner):
            return []
        low, high = (np.array([w[k] for ws in windows for w in ws], dtype=np.float64) for k in (0, 1))
        found: list[list[tuple[int, int, int]]] = [[] for _ in owner]  # (-score, id, row), in order
        bounds = [half_bounds(part, book, r) for part, book, r in zip((vectors[:, : self.half], vectors[:, self.half:]), self.books, self.radius, strict=True)]
        for total, a, b in multi_sequence(bounds[0][1].max(axis=0), bounds[1][1].max(axis=0)):
            if total < low.min():
                break
            if (a, b) not in self.cells:
                continue
            upper, lower = (bounds[0][k][:, a] + bounds[1][k][:, b] for k in (1, 0))
            open_ = np.flatnonzero((upper[owner] >= low) & (lower[owner] <= high))
            if not len(open_):
                continue
            asked, column = np.unique(owner[open_], return_inverse=True)
            s, e = self.cells[a, b]
            for s in range(s, e, STEP):
                rows = slice(s, min(s + STEP, e))
                score = products(self.vectors[rows], vectors[asked])
                fits = (self.label[rows][:, None] == label[asked]) == same
                fits &= self.rid[rows][:, None] != rid[asked]
                value = np.where(fits, score, -np.inf)[:, column]
                value[value > high[open_]] = -np.inf
                least = low[open_]
                if len(value) > count:
                    least = np.maximum(least, np.partition(value, -count, axis=0)[-count])
                rank, at = np.nonzero((value >= least) & (value > -np.inf))
                for k in np.unique(at):
                    w, mine = open_[k], rank[at == k]
                    scores = value[mine, k]
                    best = mine[np.lexsort((self.vec_id[rows][mine], -scores))[:count]]
                    more = [(-int(score[r, column[k]]), int(self.vec_id[s + r]), int(s + r)) for r in best]
                    found[w] = sorted(found[w] + more)[:count]
                    if len(found[w]) == count:
                        low[w] = max(low[w], -found[w][-1][0])
        number = np.concatenate([np.arange(len(w)) for w in windows])
        return [(int(rid[owner[w]]), int(number[w]), int(row), int(vec), -score) for w, rows in enumerate(found) for score, vec, row in rows]


# --- in Spark ----------------------------------------------------------------------

_INDEXED = "rid long, vec_id long, label long, vec binary, i int, j int, d1 double, d2 double"
_NO_ID = (1 << 63) - 1


def _valid(batch: pa.RecordBatch, scale: float) -> tuple[list[int], list[np.ndarray]]:
    """Positions and scaled vectors of the rows that take part: with a label and a vector of finite numbers."""
    keep, vectors = [], []
    labels = batch.column("label").is_valid().to_pylist()
    for at, (ok, value) in enumerate(zip(labels, batch.column("embedding"), strict=True)):
        if ok and value.is_valid and value.values.null_count == 0:
            own = scaled(value.values.to_numpy(zero_copy_only=False), scale)
            if np.isfinite(own).all():
                keep.append(at)
                vectors.append(own)
    return keep, vectors


def _indexed(books: tuple[np.ndarray, np.ndarray], dim: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = books[0].shape[1]
        for batch in batches:
            keep, vectors = _valid(batch, scale)
            packed = [_pack(v) for v in vectors]
            full = _unpack(packed, dim)
            codes, far = [], []
            for part, book in zip((full[:, :half], full[:, half:]), books, strict=True):
                code = nearest(part, book)
                codes.append(code)
                far.append(np.sqrt(((part - book[code]) ** 2).sum(axis=1)))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([
                kept.column("rid"), kept.column("vec_id"), kept.column("label"), pa.array(packed, pa.binary()),
                *[pa.array(c.astype(np.int32)) for c in codes], *[pa.array(f) for f in far],
            ], names=["rid", "vec_id", "label", "vec", "i", "j", "d1", "d2"])

    return run


class MultiIndex:
    """The index of a table of vectors: staged rows with their cells and shards, codebooks, and a directory of cells."""

    def __init__(self, vectors: DataFrame, scale: float = 256.0, sample: int = SAMPLE):
        """``vectors`` has vec_id, label, embedding; rows that lack a label or a finite number take no part."""
        spark = vectors.sparkSession
        source = vectors.select(
            F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("vec_id"),
            F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"),
        )
        sizes = source.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("label").isNotNull(), F.size("embedding"))).alias("dim")).first()
        self.dim = max(2, sizes["dim"] or 0)
        every = max(1, sizes["n"] // sample)
        drawn = source.where(F.pmod(F.xxhash64("rid"), F.lit(every)) == 0).limit(2 * sample).toArrow()
        points = _unpack([_pack(v) for batch in drawn.to_batches() for v in _valid(batch, scale)[1]], self.dim)
        points = points if len(points) else np.zeros((1, self.dim))
        centres = int(min(max((sizes["n"] / CELL_ROWS) ** 0.5, CENTRES[0]), CENTRES[1]))
        half = self.dim // 2
        self.books = (fit_codebook(points[:, :half], centres), fit_codebook(points[:, half:], centres))
        staged = Staged(source.mapInArrow(_indexed(self.books, self.dim, scale), _INDEXED), "vectors").read()
        # at most CENTRES[1] ** 2 rows
        cells = staged.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).orderBy("i", "j").collect()
        most = int(min(max(sizes["n"] / (4 * spark.sparkContext.defaultParallelism), SHARD_ROWS[0]), SHARD_ROWS[1]))
        self.radius = tuple(np.array([max((c[d] for c in cells if c[k] == code), default=0.0) for code in range(len(book))]) for k, d, book in (("i", "d1", self.books[0]), ("j", "d2", self.books[1])))
        self.cells, shard, filled = [], 0, 0
        for c in cells:
            parts = -(-c["n"] // most)
            if filled and filled + c["n"] > most:
                shard, filled = shard + 1, 0
            self.cells.append((c["i"], c["j"], shard, parts))
            if parts > 1:
                shard, filled = shard + parts, 0
            else:
                filled += c["n"]
        directory = spark.createDataFrame(self.cells, "i int, j int, first int, parts int")
        placed = staged.join(F.broadcast(directory), ["i", "j"])
        shard_of = F.col("first") + F.pmod(F.xxhash64("rid"), F.col("parts").cast("long")).cast("int")
        self.rows = placed.select("rid", "vec_id", "label", "vec", "i", "j", shard_of.alias("shard"))

    def reach(self, queries: DataFrame) -> DataFrame:
        """``queries`` (rid, vec, windows) with each ``shard`` that may hold a row inside one of their windows."""
        books, radius, dim = self.books, self.radius, self.dim
        cells = np.array(self.cells, dtype=np.int64).reshape(-1, 4)
        names = list(queries.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = books[0].shape[1]
            for batch in batches:
                vectors = _unpack(batch.column("vec").to_pylist(), dim)
                low = np.array([min((w["low"] for w in ws), default=_FAR) for ws in batch.column("windows").to_pylist()], dtype=np.float64)
                high = np.array([max((w["high"] for w in ws), default=-_FAR) for ws in batch.column("windows").to_pylist()], dtype=np.float64)
                bounds = [half_bounds(p, b, r) for p, b, r in zip((vectors[:, :half], vectors[:, half:]), books, radius, strict=True)]
                rows, shards = [], []
                for at in range(batch.num_rows):
                    lower, upper = (bounds[0][k][at, cells[:, 0]] + bounds[1][k][at, cells[:, 1]] for k in (0, 1))
                    ok = cells[(upper >= low[at]) & (lower <= high[at])]
                    if len(ok):
                        to = np.unique(np.concatenate([np.arange(f, f + n) for f, n in ok[:, 2:]]))
                        rows += [at] * len(to)
                        shards += to.tolist()
                    if len(rows) > 20_000:
                        taken = batch.take(pa.array(rows, pa.int64()))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(shards, pa.int32())], names=[*names, "shard"])
                        rows, shards = [], []
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(shards, pa.int32())], names=[*names, "shard"])

        return queries.mapInArrow(run, StructType([*queries.schema.fields]).add("shard", "integer"))

    def search(self, queries: DataFrame, count: int, same: bool) -> DataFrame:
        """(rid, window, vec_id, score): the first ``count`` rows of each query's windows in the shard it comes to.

        ``queries`` has rid, label, vec, i, j, shard and windows, an array of (low, high).
        """
        rows = self.rows.withColumn("windows", F.lit(None).cast("array<struct<low:long,high:long>>"))
        asked = queries.withColumn("vec_id", F.lit(None).cast("long")).select(*rows.columns)
        both = rows.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)))
        order = both.repartition("shard").sortWithinPartitions("shard", "kind", "i", "j")
        books, dim = self.books, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, shard = None, [], None
            for batch in batches:
                edges = np.flatnonzero(np.diff(batch.column("shard").to_numpy()) | np.diff(batch.column("kind").to_numpy())) + 1
                for s, e in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                    if s == e:
                        continue
                    part = batch.slice(s, e - s)
                    if part.column("shard")[0].as_py() != at:
                        at, held, shard = part.column("shard")[0].as_py(), [], None
                    if part.column("kind")[0].as_py() == 0:
                        held.append(part)
                        continue
                    if not held:
                        continue
                    if shard is None:
                        own = pa.Table.from_batches(held)
                        shard = Shard(dim, books, *[own.column(c).to_numpy() for c in ("rid", "vec_id", "label")], _unpack(own.column("vec").to_pylist(), dim), *[own.column(c).to_numpy() for c in ("i", "j")])
                    found = []
                    for k in range(0, part.num_rows, BATCH):
                        few = part.slice(k, BATCH)
                        windows = [[(w["low"], w["high"]) for w in ws] for ws in few.column("windows").to_pylist()]
                        found += shard.search(few.column("rid").to_numpy(), few.column("label").to_numpy(), _unpack(few.column("vec").to_pylist(), dim), windows, count, same)
                    columns = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1, 3, 4)]
                    yield pa.RecordBatch.from_arrays(columns, names=["rid", "window", "vec_id", "score"])

        return order.mapInArrow(run, "rid long, window long, vec_id long, score long")


def _first(found: DataFrame, count: int) -> DataFrame:
    """The first ``count`` of what the shards found for each window, with their rank."""
    order = Window.partitionBy("rid", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _window(low: Column, high: Column) -> Column:
    return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = 256.0,
) -> DataFrame:
    """Negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label, embedding; ``anchors`` is a condition on vec_id.  A row's score is the integer product of
    floor(scale * x) with the anchor's.  Positives are the first other rows of the anchor's label, by falling score, then
    by id; negatives the first of other labels with low % to high % of the positive's score.

    Defined cases: rows with a null label or vector, or a null or non-finite component, take no part; short vectors are filled up
    with zeros; rows that repeat an id are rows of their own, and so are anchors; a null id is never an anchor and comes last
    among ties; scores beyond 2**62 count as 2**62; an empty table, or one without anchors, gives an empty table.
    """
    index = MultiIndex(vectors, scale)
    chosen = Staged(index.rows.where((F.col("vec_id") != _NO_ID) & anchors), "anchors").read()
    everything = F.array(_window(F.lit(-_FAR), F.lit(_FAR)))
    home = Staged(index.search(chosen.withColumn("windows", everything), positives, True), "home").read()
    reached = home.groupBy("rid").agg(F.when(F.count(F.lit(1)) == positives, F.min("score")).alias("least"))
    known = chosen.withColumnRenamed("shard", "home").join(reached, "rid", "left")
    further = index.reach(known.withColumn("windows", F.array(_window(F.coalesce("least", F.lit(-_FAR)), F.lit(_FAR)))).drop("least"))
    away = index.search(further.where("shard <> home").drop("home"), positives, True)
    near = Staged(_first(home.unionByName(away), positives), "positives").read()
    # 100 * negative between low and high percent of the positive, in whole numbers
    floor_of = F.expr(f"-floor(-{low} * score / 100D)"), F.expr(f"floor({high} * score / 100D)")
    exact = F.expr(f"-((-{low} * score - pmod(-{low} * score, 100)) div 100)"), F.expr(f"({high} * score - pmod({high} * score, 100)) div 100")
    wide = F.abs("score") > (1 << 55)
    bounds = _window(F.when(wide, floor_of[0]).otherwise(exact[0]), F.when(wide, floor_of[1]).otherwise(exact[1]))
    windows = near.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", bounds.alias("w")))), lambda x: x["w"]).alias("windows"))
    asked = index.reach(chosen.drop("shard").join(windows, "rid"))
    found = _first(index.search(asked, negatives, False), negatives)
    pairs = near.select("rid", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pairs, ["rid", "window"])
    out = out.join(chosen.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    named = [F.when(F.col(c) != _NO_ID, F.col(c)).alias(c) for c in ("anchor_id", "positive_id")]
    return out.select(*named, F.col("rank").cast("int").alias("rank"), F.when(F.col("negative_id") != _NO_ID, F.col("negative_id")).alias("negative_id"), "positive_score", "negative_score")
