"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

The packing is found on the histogram of piece lengths, which has at most ``capacity`` entries
however large the corpus, by bin completion with branch and bound.  The largest remaining length
opens a bin; undominated fillings around it are tried in order of waste, all of them where few pieces are left
(``FEW``), else ``BRANCHES`` of them; a branch is cut when the bins used plus a bound on the rest can't beat the incumbent.  The first incumbents are
best-fit-decreasing and the first descent.  A filling is applied as many times at once as the
counts allow, so the search depends on the number of distinct lengths only.  The search stops at
the lower bound ceil(total / capacity) or after ``NODES`` nodes; either way every piece is placed.

Spark numbers the pieces of each length (a count per task, then offsets), and each takes the
place of its number in the fillings.  Nothing but the histogram and per-filling rows is on the
driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm import words as W
from pairlab.llm.tables import Staged
from pairlab.llm.tokens import word_tokens

CAPACITY = 2048
#: Search nodes after which the incumbent is taken.
NODES = 20_000
#: Fillings tried at a node, and pieces of which all undominated fillings are tried.
BRANCHES, FEW = 3, 24

Filling = tuple[tuple[int, ...], int]  # lengths in one bin, and how many such bins


def _fillings(space: int, counts: np.ndarray, limit: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``space``, least waste first.

    One length that fits exactly dominates every other filling.  Exact pairs come next, larger
    first; then the fullest set that any number of lengths reaches.
    """
    if space <= 0:
        return [()]
    have = np.flatnonzero(counts[: space + 1])
    have = have[have > 0]
    if not len(have):
        return [()]
    if have[-1] == space:
        return [(space,)]
    out: list[tuple[int, ...]] = []
    big = have[have * 2 >= space]
    rest = space - big
    ok = (counts[rest] > 0) & ((rest != big) | (counts[rest] > 1))
    for a in big[ok][::-1][:limit]:
        out.append((int(a), int(space - a)))
    if len(out) < limit:
        # bounded subset sums, largest lengths first: reach[k] holds the sums of the first k kinds
        kinds, reach, bits = have[::-1].tolist(), [1], 1
        full = (1 << (space + 1)) - 1
        used = []
        for size in kinds:
            for _ in range(min(int(counts[size]), space // size)):
                bits |= (bits << size) & full
                reach.append(bits)
                used.append(size)
            if bits >> space & 1:
                break
        best = bits.bit_length() - 1
        chosen, left = [], best
        for k in range(len(used), 0, -1):
            if not reach[k - 1] >> left & 1:
                chosen.append(used[k - 1])
                left -= used[k - 1]
        chosen = tuple(sorted(chosen, reverse=True))
        if chosen and chosen not in out:
            out.append(chosen)
        single = (int(have[-1]), *_fillings(space - int(have[-1]), _less(counts, (int(have[-1]),), 1), 1)[0]) if best < space and len(out) < limit else None
        if single and single not in out:
            out.append(single)
    return sorted(out, key=lambda f: (space - sum(f), [-x for x in f]))[:limit]


def _all_fillings(space: int, counts: np.ndarray) -> list[tuple[int, ...]]:
    """All fillings of ``space`` that leave no piece out that would fit, least waste first; one that fits exactly alone dominates."""
    kinds = [int(k) for k in np.flatnonzero(counts[: max(space, 0) + 1])[::-1] if k]
    if kinds and kinds[0] == space:
        return [(space,)]
    out: list[tuple[int, ...]] = []

    def extend(at: int, left: int, chosen: list[int]) -> None:
        if at == len(kinds):
            free = [k for k in kinds if k <= left and chosen.count(k) < counts[k]]
            if not free:
                out.append(tuple(chosen))
            return
        kind = kinds[at]
        for times in range(min(int(counts[kind]), left // kind), -1, -1):
            extend(at + 1, left - times * kind, chosen + [kind] * times)

    extend(0, space, [])
    return sorted(out, key=lambda f: (space - sum(f), [-x for x in f]))


def _less(counts: np.ndarray, sizes: tuple[int, ...], times: int) -> np.ndarray:
    out = counts.copy()
    for s in sizes:
        out[s] -= times
    return out


def _times(counts: np.ndarray, sizes: tuple[int, ...]) -> int:
    kinds, number = np.unique(sizes, return_counts=True)
    return int((counts[kinds] // number).min())


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[Filling]:
    """Largest first, each into the fullest open bin with room, same-length pieces in one step."""
    open_bins: dict[int, list[list]] = {}  # room -> [lengths, number of such bins]
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        for room in sorted(r for r in open_bins if r >= size):
            kept = []
            for sizes, number in open_bins.pop(room):
                fit = room // size
                n = min(number, left // fit)
                if n:
                    open_bins.setdefault(room - fit * size, []).append([sizes + (size,) * fit, n])
                    left -= n * fit
                    number -= n
                if number and 0 < left < fit:
                    open_bins.setdefault(room - left * size, []).append([sizes + (size,) * left, 1])
                    left, number = 0, number - 1
                if number:
                    kept.append([sizes, number])
            if kept:
                open_bins.setdefault(room, []).extend(kept)
            if not left:
                break
        if left:
            fit = capacity // size
            if left // fit:
                open_bins.setdefault(capacity - fit * size, []).append([(size,) * fit, left // fit])
            if left % fit:
                open_bins.setdefault(capacity - (left % fit) * size, []).append([(size,) * (left % fit), 1])
    return [(tuple(s), n) for bins in open_bins.values() for s, n in bins]


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[Filling]:
    """A packing of ``counts[size]`` pieces of each size into few bins; every piece has a place."""
    counts = np.asarray(counts, dtype=np.int64)
    sizes = np.arange(len(counts))
    best = best_fit_decreasing(counts, capacity)
    fewest = sum(n for _, n in best)
    bound = -(-int((counts * sizes).sum()) // capacity)
    # a stack of untried choices: (bins so far, counts, filling, depth); path holds the choices made
    path: list[Filling] = []
    stack: list[tuple[int, np.ndarray, tuple[int, ...], int]] = []

    def push(used: int, left: np.ndarray, depth: int) -> None:
        top = int(np.flatnonzero(left)[-1])
        rest = _less(left, (top,), 1)
        few = int(rest[: capacity - top + 1].sum()) <= FEW
        for filling in reversed(_all_fillings(capacity - top, rest) if few else _fillings(capacity - top, rest, BRANCHES)):
            stack.append((used, left, (top, *filling), depth))

    if counts.any():
        push(0, counts, 0)
    while stack and fewest > bound and nodes > 0:
        nodes -= 1
        used, left, filling, depth = stack.pop()
        if used + -(-int((left * sizes).sum()) // capacity) >= fewest:
            continue
        times = _times(left, filling)
        del path[depth:]
        path.append((filling, times))
        left, used = _less(left, filling, times), used + times
        if not left.any():
            if used < fewest:
                best, fewest = list(path), used
        else:
            push(used, left, depth + 1)
    return best


def _pieces(path: str, capacity: int, end: int):
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("task", pa.int32()), ("rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = word_tokens(path), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            buf, offsets = W.text_buffer(batch.column(1))
            keep_ids = batch.num_columns > 2
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + W.SLICE_BYTES, side="right")) - 1)
                ids, n = tokens.encode_buffer(buf[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                doc, piece, start, length, crc, kept, rank = [], [], [], [], [], [], []
                at = 0
                names = batch.column(0).slice(i, j - i).to_pylist()
                for name, count in zip(names, n.tolist(), strict=True):
                    own = np.append(ids[at: at + count], np.uint32(end)).astype("<u4")
                    at += count
                    for p, a in enumerate(range(0, len(own), capacity)):
                        part = own[a: a + capacity]
                        doc.append(name)
                        piece.append(p)
                        start.append(a)
                        length.append(len(part))
                        data = part.tobytes()
                        crc.append(zlib.crc32(data))
                        kept.append(data if keep_ids else None)
                        rank.append(int(met[len(part)]))
                        met[len(part)] += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(v, f.type) for v, f in zip((doc, piece, start, length, crc, kept, [task] * len(doc), rank), out, strict=True)
                ], schema=out)
                i = j

    return run


def _places(fillings: list[Filling]) -> pd.DataFrame:
    """Rows (length, first, last, sequence, step, slot): pieces numbered first..last-1 of a length go to sequences sequence, sequence + step..."""
    rows, seen, sequence = [], {}, 0
    for sizes, times in fillings:
        offset = 0
        for size in sizes:
            first = seen.get(size, 0)
            rows.append((size, first, first + times, sequence, offset))
            seen[size] = first + times
            offset += size
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "last", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ids (packed 32-bit numbers) if asked.

    A document is its ids and then ``end``.  Only documents longer than ``capacity`` are cut.

    Defined cases: null and empty texts are the one id ``end``; a null id is carried along; repeated
    rows are packed once each; an empty table gives an empty table; other columns are left out.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    source = source.withColumn("with_ids", F.lit(True)) if with_ids else source
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task int, rank long"
    pieces = Staged(source.mapInArrow(_pieces(tokenizer, capacity, end), schema), "pieces").read()
    per_task = Staged(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths").read()
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        counts[row["length"]] = row["n"]
    places = _places(bin_completion(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    numbered = pieces.join(offsets, ["length", "task"]).withColumn("number", F.col("rank") + F.col("skip"))
    first = np.searchsorted(places["length"].to_numpy(), np.arange(capacity + 2))
    begin, sequence, offset = (places[c].to_numpy() for c in ("first", "sequence", "offset"))
    shared = docs.sparkSession.sparkContext.broadcast((first, begin, sequence, offset))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        first, begin, sequence, offset = shared.value
        size, n = length.to_numpy(), number.to_numpy()
        row = np.zeros(len(size), dtype=np.int64)
        for s in np.unique(size):
            mine = size == s
            row[mine] = first[s] + np.searchsorted(begin[first[s]: first[s + 1]], n[mine], side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[row] + n - begin[row], "offset": offset[row]})

    out = numbered.withColumn("place", place("length", "number"))
    columns = [F.col("doc_id").alias(id_column), "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset"]
    return out.select(*columns, *(["ids"] if with_ids else []))
