"""Exact substring removal: windows of words that occur twice or more anywhere in a corpus.

Every window of ``window`` consecutive words is hashed by a rolling (Rabin-Karp) polynomial.
Tasks deal the hashes out into buckets by a second, independent hash; one group of Spark's
shuffle counts one bucket.  A hash is 56 bits within its bucket, so with ``n`` windows in ``b``
buckets about n*n / (b * 2**57) pairs collide by chance: 1e-3 for 1e8 windows, and as buckets
are added with the data the rate per window stays negligible at 1e13.

A window that repeats within one task's slice is known to be repeated there: the slice sends
its hash once, whatever the number of copies, so a passage that a third of all documents hold
puts one row per slice into its bucket.  The places of such windows need no counting and are
dealt out by slice, so a passage that many slices begin with fills no bucket.  Windows found to be repeated go back to their
documents as word positions, merge into maximal runs, and those words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pairlab.llm import words as W
from pairlab.llm.tables import fresh, text_bytes

WINDOW = 35
#: Bytes of text behind one bucket, which holds about a window of 7 + 2 bytes for every 6 of them.
BUCKET_BYTES = 16 << 20
#: Text whose windows are compared with each other before anything is shuffled.
LOCAL_BYTES = (2 << 20) - 1

_ROWS = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("gaps", pa.binary())])


def _pack(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 7, 8), dtype=np.uint8)
    out[:, :7] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8")


def _positions(keys: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Ascending (document, word) places as document keys, counts, and gaps in byte planes, which compress well."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    gap = pos.astype("<u4")
    gap[1:] -= np.where(new[1:], 0, pos[:-1]).astype("<u4")
    counts = np.diff(np.append(at, len(doc))).astype("<u4")
    return keys[doc[at]].astype("<i8").tobytes(), counts.tobytes(), gap.view(np.uint8).reshape(-1, 4).T.tobytes()


def _places(counts: np.ndarray, gaps: bytes) -> np.ndarray:
    gap = np.ascontiguousarray(np.frombuffer(gaps, dtype=np.uint8).reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)
    total = np.cumsum(gap)
    begin = np.cumsum(counts) - counts
    return total - np.repeat(total[begin] - gap[begin], counts)


def _hash_rows(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_number = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for part in W.slices(batch.column(1), LOCAL_BYTES):
                where = W.inside_document(part.first, window)
                if not len(where):
                    continue
                slice_number += 1
                values = part.hashes()
                doc = part.doc_of_word()[where]
                pos = where - part.first[doc]
                doc += part.at
                key = W.window_hashes(values, window)[where]
                bucket = (W.window_hashes(values, window, 1)[where] % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(key)
                equal = key[order][1:] == key[order][:-1]
                again, before = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
                again[order[1:]] = equal
                before[order[:-1]] = equal
                local = again | before
                rows = {c: [] for c in _ROWS.names}

                def add(b, hashes, places):
                    for c, v in zip(_ROWS.names, (b, hashes, *places), strict=True):
                        rows[c].append(v)

                if local.any():
                    dealt = W.mix(np.array([slice_number], dtype=np.uint64))[0]
                    add(int(dealt % np.uint64(buckets)), b"", _positions(keys, doc[local], pos[local]))
                single, shown = np.flatnonzero(~local), np.flatnonzero(before & ~again)
                by, shown_by = np.argsort(bucket[single], kind="stable"), np.argsort(bucket[shown], kind="stable")
                single, shown = single[by], shown[shown_by]
                cut = np.searchsorted(bucket[single], np.arange(buckets + 1))
                shown_cut = np.searchsorted(bucket[shown], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cut) + np.diff(shown_cut)):
                    mine, twice = single[cut[b]: cut[b + 1]], shown[shown_cut[b]: shown_cut[b + 1]]
                    places = _positions(keys, doc[mine], pos[mine]) if len(mine) else (b"", b"", b"")
                    add(int(b), _pack(np.concatenate([key[mine], key[twice], key[twice]])), places)
                yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _ROWS], schema=_ROWS)

    return run


def _repeated(group: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: (document key, word positions) of the windows whose hash it has twice or more."""
    hashes = [_unpack(x) for x in group["hashes"]]
    key = np.concatenate(hashes)
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    found = np.zeros(len(key), dtype=bool)
    found[order[1:]] = equal
    found[order[:-1]] |= equal
    out_keys, out_places, at = [], [], 0
    for mine, docs, counts, gaps in zip(hashes, group["keys"], group["counts"], group["gaps"], strict=True):
        docs, counts = np.frombuffer(docs, dtype="<i8"), np.frombuffer(counts, dtype="<u4").astype(np.int64)
        if len(docs):
            place = _places(counts, gaps)
            keep = found[at: at + len(place)] if len(mine) else np.ones(len(place), dtype=bool)
            of = np.repeat(np.arange(len(docs)), counts)[keep]
            place = place[keep].astype("<u4")
            cut = np.searchsorted(of, np.arange(len(docs) + 1))
            for d in np.flatnonzero(np.diff(cut)):
                out_keys.append(docs[d])
                out_places.append(place[cut[d]: cut[d + 1]].tobytes())
        at += len(mine)
    return pd.DataFrame({"key": np.array(out_keys, dtype=np.int64), "places": out_places})


def repeated_windows(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, places): for each text with repeated windows, lists of their first words as packed 32-bit numbers.

    ``keyed`` has the columns key (long, equal only for equal texts) and text.
    """
    buckets = max(24, -(-text_bytes(keyed, "text") // BUCKET_BYTES))
    schema = "bucket int, hashes binary, keys binary, counts binary, gaps binary"
    rows = keyed.select("key", "text").mapInArrow(_hash_rows(window, int(buckets)), schema)
    found = rows.groupBy("bucket").applyInPandas(_repeated, "key long, places binary")
    return found.groupBy("key").agg(F.collect_list("places").alias("places"))


def text_key(id_column: str | Column, text_column: str | Column) -> Column:
    """Rows share a key only if they share id and text, and then their windows are the same."""
    return F.xxhash64(id_column, text_column)


def _cut(window: int, text_at: int, places_at: int, keep: list[int], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(places_at)
            for part in W.slices(batch.column(text_at)):
                n_words, n_removed, digest, text = [], [], [], []
                raw = part.buf.tobytes()
                for i in range(part.n_docs):
                    a, b = part.first[i], part.first[i + 1]
                    starts, ends = part.starts[a:b], part.ends[a:b]
                    lists = places[part.at + i].as_py()
                    gone = W.covered(np.frombuffer(b"".join(lists), dtype="<u4").astype(np.int64), window, b - a) if lists else np.zeros(b - a, dtype=bool)
                    stay = np.flatnonzero(~gone)
                    digest.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])).hexdigest())
                    n_words.append(int(b - a))
                    n_removed.append(int(gone.sum()))
                    text.append(_without(raw, starts, ends, gone) if lists else None)
                rows = batch.slice(part.at, part.n_docs)
                changed = pa.array([None if t is None else t.decode() for t in text], pa.string())
                whole = rows.column(text_at).cast(pa.string())
                arrays = [rows.column(k).cast(f.type) for k, f in zip(keep, schema, strict=False)]
                arrays += [pa.compute.coalesce(changed, whole), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _without(raw: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """The document without the maximal runs of ``gone`` words; the white space before a run goes with it."""
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return b""
    out, at = [], int(starts[0])
    for i, j in zip(begin.tolist(), end.tolist(), strict=True):
        out.append(raw[at: int(ends[i - 1]) if i else at])
        at = int(ends[j - 1])
    out.append(raw[at: int(ends[-1])])
    return b"".join(out).lstrip()


def remove_repeated(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the words of repeated windows cut out of ``text``, and what was done in added columns.

    Added (with underscores in front where a name is taken): n_words, n_removed, kept_sha256 (kept
    words joined by one space) and, as the new text, the original without the removed runs.

    Defined cases: null and empty texts have no words and stay as they are; texts shorter than a
    window keep everything; repeated rows repeat each other's windows, so all of them lose what
    they share; a null id is an id like any other; an empty table gives an empty table.
    """
    key, places, new = (fresh(docs.columns, c) for c in ("dedup_key", "dedup_places", "dedup_text"))
    added = [fresh(docs.columns, c) for c in ("n_words", "n_removed", "kept_sha256")]
    keyed = docs.withColumn(key, text_key(id_column, text))
    found = repeated_windows(keyed.select(F.col(key).alias("key"), F.col(text).alias("text")), window)
    joined = keyed.join(found.select(F.col("key").alias(key), F.col("places").alias(places)), key, "left").select(*docs.columns, places)
    others = [c for c in docs.columns if c != text]
    fields = [docs.schema[c] for c in others] + [StructField(new, StringType())]
    fields += [StructField(added[0], LongType()), StructField(added[1], LongType()), StructField(added[2], StringType())]
    schema = StructType(fields)
    run = _cut(window, docs.columns.index(text), len(docs.columns), [docs.columns.index(c) for c in others], to_arrow_schema(schema))
    out = joined.mapInArrow(run, schema)
    return out.select(*[F.col(new).alias(text) if c == text else F.col(c) for c in docs.columns], *added)
