"""Benchmark decontamination: n-grams of test items found in training documents, with DataFrame functions only.

The normalised windows of the test items are a set of strings and a set of their hashes.  Up to
``SET_LIMIT`` distinct windows both go to the tasks inside the expression, as hash sets, and one
pass over the documents, without a shuffle, looks up the hash of every window and verifies a
hit on the words themselves.  A larger benchmark is joined instead: by hash first, then by words;
the results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.native import NOT_ALPHANUMERIC, covered_length, let, lower_ascii, starts, words
from pairlab.llm.tables import Staged, fresh

NGRAM = 13
#: Distinct windows that may travel inside an expression (about 100 bytes each).
SET_LIMIT = 20_000
#: A document is contaminated if at least this share of its words, in percent, is hit.
PERCENT = 5

_SPANS = "array<struct<start:int,len:int,window:string>>"


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", ngram: int = NGRAM) -> DataFrame:
    """(window, len, items): distinct windows of the items; an item of fewer words than ``ngram`` is one window."""
    listed = benchmark.select(F.col(item).alias("item"), words(lower_ascii(text), NOT_ALPHANUMERIC).alias("w")).where(F.size("w") > 0)
    listed = listed.withColumn("len", F.least(F.size("w"), F.lit(ngram)))
    one = listed.select("item", "w", "len", F.explode(starts(F.col("w"), F.col("len"))).alias("at"))
    named = one.select("item", "len", F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " ").alias("window"))
    return named.groupBy("window", "len").agg(F.collect_set("item").alias("items"))


def _hash(w: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.slice(w, at + 1, length))


def _text(w: Column, at: Column, length: int) -> Column:
    return F.array_join(F.slice(w, at + 1, length), " ")


def _in_sets(w: Column, length: int, hashes: list[int], texts: list[str]):
    return lambda at: _hash(w, at, length).isin(hashes) & _text(w, at, length).isin(texts)


def _span(w: Column, length: int):
    return lambda at: F.struct(at.alias("start"), F.lit(length).alias("len"), _text(w, at, length).alias("window"))


def _hashed_span(w: Column, length: int):
    return lambda at: F.struct(at.alias("start"), F.lit(length).alias("len"), _hash(w, at, length).alias("hash"))


def _by_set(text: str, windows: list) -> Column:
    """(n_words, spans) of a text, spans in order of start: hash looked up, then verified."""
    by_length: dict[int, list] = {}
    for row in windows:
        by_length.setdefault(row["len"], []).append(row)

    def spans(w: Column) -> Column:
        parts = [F.array().cast(_SPANS)]
        for length, rows in sorted(by_length.items()):
            hashes, texts = [r["hash"] for r in rows], [r["window"] for r in rows]
            hits = F.filter(starts(w, length), _in_sets(w, length, hashes, texts))
            parts.append(F.transform(hits, _span(w, length)))
        found = F.concat(*parts)
        return found if len(parts) <= 2 else F.array_sort(found)

    return let(words(lower_ascii(text), NOT_ALPHANUMERIC), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), spans(w).alias("spans")))


def _by_join(docs: DataFrame, key: str, text: str, windows: DataFrame, found: str) -> DataFrame:
    """The same by shuffle joins, for benchmarks of any size."""
    lengths = [r["len"] for r in windows.select("len").distinct().collect()]  # at most NGRAM values
    w = words(lower_ascii(text), NOT_ALPHANUMERIC)
    hashed = windows.select("len", F.xxhash64(F.split("window", " ")).alias("hash")).distinct()

    def places(w: Column) -> Column:
        return F.concat(*[F.transform(starts(w, n), _hashed_span(w, n)) for n in lengths])

    near = docs.select(key, F.explode(let(w, places)).alias("p")).select(key, "p.*").join(hashed, ["len", "hash"], "left_semi")
    near = near.groupBy(key).agg(F.collect_set(F.struct("start", "len")).alias("near"))
    texts = docs.select(key, text).dropDuplicates([key]).join(near, key)
    listed = let(w, lambda w: F.transform("near", lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"), F.array_join(F.slice(w, s["start"] + 1, s["len"]), " ").alias("window"))))
    exact = texts.select(key, F.explode(listed).alias("s")).select(key, "s.*").join(windows.select("window"), "window", "left_semi")
    listing = fresh([*docs.columns, found], "spans_of")
    spans = exact.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "len", "window"))).alias(listing))
    joined = docs.join(spans, key, "left")
    whole = F.struct(F.size(w).cast("long").alias("n_words"), F.coalesce(listing, F.array().cast(_SPANS)).alias("spans"))
    return joined.withColumn(found, whole).drop(listing)


def with_hits(docs: DataFrame, windows: DataFrame, text: str = "text", set_limit: int = SET_LIMIT) -> tuple[DataFrame, str]:
    """``docs`` with a column (n_words, n_hit, spans, windows): what the benchmark covers; and that column's name."""
    found = fresh(docs.columns, "found")
    small = windows.select("window", "len", F.xxhash64(F.split("window", " ")).alias("hash")).limit(set_limit + 1).collect()
    if len(small) <= set_limit:
        hit = docs.withColumn(found, _hits(_by_set(text, small)))
    else:
        key = fresh(docs.columns, "text_key")
        hit = _by_join(docs.withColumn(key, F.xxhash64(text)), key, text, windows, found).withColumn(found, _hits(F.col(found))).drop(key)
    return hit, found


def _hits(found: Column) -> Column:
    return let(found, lambda f: F.struct(
        f["n_words"].alias("n_words"), covered_length(f["spans"]).alias("n_hit"), f["spans"].alias("spans"),
        F.array_distinct(F.transform(f["spans"], lambda s: s["window"])).alias("windows"),
    ))


def is_contaminated(found: Column, percent: int = PERCENT) -> Column:
    """At least ``percent`` of the words hit, and one at least."""
    return let(found, lambda f: (f["n_hit"] > 0) & (100 * f["n_hit"] >= percent * f["n_words"]))


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Defined cases: null and empty texts, and texts without words, have no hits; a null or wordless
    test item has no window; repeated documents are reported once per row; a null id is carried
    along; repeated items count once; empty tables give an empty or all-clean result.
    """
    windows = Staged(item_windows(benchmark), "windows").read()
    hit, found = with_hits(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")), windows)
    rows = hit.select(
        "id", F.xxhash64("text").alias("key"), F.col(f"{found}.n_words").alias("n_words"), F.col(f"{found}.n_hit").alias("n_hit"),
        F.col(f"{found}.windows").alias("windows"),
    )
    # Equal rows fold into one with their number, so that no made-up row number is needed.
    def reported(items: Column) -> list[Column]:
        names = F.sort_array(F.transform(items, lambda i: i.cast("string")))
        return [F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256")]

    rows = Staged(rows, "hits").read()  # a pass over the texts; clean rows, the most, stay out of the join by window
    clean = rows.where(F.size("windows") == 0).select("id", "n_words", "n_hit", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit("").cast("binary"), 256).alias("items_sha256"))
    rows = rows.where(F.size("windows") > 0).select("id", "key", "n_words", "n_hit", F.size("windows").alias("n"), F.explode("windows").alias("window"))
    listed = rows.join(windows.select("window", "items"), "window").groupBy("id", "key", "n_words", "n_hit", "n").agg(
        (F.count(F.lit(1)) / F.first("n")).cast("int").alias("copies"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    one = listed.select("id", "n_words", "n_hit", *reported(F.col("items")), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy").unionByName(clean)
    bad = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= PERCENT * F.col("n_words"))
    return one.select(F.col("id").alias(id_column), "n_words", "n_hit", "n_items", "items_sha256", bad.alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones; its columns are unchanged, and nothing is shuffled."""
    hit, found = with_hits(docs, item_windows(benchmark), text)
    return hit.where(~is_contaminated(F.col(found))).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every hit word, and what separates it from the next, cut out of ``text``."""
    hit, found = with_hits(docs, item_windows(benchmark), text)
    letters = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    units = F.regexp_extract_all(text, F.lit(f"({letters}+[^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]*)"), 1)
    before = F.regexp_extract(text, f"^[^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]*", 0)
    spans = F.col(found)["spans"]
    hit_words = F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))

    def kept(words: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(words) - 1), hit_words), lambda i: F.get(words, i))

    cut = F.when(F.size(spans) > 0, F.concat(before, F.array_join(let(units, kept), ""))).otherwise(F.col(text))
    return hit.select(*[cut.alias(text) if c == text else F.col(c) for c in docs.columns])
