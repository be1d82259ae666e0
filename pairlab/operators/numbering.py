"""Row numbers over a whole table without gathering it in one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.sources.staging import cut_lineage

# monotonically_increasing_id() keeps the position inside a partition in its low 33 bits.
_POSITION_MASK = (1 << 33) - 1


def number_rows(df: DataFrame, order_by: Sequence[str | Column], name: str = "row_id") -> DataFrame:
    """Number rows 1..n in the order of ``order_by``, which must identify a row.

    Rows are range-partitioned and sorted once, and that layout is checkpointed so the
    positions stay put.  The driver sees one count per partition; each partition then
    shifts its own positions by the rows before it.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in order_by]
    placed = cut_lineage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(
            "*",
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)).alias("__pos"),
        )
    )
    counts = {row["__part"]: row["n"] for row in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for part in range(max(counts, default=0) + 1):
        starts.append(before)
        before += counts.get(part, 0)
    first = F.array(*[F.lit(v).cast("bigint") for v in starts])[F.col("__part")]
    return placed.select(*df.columns, (first + F.col("__pos") + F.lit(1)).alias(name))


def place_as_read(df: DataFrame) -> DataFrame:
    """Rows of a file scan with where they lie: __file, __row (from 1 in the file) and __all (from 1 over all files, by path).

    ``df`` must come straight from files, through projections and filters at most.  Files may be split
    in any way: a split is read by one task from its start to its end, so a row's place in the file is its place in the
    split after the rows of the splits before it.  The layout is checkpointed once, and the driver sees one
    count per split.
    """
    placed = cut_lineage(df.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at")
    ))
    splits = placed.groupBy("__file", "__start").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first")).orderBy("__file", "__start").collect()
    offsets, total, in_file, file = [], 0, 0, None
    for row in splits:
        in_file = 0 if row["__file"] != file else in_file
        file = row["__file"]
        offsets.append((file, row["__start"], row["first"], in_file, total))
        in_file, total = in_file + row["n"], total + row["n"]
    known = df.sparkSession.createDataFrame(offsets, "__file string, __start bigint, __first bigint, __in_file bigint, __before bigint")
    inside = F.col("__at") - F.col("__first") + 1
    joined = placed.join(known, ["__file", "__start"])
    return joined.select(*df.columns, "__file", (F.col("__in_file") + inside).alias("__row"), (F.col("__before") + inside).alias("__all"))


def number_as_read(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows of files 1..n as they lie, files in the order of their paths."""
    placed = place_as_read(df)
    return placed.select(*df.columns, F.col("__all").alias(name))
