"""CSV reading and writing with the study's schemas."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pairlab.operators.audit import cast_audited
from pairlab.operators.numbering import number_rows, place_as_read

# Column layouts of the study's files.
PAIRS_SCHEMA = (
    "row_id INT, item INT, plural BOOLEAN, classification STRING, frequency_rank INT, "
    "recipient_id STRING, DOsentence STRING, PDsentence STRING"
)
VERBS_SCHEMA = (
    "classification STRING, verb_id INT, frequency_rank INT, verb STRING, def_1 STRING, "
    "def_2 STRING, indef_3 STRING, indef_4 STRING, something_5 STRING, `extra theme` STRING, "
    "POSSESSIVE INT, `plural recipent` INT, notes STRING"
)
FILLERS_SCHEMA = (
    "`group` STRING, item INT, plural STRING, classification STRING, frequency_rank INT, "
    "recipient_id STRING, sent_construct STRING, sentence STRING"
)
RATINGS_RAW_SCHEMA = (
    "Label STRING, `Field name` STRING, `Field value` STRING, PennElementType STRING, "
    "PennElementName STRING, Parameter STRING, Value STRING, partid STRING, sentence STRING, "
    "construct STRING, classification STRING, IO STRING, counter STRING, `group` STRING, item STRING"
)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: str | StructType, multi_line: bool = False, strict: bool = True
) -> DataFrame:
    """Read headed CSV by column name: blank cells, "NA" and NaN are NULL, doubled quotes are quotes.

    The header decides which cell belongs to which column; every column of ``schema`` must be in it, but
    an unnamed leading index column takes the schema's first name.  A cell that does not fit its
    type fails the job, or is NULL with ``strict=False``.  ``multi_line`` accepts line breaks inside
    cells but stops Spark from splitting files.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    paths = path if isinstance(path, str) else list(path)
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    raw = reader.csv(paths)
    if not raw.columns:
        return spark.read.schema(wanted).option("header", True).csv(paths)
    if "_c0" not in raw.columns:  # every file's header must agree with the first one's; unnamed columns can't be compared
        raw = reader.option("enforceSchema", False).csv(paths)
    names = {("" if c == "_c0" else c): c for c in raw.columns}
    missing = [f.name for f in wanted if f.name not in names]
    if missing == [wanted[0].name] and "" in names:
        names[missing.pop()] = names[""]
    if missing:
        raise ValueError(f"columns missing in {path}: {missing}")

    def typed(field) -> Column:
        text = F.col(f"`{names[field.name]}`")
        text = F.when(text != "NA", text)
        if field.dataType.simpleString() == "string":
            return text
        value = text.cast(field.dataType) if strict else text.try_cast(field.dataType)
        return F.when(~F.isnan(value), value) if field.dataType.simpleString() in ("double", "float") else value

    return raw.select(*[typed(f).alias(f.name) for f in wanted])


def read_replicas(
    spark: SparkSession, pattern: str, schema: str | StructType, name_regex: str, name_column: str = "model"
) -> DataFrame:
    """Read every file matching a wildcard, tagged from its own path: one scan for each distinct header.

    Cells go to the columns that a file's own header names, in whatever order.  A column of the schema that a
    file lacks is NULL in its rows, one that every file lacks is an error; columns that the schema doesn't name
    are left out.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    tag = F.regexp_extract(F.col("_metadata.file_path"), name_regex, 1).alias(name_column)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file in _files(spark, pattern):
        by_header.setdefault(tuple(_header(spark, file)), []).append(file)
    if len(by_header) < 2:
        return read_csv(spark, pattern, wanted).select("*", tag)
    named = {header: [f for f in wanted if f.name in header or (f.name == wanted[0].name and "_c0" in header)] for header in by_header}
    lost = [f.name for f in wanted if not any(f in fields for fields in named.values())]
    if lost:
        raise ValueError(f"columns missing in every file of {pattern}: {lost}")
    parts = []
    for header, files in by_header.items():
        part = read_csv(spark, files, StructType(named[header])).select("*", tag)
        parts.append(part.select(*[F.col(f"`{f.name}`") if f in named[header] else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted], name_column))
    return reduce(DataFrame.unionAll, parts)


def _files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the files that a pattern matches; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path")
    return sorted(row["path"] for row in listed.collect() if not row["path"].rsplit("/", 1)[-1].startswith(("_", ".")))


def _header(spark: SparkSession, file: str) -> list[str]:
    return spark.read.option("header", True).option("escape", '"').csv(file).columns


def read_csv_audited(
    spark: SparkSession, path: str | Sequence[str], schema: str | StructType, multi_line: bool = False
) -> tuple[DataFrame, DataFrame, dict[tuple[str, str], int]]:
    """Rows as ``read_csv`` gives them leniently, the cells it rejected, and counts by column and reason, from one scan.

    Rejected cells: file, row (from 1 in its file), column, cell, reason; a cell is rejected if it does not fit
    its type.  Counts also have cells that are missing (blank, "NA", NaN).
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    texts = read_csv(spark, path, StructType([StructField(f.name, StringType()) for f in wanted]), multi_line)
    placed = place_as_read(texts)
    return cast_audited(placed, {f.name: f.dataType.simpleString() for f in wanted}, {"file": F.col("__file"), "row": F.col("__row")}, drop=("__file", "__row", "__all"))


def write_csv(
    df: DataFrame,
    path: str,
    index_by: Sequence[str | Column] | None = None,
    index_name: str = "row_id",
    partition_by: Sequence[str] = (),
) -> None:
    """Write headed CSV; ``index_by`` adds a leading row index in that order."""
    if index_by is not None:
        df = number_rows(df, index_by, index_name)
        df = df.select(index_name, *[c for c in df.columns if c != index_name])
    writer = df.write.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
