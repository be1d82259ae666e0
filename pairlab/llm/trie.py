"""Conversation prefix trie: every shared beginning of conversations as one node, by SQL ROLLUP over positional columns.

A turn is told by 128 bits of a digest of its role and text, followed by its number of words.  A
conversation becomes rows of ``COLUMNS`` turns, the last one filled up with nulls; a row also has the name of the node
that the conversation has reached before it.  One ``GROUP BY before, ROLLUP (t1, ..., tn)`` then aggregates all
prefixes of all lengths together, and ``grouping_id`` tells how many turns a group's prefix has.  A node's name
is a digest of the name before its row and of the row's turns up to it, so rows of long conversations need
not wait for the nodes of the rows before: all of them go through the same ROLLUP.

Sums over subtrees need no walk down the tree.  A node belongs to its smallest member, so each conversation owns the
lower end of its own path.  A second ROLLUP adds up, over a node's members, what each of them owns; of
that, only what the node's owner owns above the node is not in its subtree.

Turns of a conversation come in order through one task, one row of turns in memory at a time, and so do the
ids of the conversations that end at one node; groupings by node combine on the map side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.tables import Staged

#: Turns of a conversation in one row of the ROLLUP.
COLUMNS = 8

_ID_BYTES = 16


def _nothing() -> Column:
    return F.unhex(F.lit(""))


def _name(data: Column) -> Column:
    """Name of a node: 128 bits of a digest."""
    return F.unhex(F.left(F.sha2(data, 256), F.lit(2 * _ID_BYTES)))


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def numbered_turns(talk: DataFrame) -> DataFrame:
    """(conv_id, place, turn) of conversations (conv_id, turn, role, text): place from 1, turn as the trie wants it.

    Defined cases: a null turn number comes first; equal ones come in order of role and text; null roles and
    texts are empty; repeated rows are repeated turns; rows with a null conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = talk.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "role", "text"))
    told = F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")
    turn = F.concat(_name(told), F.unhex(F.lpad(F.hex(n_words(F.col("text")).cast("long")), 8, "0")))
    return rows.select("conv_id", place.cast("long").alias("place"), turn.alias("turn"))


def _rows(width: int):
    names = ["conv_id", "before", *[f"t{k + 1}" for k in range(width)], "n_before", "ends"]
    schema = pa.schema([(n, pa.bool_() if n == "ends" else pa.int64() if n in ("conv_id", "n_before") else pa.binary()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, before, held, done, out = None, b"", [], 0, []

        def emit(ends: bool) -> None:
            out.append((name, before, *held, *[None] * (width - len(held)), done, ends))

        for batch in batches:
            for conv, turn in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                if conv != name:
                    if name is not None:
                        emit(True)
                    name, before, held, done = conv, b"", [], 0
                if turn is None:
                    continue
                if len(held) == width:
                    emit(False)
                    before = hashlib.sha256(before + b"".join(held)).digest()[:_ID_BYTES]
                    held, done = [], done + width
                held.append(turn)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if name is not None:
            emit(True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    kinds = {"conv_id": "long", "n_before": "long", "ends": "boolean"}
    return run, ", ".join(f"{n} {kinds.get(n, 'binary')}" for n in names)


def _path(columns: list[str], upto: Column | None = None) -> Column:
    """Digest input: the name before the row and its turns, all of them or the first ``upto``."""
    parts = [F.coalesce(F.col(c), _nothing()) if upto is None else F.when(upto > k, F.coalesce(F.col(c), _nothing())).otherwise(_nothing()) for k, c in enumerate(columns)]
    return F.concat("before", *parts)


def _prefixes(rows: DataFrame, columns: list[str], sums: str) -> DataFrame:
    """Groups of one ROLLUP: node, parent, depth, n_words of the last turn, and the sums asked for."""
    listed = ", ".join(columns)
    grouped = rows.sparkSession.sql(
        f"SELECT before, n_before, {listed}, grouping_id() AS missing, {sums} FROM {{rows}} GROUP BY before, n_before, ROLLUP ({listed})", rows=rows
    )
    level = F.lit(len(columns)) - F.bit_count("missing")
    last = reduce(lambda rest, k: F.when(F.col("level") == k + 1, F.col(columns[k])).otherwise(rest), range(len(columns)), F.lit(None).cast("binary"))
    marked = grouped.withColumn("level", level).withColumn("last", last).where("last is not null or (level = 0 and n_before = 0)")
    one = F.col("level") == 1
    node = F.when(F.col("level") == 0, _nothing()).otherwise(_name(_path(columns)))
    parent = F.when(F.col("level") == 0, F.lit(None)).when(one, F.col("before")).otherwise(_name(_path(columns, F.col("level") - 1)))
    words = F.coalesce(F.conv(F.hex(F.substring("last", _ID_BYTES + 1, 4)), 16, 10).cast("long"), F.lit(0))
    rest = [c for c in grouped.columns if c not in ("before", "n_before", "missing", *columns)]
    return marked.select(node.alias("node"), parent.alias("parent"), (F.col("n_before") + F.col("level")).alias("depth"), words.alias("n_words"), *rest)


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each node, which come in order."""
    node, digest = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for name, conv in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
            if name != node:
                if digest is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = name, hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["node", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])


def prefix_trie(members: DataFrame, turns: DataFrame, width: int = COLUMNS) -> DataFrame:
    """One row per node of the trie of ``members`` (conv_id), whose turns are ``turns`` (conv_id, place, turn).

    ``turn`` is as ``numbered_turns`` makes it; places order a conversation's turns and need not be gapless.
    Columns: conv_id (smallest member), depth, parent_conv_id (the parent's), n_convs, n_children, n_leaves (childless
    nodes of the subtree), saved_tokens (over the subtree: members but one, times words of the last turn),
    ends_sha256 (members of that many turns), node and parent (names).

    Defined cases: members without turns belong to the root only; turns of no member are left out; repeated
    members count once; null ids are left out; without members there is no node, not even the root.
    """
    everyone = members.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    own = turns.join(everyone, "conv_id", "left_semi").select("conv_id", "place", "turn")
    started = own.unionByName(everyone.select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn")))
    ordered = started.repartition("conv_id").sortWithinPartitions("conv_id", F.col("place").asc_nulls_first()).select("conv_id", "turn")
    run, schema = _rows(width)
    staged = Staged(ordered.mapInArrow(run, schema), "turn-rows")
    rows, columns = staged.read(), [f"t{k + 1}" for k in range(width)]

    nodes = Staged(_prefixes(rows.drop("ends"), columns, "min(conv_id) AS conv_id, count(*) AS n_convs").withColumn("saves", (F.col("n_convs") - 1) * F.col("n_words")), "nodes")
    found = nodes.read()
    children = Staged(found.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    # what each conversation owns: the sum over its nodes, and whether the lowest of them is a leaf
    with_children = found.join(children.read(), "node", "left").select("node", "conv_id", "depth", "saves", F.col("n_children").isNull().cast("long").alias("leaf"))
    owned = with_children.groupBy("conv_id").agg(F.sum("saves").alias("owns"), F.sum("leaf").alias("leaves"), F.min("depth").alias("top"))
    tops = found.join(owned.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"], "left_semi").where("parent is not null")
    above = tops.select("conv_id", F.col("parent").alias("node")).join(found.select("node", F.col("conv_id").alias("above")), "node").select("conv_id", "above")
    owners = Staged(owned.join(above, "conv_id", "left"), "owners")

    weighed = rows.drop("ends").join(owners.read().select("conv_id", "owns", "leaves"), "conv_id", "left")
    below = _prefixes(weighed, columns, "sum(owns) AS owns, sum(leaves) AS leaves").select("node", F.coalesce("owns", F.lit(0)).alias("members_own"), F.coalesce("leaves", F.lit(0)).alias("n_leaves"))
    ends = rows.where("ends").select(F.when(F.col("t1").isNull(), _nothing()).otherwise(_name(_path(columns))).alias("node"), "conv_id")
    ends = ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_id_digests, "node binary, ends_sha256 string")

    upper = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    shared = found.where("n_convs > 1").withColumn("above_own", F.coalesce(F.sum("saves").over(upper), F.lit(0)))
    alone = found.where("n_convs = 1").withColumn("above_own", F.lit(None).cast("long"))
    out = shared.unionByName(alone).join(owners.read().select("conv_id", "top", "above"), "conv_id")
    out = out.join(children.read(), "node", "left").join(below, "node").join(ends, "node", "left")
    parent_conv = F.when(F.col("parent").isNotNull(), F.when(F.col("depth") == F.col("top"), F.col("above")).otherwise(F.col("conv_id")))
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", parent_conv.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        F.when(F.col("n_convs") > 1, F.col("members_own") - F.col("above_own")).otherwise(F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"), "node", "parent",
    )


def with_borrowed_starts(members: DataFrame, turns: DataFrame, group: int = 20, kinds: int = 4) -> DataFrame:
    """Turns of conversations rebuilt so that they share starts: (conv_id, place, turn).

    Conversation c takes the first h turns of conversation c - c % group, then its own turns after its first h, with
    h = crc32 of c's decimal digits modulo ``kinds``.  Fewer turns are borrowed where there are fewer, none from a
    conversation that is absent.
    """
    many = F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds
    starts = turns.where((F.col("place") < kinds) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("lender"), "place", "turn")
    ids = members.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    borrowed = ids.withColumn("lender", F.col("conv_id") - F.col("conv_id") % group).join(starts, "lender").where(F.col("place") <= many)
    own = turns.where(F.col("place") > many).withColumn("place", F.col("place") + kinds)
    return borrowed.select("conv_id", "place", "turn").unionByName(own.select("conv_id", "place", "turn"))
