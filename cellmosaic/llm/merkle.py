"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf, every ``lang`` a tree over its rows in the order of ``doc_id``, and
the trees' tops are the leaves of a last tree. A node has at most ``FANOUT`` children,
the consecutive nodes of the level below; levels are added while more than one node is left.

Digests travel along the edges in the order of node labels. A label is the last leaf below
a node, then its level, so that children come before their parent and only one open run
per level waits in the queue. Upwards a node takes its children's digests from the head of the queue and sends its own
digest to its parent's label; downwards the labels are taken in reverse, and a node sends
each child the part of the proof from the child's siblings to the root. The queue is
external: within a block of ``FANOUT ** BLOCK_LEVELS`` neighbours it is a heap, messages to
later blocks are rows in the shared folder that Spark's shuffle brings to their label. A
task holds one block, whatever the size of a tree, and a lost one is run again from
those rows.

Nulls: a null field counts as ``-`` in a leaf, a null ``lang`` is a tree of its own and
the first one, null ids come first. Rows of one id and ``lang`` are ordered by their leaf;
equal rows have equal leaves and each its own place. Texts are hashed whole. An empty table
gives an empty manifest. Other columns are ignored whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.operators.joins import join_dim
from cellmosaic.session import durable

FANOUT = 8
BLOCK_LEVELS = 3
BLOCK = FANOUT**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<place: int, siblings: string>>"
_ROOT_TREE = ""  # trees of a lang start with '=', that of null is '-'


def leaf_digest(**changed: Column) -> Column:
    """Lower-case hex sha256 of the fields of a row; ``changed`` replaces fields by name."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda digest, level: F.sha2(F.concat(
        F.substring(level["siblings"], F.lit(1), level["place"] * 64), digest,
        F.substring(level["siblings"], level["place"] * 64 + 1, F.length(level["siblings"])),
    ).cast("binary"), 256))


def _digest(parts: list[bytes]) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def levels_in_block(nodes: int) -> int:
    """Levels that a block adds to a tree that has so many nodes."""
    levels = 0
    while nodes > 1 and levels < BLOCK_LEVELS:
        nodes, levels = -(-nodes // FANOUT), levels + 1
    return levels


def _label(level: int, index: int, leaves: int) -> tuple[int, int, int]:
    return min((index + 1) * FANOUT**level, leaves), level, index


def sweep_up(leaves: list[bytes], levels: int) -> tuple[bytes, dict[tuple[int, int], list[bytes]]]:
    """Digest of a block's top and the children's digests of each of its inner nodes."""
    inner: dict[tuple[int, int], list[bytes]] = {}
    n = len(leaves)
    top = leaves[0]
    if not levels:
        return top, inner
    queue: list[tuple[tuple[int, int, int], int, bytes]] = []
    for position in range(n + 1):
        # nodes whose last leaf has been read are due before the next leaf
        while queue and (position == n or queue[0][0][0] <= position):
            at = queue[0][0]
            got = []
            while queue and queue[0][0] == at:
                got.append(heapq.heappop(queue)[2])
            _, level, index = at
            inner[level, index] = got
            top = _digest(got)
            if level < levels:
                heapq.heappush(queue, (_label(level + 1, index // FANOUT, n), index, top))
        if position < n:
            heapq.heappush(queue, (_label(1, position // FANOUT, n), position, leaves[position]))
    return top, inner


Step = tuple[int, str]


def sweep_down(n: int, levels: int, inner: dict[tuple[int, int], list[bytes]], suffix: list[Step]) -> Iterator[tuple[int, list[Step]]]:
    """(position, steps to the root) of each of ``n`` leaves; ``suffix`` holds the steps above the block."""
    if not levels:
        yield 0, suffix
        return
    queue = [(tuple(-v for v in _label(levels, 0, n)), suffix)]
    while queue:
        (_, level, index), above = heapq.heappop(queue)
        level, index = -level, -index
        children = inner[level, index]
        for place in range(len(children)):
            others = b"".join(children[:place] + children[place + 1:]).decode()
            steps = [(place, others), *above]
            child = index * FANOUT + place
            if level == 1:
                yield child, steps
            else:
                heapq.heappush(queue, (tuple(-v for v in _label(level - 1, child, n)), steps))


def _number(batches):
    """Rows of a sorted partition: its number and their place within it and their tree."""
    part = TaskContext.get().partitionId()
    tree, at = None, 0
    for batch in batches:
        places = []
        for t in batch.column("tree").to_pylist():
            if t != tree:
                tree, at = t, 0
            places.append(at)
            at += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64()), *batch.columns],
            ["part", "place", *batch.schema.names])


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``at``, the place from 0 within ``tree`` in the given order, and ``n``, the tree's size.

    Rows are sorted by ranges of tree and order, so that a large tree fills many tasks; places
    within a range are moved up by the rows of the ranges before it.
    """
    keys = ["tree", *order, "tie"]
    tied = nodes.withColumn("tie", F.monotonically_increasing_id())
    held = [f.name + " " + f.dataType.simpleString() for f in tied.schema.fields]
    placed = durable(
        tied.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
            _number, ", ".join(["part int", "place long", *held])))
    runs = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    own = Window.partitionBy("tree")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        "tree", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(own).alias("n"))
    joined = join_dim(placed, offsets, ["tree", "part"], ["place"])
    return joined.withColumn("at", F.col("place") + F.col("offset")).drop("part", "place", "offset", "tie")


def _tops(table: pa.Table) -> pa.Table:
    """Digest of the top of one block."""
    table = table.sort_by("at")
    n = table.column("n")[0].as_py()
    leaves = [d.hex().encode() for d in table.column("digest").to_pylist()]
    top, _ = sweep_up(leaves, levels_in_block(n))
    return pa.table({
        "tree": [table.column("tree")[0].as_py()], "at": pa.array([table.column("block")[0].as_py()], pa.int64()),
        "n": pa.array([-(-n // BLOCK)], pa.int64()), "digest": pa.array([bytes.fromhex(top.decode())], pa.binary())})


def _steps_down(key, table: pa.Table, above: pa.Table) -> pa.Table:
    """The nodes of one block with their steps; ``above`` is the row of the block's top."""
    if not table.num_rows or not above.num_rows:
        raise ValueError(f"no digest or no proof reached block {key}")
    table = table.sort_by("at").drop_columns("block")
    n = table.column("n")[0].as_py()
    leaves = [d.hex().encode() for d in table.column("digest").to_pylist()]
    levels = levels_in_block(n)
    _, inner = sweep_up(leaves, levels)
    suffix = [(s["place"], s["siblings"]) for s in above.column("proof")[0].as_py()]
    steps: list[list[Step]] = [[]] * len(leaves)
    for position, found in sweep_down(len(leaves), levels, inner, suffix):
        steps[position] = found
    kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))
    packed = pa.array([[{"place": p, "siblings": s} for p, s in row] for row in steps], kind)
    return table.append_column("proof", packed)


def _block() -> Column:
    return F.expr(f"at div {BLOCK}").alias("block")


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the tops of their blocks, of these blocks' blocks and so on, until each tree is one node."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        below = rounds[-1].select("tree", "at", "n", "digest", _block())
        rounds.append(durable(below.groupBy("tree", "block").applyInArrow(
            _tops, "tree string, at long, n long, digest binary")))
    return rounds


def _proofs(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest round with the column ``proof``; ``tops`` has it for each tree."""
    above = tops.select("tree", F.lit(0).cast("bigint").alias("at"), "proof")
    for nodes in reversed(rounds[:-1]):
        held = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
        senders = above.select("tree", F.col("at").alias("block"), "proof")
        above = nodes.withColumn("block", _block()).groupBy("tree", "block").cogroup(
            senders.groupBy("tree", "block")).applyInArrow(_steps_down, f"{held}, proof {PROOF}")
        if nodes is not rounds[0]:
            above = durable(above)
    if len(rounds) == 1:  # single nodes all of them
        return rounds[0].join(tops.select("tree", "proof"), "tree")
    return above


def manifest(docs: DataFrame, seen: Column | None = None) -> DataFrame:
    """Per row: doc_id, lang, position, leaf, seen_leaf, subroot, root and proof.

    ``proof`` lists the levels from the leaf up: the place of the own branch in its run and
    the digests of the others. ``seen`` may name another leaf of the same row, such as
    that of a copy to be verified; it travels along as ``seen_leaf``.
    """
    tree = F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    rows = docs.select(
        tree.alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(leaf_digest()).alias("digest"),
        F.unhex(F.lit(None).cast("string") if seen is None else seen).alias("seen"))
    leaves = durable(numbered(rows, ["doc_id", "digest"]))
    rounds = _rounds(leaves)
    subroots = durable(rounds[-1].select("tree", "digest"))
    upper = _rounds(durable(numbered(
        subroots.select(F.lit(_ROOT_TREE).alias("tree"), F.col("tree").alias("member"), "digest"), ["member"])))
    none = F.lit(None).cast(PROOF)
    start = upper[-1].select("tree", F.coalesce(none, F.array().cast(PROOF)).alias("proof"))
    tops = durable(_proofs(upper, start).select(F.col("member").alias("tree"), "proof", F.col("digest").alias("subroot")))
    root = upper[-1].select(F.col("digest").alias("root"))  # one row
    out = join_dim(_proofs(rounds, tops), tops.select("tree", "subroot"), ["tree"], ["at"]).join(F.broadcast(root))
    text = lambda c: F.lower(F.hex(c))
    return out.select(
        "doc_id", F.when(F.col("tree") != "-", F.substring("tree", 2, 2**30)).alias("lang"), F.col("at").alias("position"),
        text("digest").alias("leaf"), text("seen").alias("seen_leaf"), text("subroot").alias("subroot"),
        text("root").alias("root"), "proof")


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings of a proof from the leaf up."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: level["siblings"]), "").cast("binary"), 256)
