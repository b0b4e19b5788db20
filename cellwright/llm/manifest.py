"""A Merkle manifest of a dataset: a root over all documents, and for each what proves it a part.

A document's leaf is the SHA-256 of its fields. The leaves of a language, by doc_id, are the bottom
of a tree in which every ``FANOUT`` consecutive nodes become their digest until one is left, the
language's subroot; the subroots, by language, are the bottom of one more tree, whose top is the
root.

Leaves are numbered by a range partition and an offset for each partition and language, so no task
sees all of a language. A tree is worked on in aligned blocks of FANOUT ^ LEVELS nodes: a block's
digests are one contiguous matrix of 64 hexadecimal bytes a row, reshaped by the fanout and hashed
row by row, level after level. What is left, a node for each block, is numbered already and goes the
same way, so that a tree of any size takes a few rounds. On the way down each block gets the
siblings above it, and finds those within it by index arithmetic.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialize

FANOUT = 8
#: Levels that a block takes at once: 8^4 = 4096 nodes, a matrix of 256 KB.
LEVELS = 4
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"
#: For each place in a run, the places of its siblings.
_OTHERS = np.array([[j for j in range(FANOUT) if j != k] for k in range(FANOUT)])


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The digest of a document's fields, of which some may be replaced."""
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def digests(nodes: list[str]) -> np.ndarray:
    """Digests as hexadecimal text as one matrix, a row each."""
    return np.frombuffer("".join(nodes).encode(), dtype=np.uint8).reshape(-1, WIDTH)


def up(nodes: np.ndarray) -> np.ndarray:
    """The next level: each run of FANOUT rows becomes its digest, the last one being shorter perhaps."""
    whole = len(nodes) // FANOUT * FANOUT
    runs = [*nodes[:whole].reshape(-1, FANOUT * WIDTH), *([nodes[whole:].reshape(-1)] if whole < len(nodes) else [])]
    return digests([hashlib.sha256(r).hexdigest() for r in runs])


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


def block_levels(nodes: np.ndarray, n: int, levels: int) -> list[np.ndarray]:
    """A block's levels, from its nodes up; ``n`` is the number of nodes of the whole tree."""
    out = [nodes]
    for _ in range(min(levels, height(n))):
        out.append(up(out[-1]))
    return out


def runs_and_siblings(nodes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For nodes ``at`` of a level: their runs (a row of FANOUT digests each), the siblings alone, and how many there are."""
    start = at - at % FANOUT
    size = np.minimum(FANOUT, len(nodes) - start)
    padded = np.vstack([nodes, np.zeros((FANOUT, WIDTH), dtype=np.uint8)])
    return padded[start[:, None] + np.arange(FANOUT)], padded[start[:, None] + _OTHERS[at % FANOUT]], size - 1


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(table.column("pos").to_numpy())))


def _climb(levels: int):
    def run(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        n = table.column("n")[0].as_py()
        top = block_levels(digests(table.column("node").to_pylist()), n, levels)[-1]
        size = FANOUT**levels
        return pa.table({"tree": table.column("tree")[:1], "pos": [table.column("pos")[0].as_py() // size], "n": [-(-n // size)], "node": [bytes(top[0]).decode()]})

    return run


def _paths(levels: int):
    """Nodes of a block with the path above it: their own paths to the root."""

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        table = _sorted(table)
        all_ = block_levels(digests(table.column("node").to_pylist()), table.column("n")[0].as_py(), levels)
        at, steps = np.arange(table.num_rows), []
        for nodes in all_[:-1]:
            _, others, count = runs_and_siblings(nodes, at)
            left = at % FANOUT
            steps.append([{"left": bytes(o[:k]).decode(), "right": bytes(o[k:c]).decode()} for o, k, c in zip(others, left, count)])
            at = at // FANOUT
        up_ = above.column("path")[0].as_py()
        paths = [[s[i] for s in steps] + up_ for i in range(table.num_rows)]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        same = {c: pa.array([above.column(c)[0].as_py()] * table.num_rows, pa.string()) for c in ("subroot", "root")}
        return pa.table({"tree": table.column("tree"), "pos": table.column("pos"), "path": pa.array(paths, kind), **same})

    return run


def _prove(levels: int):
    """A block of leaves with the path above it: the digest of each leaf's proof, and the root that it folds to."""

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        table = _sorted(table)
        leaves = digests(table.column("node").to_pylist())
        all_ = block_levels(leaves, table.column("n")[0].as_py(), levels)
        folded = digests([c or n for c, n in zip(table.column("changed").to_pylist(), table.column("node").to_pylist())])
        proofs, at = [hashlib.sha256() for _ in range(len(leaves))], np.arange(len(leaves))
        for nodes in all_[:-1]:
            runs, others, count = runs_and_siblings(nodes, at)
            runs[np.arange(len(at)), at % FANOUT] = folded
            for proof, o, c in zip(proofs, others, count):
                proof.update(o[:c].reshape(-1))
            folded = digests([hashlib.sha256(r[: c + 1].reshape(-1)).hexdigest() for r, c in zip(runs, count)])
            at = at // FANOUT
        tops = [bytes(f) for f in folded]
        for step in above.column("path")[0].as_py():
            left, right = step["left"].encode(), step["right"].encode()
            for proof in proofs:
                proof.update(left + right)
            tops = [hashlib.sha256(left + t + right).hexdigest().encode() for t in tops]
        subroot, root = (above.column(c)[0].as_py() for c in ("subroot", "root"))
        n = len(leaves)
        return pa.table({
            "doc_id": table.column("doc_id"), "leaf": table.column("node"), "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
            "proof_sha256": pa.array([p.hexdigest() for p in proofs], pa.string()), "folded_root": pa.array([t.decode() for t in tops], pa.string()), "verified": pa.array([t.decode() == root for t in tops], pa.bool_()),
        })

    return run


def numbered(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``nodes`` with ``pos`` in its ``tree`` by ``order`` and ``n``, the tree's nodes; and the largest n.

    Rows are range-partitioned by tree and order and keep the place they have in their sorted
    partition. An offset for each tree and partition, a row each, makes these places positions.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = nodes.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    spread = materialize(spread.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    by = W.Window.partitionBy("tree")
    offsets = spread.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    offsets = materialize(offsets.withColumns({"before": F.sum("here").over(by.orderBy("part")) - F.col("here"), "n": F.sum("here").over(by)}).drop("here"))
    out = spread.join(offsets, ["tree", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before"))
    return out.drop("part", "at", "first", "before"), offsets.agg(F.max("n")).first()[0] or 0


def _rounds(nodes: DataFrame, largest: int, levels: int) -> list[DataFrame]:
    """The nodes of all trees after each round of blocks; in the last, each tree has one."""
    out = [nodes]
    while largest > 1:
        blocks = out[-1].select("tree", "pos", "n", "node").groupBy("tree", F.floor(F.col("pos") / FANOUT**levels))
        out.append(materialize(blocks.applyInArrow(_climb(levels), "tree string, pos long, n long, node string")))
        largest = -(-largest // FANOUT**levels)
    return out


def _with_above(nodes: DataFrame, above: DataFrame, run, schema: str, levels: int) -> DataFrame:
    """Each block of nodes together with the row of ``above`` (tree, pos, path, subroot, root) of its node."""
    block = lambda df, pos: df.withColumn("block", pos.cast("long")).groupBy("tree", "block")
    return block(nodes, F.floor(F.col("pos") / FANOUT**levels)).cogroup(block(above, F.col("pos"))).applyInArrow(run, schema)


def merkle_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row of ``docs``.

    The proof is a leaf's siblings up to the root. folded_root is what leaf and siblings come to if
    the text's A to Z are in lower case, which is done where 3 divides the crc32 of the doc_id's
    decimal text (not where it is null); verified says whether that is the root. A null field
    differs from an empty one. Null ids come first, and rows that share an id are in the order of
    their leaves; rows alike in all fields have places side by side, and proofs of their own. A
    null lang is a language of its own, the first. An empty table gives no rows. Columns besides
    the five fields take no part.
    """
    lowered = F.translate("text", UPPER, LOWER)
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & F.col("text").rlike("[A-Z]")
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), leaf().alias("node"), F.when(hit, leaf(text=lowered)).alias("changed"),
        F.monotonically_increasing_id().alias("row"),  # deals rows that are alike over partitions
    )
    placed, largest = numbered(materialize(leaves), ["doc_id", "node", "row"])
    rounds = _rounds(placed, largest, levels)
    # The tree of subroots: a node for each language, in order of languages.
    last = rounds[-1].select(F.col("tree").alias("of"), "node", F.lit("").alias("tree"))
    tops, languages = numbered(last, ["of"])
    tops = materialize(tops)
    higher = _rounds(tops.select("tree", "pos", "n", "node"), languages, levels)
    path = "tree string, pos long, path " + _PATH + ", subroot string, root string"
    above = higher[-1].select("tree", "pos", F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    for nodes in higher[-2::-1]:
        above = _with_above(nodes, above, _paths(levels), path, levels)
    above = tops.select("pos", "of", "node").join(above.drop("tree", "subroot"), "pos").select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root")
    for nodes in rounds[-2:0:-1]:
        above = _with_above(nodes, materialize(above), _paths(levels), path, levels)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    bottom = rounds[0].select("tree", "pos", "n", "node", "changed", "doc_id")
    return _with_above(bottom, materialize(above), _prove(levels), schema, levels)
