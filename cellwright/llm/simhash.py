"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints within ``RADIUS`` bits of each other are linked, and documents reachable over links
form a component. Candidates come from bit masks with a guarantee instead of a probability:
each bit position gets a vector of RADIUS + 1 bits, and each of the 2^(RADIUS+1) - 1 nonzero
vectors v gives a mask of the positions whose vector has an odd inner product with v. For any
RADIUS positions some v is orthogonal to all their vectors, so whichever bits two linked
fingerprints differ in, some mask leaves them all out and the two collide in its table.

Work is done on distinct fingerprints, so exact copies cost one row however many there are. A
bucket of at most ``BUCKET`` fingerprints is compared in memory and yields a spanning forest of
its links, not all its pairs. A larger bucket is split again by covering masks of the bits its
mask left out, which keeps the guarantee; since fingerprints are distinct, a bucket that agrees
on all but f bits holds at most 2^f of them, so splitting ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

RADIUS = 3
BITS = 64
SHINGLE = 3
#: Most fingerprints of a bucket that one task compares with each other.
BUCKET = 1024
#: Third-level masks leave out at most 8 bits, so 2^8 distinct fingerprints agree on one.
BITS_LEFT = 1 << 8
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
#: Shingles hashed at a time: bounds a task's memory whatever a text's length.
CHUNK = 1 << 15


def fingerprint(text: str | None, size: int = SHINGLE, width: int = CHUNK) -> int:
    """The SimHash of a text as an unsigned 64-bit number; 0 for a text without words."""
    # Lower-cases A-Z alone and splits at ASCII white space alone: what bytes methods do.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    ones = np.zeros(BITS, dtype=np.int64)
    total = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, width):
        stop = min(total, at + width)
        h = np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts[at:stop], ends[at + size - 1 : stop + size - 1])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > total).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits in a signed long) and key (a hash of the text) for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t) for t in pdf["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fps.view(np.int64), "key": pdf["key"]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key")).mapInPandas(run, "doc_id long, fp long, key long")


def text_key() -> Column:
    """A hash that tells a document's texts apart; null and empty differ."""
    return F.xxhash64("text", F.col("text").isNull())


def covering_masks(free: int, radius: int = RADIUS) -> list[int]:
    """Masks over the set bits of ``free`` such that any ``radius`` of them are left out by one."""
    at = [i for i in range(BITS) if free >> i & 1]
    kinds = 2 ** (radius + 1) - 1
    # Positions go round the nonzero vectors in turn, so each mask takes about half of them.
    return [sum(1 << p for k, p in enumerate(at) if bin((k % kinds + 1) & v).count("1") % 2) for v in range(1, kinds + 1)]


def mask_table(depth: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(parent, mask) pairs of a level; a mask holds its parent's bits too, which still agree."""
    full = (1 << BITS) - 1
    level = [(-1, m) for m in covering_masks(full, radius)]
    for _ in range(depth):
        level = [(i, m | c) for i, (_, m) in enumerate(level) for c in covering_masks(full & ~m, radius)]
    return level


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is within ``radius`` in a bucket: at most len(fps) - 1 of them."""
    u = fps.view(np.uint64)
    label = np.arange(len(u))
    left, right = [], []
    for i in range(1, len(u)):
        near = np.flatnonzero(np.bitwise_count(u[:i] ^ u[i]) <= radius)
        if len(near):
            roots, first = np.unique(label[near], return_index=True)
            left += [fps[i]] * len(roots)
            right += fps[near[first]].tolist()
            label[np.isin(label[: i + 1], roots).nonzero()[0]] = i
            label[i] = i
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _bucket_links(radius: int):
    """Partition-wise, over rows that are sorted by (mask, key): no bucket is split by a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            m, k, fp = (pdf[c].to_numpy() for c in ("mask", "key", "fp"))
            cuts = [0, *(np.flatnonzero((m[1:] != m[:-1]) | (k[1:] != k[:-1])) + 1)]
            rest = pdf.iloc[cuts[-1] :]
            yield links(fp, cuts)
        if rest is not None and len(rest):
            yield links(rest["fp"].to_numpy(), [0, len(rest)])

    def links(fp: np.ndarray, cuts: list) -> pd.DataFrame:
        found = [_forest(fp[a:b], radius) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
        empty = np.array([], dtype=np.int64)
        return pd.DataFrame({"a": np.concatenate([empty, *(x[0] for x in found)]), "b": np.concatenate([empty, *(x[1] for x in found)])})

    return run


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect what distinct fingerprints (column fp) within ``radius`` connect."""
    spark = distinct.sparkSession
    spanning = None
    members = distinct.select("fp", F.lit(-1).alias("parent"))
    depth = 0
    while True:
        table = mask_table(depth, radius)
        mask_rows = spark.createDataFrame([(p, i, _signed(m)) for i, (p, m) in enumerate(table)], "parent int, mask int, bits long")
        keyed = members.join(F.broadcast(mask_rows), "parent").select("fp", "mask", F.col("fp").bitwiseAND(F.col("bits")).alias("key"))
        counts = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        small = keyed.join(counts.filter(F.col("n") <= bucket), ["mask", "key"], "left_semi")
        spread = small.repartition("mask", "key").sortWithinPartitions("mask", "key")
        found = spread.select("mask", "key", "fp").mapInPandas(_bucket_links(radius), "a long, b long")
        spanning = found if spanning is None else spanning.unionByName(found)
        large = keyed.join(counts.filter(F.col("n") > bucket), ["mask", "key"], "left_semi").select("fp", F.col("mask").alias("parent")).distinct()
        large = materialize(large)
        if large.isEmpty():
            return spanning
        depth += 1
        members = large
        if depth == 2:
            bucket = BITS_LEFT  # masks take at least 56 bits by now: no bucket holds more


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) rows: node, root (the smallest node it reaches).

    Large-star and small-star steps in turn until nothing changes; each step is a min by key and
    a join, and its result goes to the shared folder.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        # large: each node's larger neighbours, small: it and its smaller ones, go to its least.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    edges = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        edges = materialize(star(star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def _rooted(docs: DataFrame, radius: int, bucket: int) -> DataFrame:
    """doc_id, fp, key, root (a fingerprint of the component) and component_id for every row."""
    fps = materialize(fingerprints(docs))
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = materialize(components(links(distinct, radius, bucket)))
    rooted = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row of ``docs``.

    component_id is the smallest doc_id reachable over links, the document's own included. A null
    text, like one without words, has fingerprint zero and is linked like any other. Rows with a
    null doc_id take part; a component of such rows alone has a null component_id. Rows that
    repeat are all returned. An empty table gives no rows; columns besides doc_id and text are
    ignored.
    """
    return _rooted(docs, radius, bucket).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, a null one last.

    Of rows that share that doc_id, the one whose text has the smallest hash stays, and one of
    rows that are equal in both. Rows that share a doc_id but not a component each stand for
    their own. The choice is a minimum by component, so a large group sends a row a task.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")).alias("f")
    stay = _rooted(docs, radius, bucket).groupBy("root").agg(first).select(F.coalesce("f.doc_id", F.lit(NO_ID)).alias("__id"), F.col("f.key").alias("__key"))
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__key": text_key()})
    return keyed.join(stay.distinct(), ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
