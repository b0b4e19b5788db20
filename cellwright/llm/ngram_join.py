"""Jaccard join on word shingles by count vectors in R-trees.

A document is the set of its 5-word shingles, as 64-bit hashes. Hashing shingles into groups makes
it a point: the numbers of its shingles in each group. Two documents share at most the sum of the
smaller of both numbers over all groups; a link takes 4/9 of both sizes together (a similarity of
0.8). That bound is used twice:

* Fine groups, one a hash value, deal documents out. Groups are in one order, rare ones first. If a
  document shares nothing in its first groups, up to a fifth of its shingles and one more, the
  minima of the others can't sum up to 0.8 of it. So each document is filed under these groups, its
  tiles, and any two linked documents meet in one. Tiles with one document are dropped.
* Coarse groups, about one for eight shingles, are the coordinates of an R-tree over the documents of
  a tile, and again over those of a cluster. A node has its points' largest number in each group;
  the summed minima of a document and a node bound what the document shares with any of its points.

Pairs that survive in a tile are not listed: a spanning forest of them is kept, so its size follows
the number of documents. Connected, these give clusters of candidates, in which surviving pairs are
verified on the shingles themselves; pairs that are connected already need no verification. A cluster
too large for a task is dealt out in blocks; what is connected in each is then represented by one of
its documents, and last, documents outside the largest class meet all of their size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .simhash import components

SIZE = 5
#: A link: 100 times the intersection is at least PERCENT times the union.
PERCENT = 80
#: Shingles for each coarse group, and the least number of groups.
LOAD, GROUPS = 8, 64
#: Points in a leaf of a tree.
LEAF = 32
#: So few points are compared pair by pair, by the same bounds.
FEW = 8
#: Documents of a tile that one task compares; all of a larger tile are candidates of each other.
TILE = 4096
#: Documents and shingles of a block of a cluster.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Words remembered, and shingles held to count those that come again.
WORDS, HELD = 1 << 18, 1 << 21
#: A shingle that came again so often is late in the order of groups; so many of them at most.
OFTEN, LATE = 8, 1 << 18

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class _Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, known: _Words | None = None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; with fewer words than SIZE, one of all."""
    known = _Words() if known is None else known
    # Lower-cases A-Z alone and splits at ASCII white space alone: what bytes methods do.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(SIZE, len(h))
    total = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total += h[k : len(h) - size + 1 + k] * _MULTIPLIERS[k]
    total ^= total >> np.uint64(32)
    total *= _MULTIPLIERS[4]
    total ^= total >> np.uint64(29)
    return np.unique(total)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def n_groups(n: int) -> int:
    """Coarse groups of a document of n shingles: a power of two."""
    out = GROUPS
    while out * LOAD < n:
        out *= 2
    return out


def counts(shingles_: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((shingles_ & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.uint32)


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """Counts in fewer groups."""
    return vector if len(vector) == groups else vector.reshape(-1, groups).sum(axis=0, dtype=np.uint32)


class Tree:
    """A packed R-tree over count vectors: leaves of LEAF points, slabs of leaves above, all in arrays.

    Points are tiled by size first, then by the group in which they differ most.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        m = len(sizes)
        leaves = -(-m // LEAF)
        slab = LEAF * max(1, int(np.ceil(np.sqrt(leaves))))
        by_size = np.argsort(sizes, kind="stable")
        parts = []
        for at in range(0, m, slab):
            part = by_size[at : at + slab]
            widest = int(np.argmax(vectors[part].var(axis=0))) if len(part) > LEAF else 0
            parts.append(part[np.argsort(vectors[part, widest], kind="stable")])
        self.points = np.concatenate(parts)
        self.vectors, self.sizes = vectors[self.points], sizes[self.points].astype(np.int64)
        self.starts = np.concatenate([np.arange(at, min(at + slab, m), LEAF) for at in range(0, m, slab)])
        self.ends = np.append(self.starts[1:], m)
        self.high = np.maximum.reduceat(self.vectors, self.starts, axis=0)
        self.least, self.most = np.minimum.reduceat(self.sizes, self.starts), np.maximum.reduceat(self.sizes, self.starts)

    def near(self, vector: np.ndarray, size: int, other: np.ndarray) -> np.ndarray:
        """Points marked in ``other`` that may be linked to one of this vector and size, most shared first."""
        wanted = other[self.points]
        some = np.logical_or.reduceat(wanted, self.starts)
        ok = some & (100 * self.most >= PERCENT * size) & (100 * size >= PERCENT * self.least)
        nodes = np.flatnonzero(ok)
        bound = np.minimum(vector, self.high[nodes]).sum(axis=1, dtype=np.int64)
        nodes = nodes[(100 + PERCENT) * bound >= PERCENT * (size + self.least[nodes])]
        if not len(nodes):
            return nodes
        at = np.concatenate([np.arange(self.starts[x], self.ends[x]) for x in nodes])
        at = at[wanted[at] & (100 * self.sizes[at] >= PERCENT * size) & (100 * size >= PERCENT * self.sizes[at])]
        bound = np.minimum(vector, self.vectors[at]).sum(axis=1, dtype=np.int64)
        keep = (100 + PERCENT) * bound >= PERCENT * (size + self.sizes[at])
        return self.points[at[keep][np.argsort(-bound[keep], kind="stable")]]


def _pair_by_pair(vectors, sizes, verify, label, first) -> list[tuple[int, int]]:
    """``forest`` of a few points, where a tree has a leaf only."""
    out = []
    for i in range(len(sizes)):
        for j in range(i):
            n, m = sizes[i], sizes[j]
            if label[i] == label[j] or 100 * min(n, m) < PERCENT * max(n, m) or first is not None and not (first[i] or first[j]):
                continue
            g = min(len(vectors[i]), len(vectors[j]))
            bound = int(np.minimum(folded(vectors[i], g), folded(vectors[j], g)).sum())
            if (100 + PERCENT) * bound >= PERCENT * (n + m) and (verify is None or verify(i, j)):
                out.append((i, j))
                gone = label[j]
                label = [label[i] if x == gone else x for x in label]
    return out


def forest(vectors: list[np.ndarray], sizes: np.ndarray, verify: Callable[[int, int], bool] | None = None, label: np.ndarray | None = None, first: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links among the points connect.

    A pair that the bound lets through is a link if ``verify`` says so, or without it. ``label``
    has what is connected already; of ``first``, if given, one of a pair must be marked.
    """
    label = np.arange(len(sizes)) if label is None else label.copy()
    groups = np.array([len(v) for v in vectors])
    if len(sizes) <= FEW:
        return _pair_by_pair(vectors, sizes.tolist(), verify, label.tolist(), first)
    rank = np.empty(len(sizes), dtype=np.int64)
    rank[np.argsort(sizes, kind="stable")] = np.arange(len(sizes))
    out = []
    for g in np.unique(groups):
        # Sizes of a link differ by a quarter at most: groups by a factor of two.
        inside = np.flatnonzero((groups == g) | (groups == 2 * g))
        if len(inside) < 2:
            continue
        flat = np.stack([folded(vectors[i], g) for i in inside])
        tree = Tree(flat, sizes[inside])
        for k, i in enumerate(inside):
            if groups[i] != g:
                continue
            other = (label[inside] != label[i]) & (rank[inside] > rank[i])
            if first is not None and not first[i]:
                other &= first[inside]
            if not other.any():
                continue
            for j in inside[tree.near(flat[k], int(sizes[i]), other)]:
                if label[j] != label[i] and (verify is None or verify(i, j)):
                    out.append((int(i), int(j)))
                    label[label == label[j]] = label[i]
    return out


def _order(found: np.ndarray, late: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Shingles in the order of their fine groups: by hash, those that come often last, the most frequent at the end."""
    if not len(late):
        return found
    at = np.minimum(np.searchsorted(late, found), len(late) - 1)
    return found[np.lexsort((found, np.where(late[at] == found, place[at], 0)))]


def tiles(found: np.ndarray, late: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The fine groups that a document is filed under, in order."""
    n = len(found)
    return _order(found, late, place)[: n - -(-PERCENT * n // 100) + 1]


def _point(key: bytes) -> int:
    """What stands for a set until it is verified; two sets that share it are both looked at."""
    return int.from_bytes(key[:8], "little", signed=True)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one for each shingle that came again among those held."""
    known, seen = _Words(), set()
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("point", pa.int64()), ("handle", pa.int64()), ("vector", pa.binary()), ("shingle", pa.int64()), ("times", pa.int64())])
    held, size = [], 0

    def again() -> pa.RecordBatch:
        value, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        value, times = value[times > 1], times[times > 1]
        none = lambda kind: pa.nulls(len(value), kind)
        return pa.RecordBatch.from_arrays([*map(none, schema.types[:-2]), _signed(value), pa.array(times)], schema=schema)

    for b in batches:
        rows = []
        for i, handle, text in zip(b.column("doc_id").to_pylist(), b.column("handle").to_pylist(), b.column("text")):
            found = shingles(text.as_py(), known)
            key = vector = None
            if len(found):
                key = xxhash.xxh3_128_digest(found)
                if key not in seen:  # copies are described once a task
                    seen.add(key)
                    vector = counts(found, n_groups(len(found))).astype("<u2").tobytes()
                    held.append(found)
                    size += len(found)
            rows.append((i, len(found), key, key and _point(key), handle, vector, None, None))
            if size > HELD:
                yield again()
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 8, schema)], schema=schema)
    yield again()


def _file(late: np.ndarray, place: np.ndarray):
    """Sets with their tiles, and with each how many shingles a set has, and has from that group on, in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Words(), set()
        for b in batches:
            at, of, reach = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text in b.column("text"):
                found = shingles(text.as_py(), known)
                key = xxhash.xxh3_128_digest(found)
                if len(found) and key not in seen:
                    seen.add(key)
                    own = tiles(found, late, place)
                    at.append(own)
                    of.append(np.full(len(own), _point(key), dtype=np.int64))
                    reach.append((len(found) << 32) + len(found) - np.arange(len(own), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(at)), *(pa.array(np.concatenate(x)) for x in (of, reach))], names=["tile", "point", "reach"])

    return run


def _meets(reach: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether two sets that share nothing before a tile can be linked: by their sizes, and what they have left."""
    left = np.minimum(reach & 0xFFFFFFFF, other & 0xFFFFFFFF)
    return (100 + PERCENT) * left >= PERCENT * ((reach >> 32) + (other >> 32))


def _shared(most: int):
    """Rows sorted by tile and point: points that meet another one in a tile, or star-shaped edges of tiles with too many.

    A pair is looked for in the first tile that it shares, so what comes before it in the order of
    groups is not shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 3
        star: tuple[int, int] | None = None  # a tile with too many points, and its first one

        def give(t: np.ndarray, p: np.ndarray, reach: np.ndarray) -> pa.RecordBatch:
            of_star = (t == star[0]) if star else np.zeros(len(t), dtype=bool)
            start = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, dtype=np.int64)
            size = np.diff(np.append(start, len(t)))
            row = np.zeros(len(t), dtype=bool)
            two = start[size == 2]
            row[two] = row[two + 1] = _meets(reach[two], reach[two + 1])
            for a, n in zip(start[size > 2], size[size > 2]):
                own = reach[a : a + n]
                row[a : a + n] = True if n > 64 else (_meets(own[:, None], own) & ~np.eye(n, dtype=bool)).any(axis=1)
            row &= ~of_star
            edge = of_star & (p != star[1]) if star else of_star
            n, m = int(row.sum()), int(edge.sum())
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(t[row]), pa.nulls(m, pa.int64())]), pa.array(np.concatenate([p[row], p[edge]])),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.full(m, star[1] if star else 0, dtype=np.int64))]),
            ], names=["tile", "a", "b"])

        for b in batches:
            t, p, reach = (np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, ("tile", "point", "reach")))
            if not len(t):
                continue
            new = np.append(True, (t[1:] != t[:-1]) | (p[1:] != p[:-1]) | (reach[1:] != reach[:-1]))
            t, p, reach = t[new], p[new], reach[new]
            last = int(np.flatnonzero(t != t[-1])[-1]) + 1 if t[0] != t[-1] else 0
            yield give(t[:last], p[:last], reach[:last])
            held = [t[last:], p[last:], reach[last:]]
            if star and star[0] != held[0][0]:
                star = None
            if star or len(held[0]) > most:
                star = star or (int(held[0][0]), int(held[1][0]))
                yield give(*held)
                held = [h[-1:] for h in held]
        yield give(*held)

    return run


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that agree on ``by``, which rows are sorted by."""
    rest: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(c).to_numpy(zero_copy_only=False) for c in by]
        new = np.zeros(b.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last != tuple(c[0] for c in columns)
        cuts = np.flatnonzero(new).tolist()
        for a, z in zip([0, *cuts] if not new[0] else cuts, [*cuts, b.num_rows] if not new[0] else [*cuts[1:], b.num_rows]):
            if new[a] and rest:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(b.slice(a, z - a))
        last = tuple(c[-1] for c in columns)
    if rest:
        yield pa.Table.from_batches(rest)


def _tile_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs in each tile that the bound lets through."""
    held: list[tuple[int, int]] = []
    give = lambda: pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], pa.int64()) for k in (0, 1)], names=["a", "b"])
    for run in _runs(batches, ["tile"]):
        points = run.column("point").to_pylist()
        vectors = [np.frombuffer(v, "<u2") for v in run.column("vector").to_pylist()]
        found = forest(vectors, run.column("n").to_numpy())
        held += [(min(points[i], points[j]), max(points[i], points[j])) for i, j in found]
        if len(held) > 1 << 16:
            held = list(dict.fromkeys(held))
            yield give()
            held = []
    held = list(dict.fromkeys(held))
    yield give()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of documents that are in a cluster, once a task for each cluster."""
    known, seen = _Words(), set()
    for b in batches:
        rows = []
        for cluster, text in zip(b.column("cluster").to_pylist(), b.column("text")):
            found = shingles(text.as_py(), known)
            key = xxhash.xxh3_128_digest(found)
            if len(found) and (cluster, key) not in seen:
                seen.add((cluster, key))
                rows.append((cluster, key, len(found), found.astype("<u8").tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["cluster", "key", "n", "shingles"])


def _verified(by: list[str]):
    """Verified links of each block that connect what is linked in it.

    With columns ``class`` (what is connected already) and ``first``, links are sought between
    classes only, and one end is of those that come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, by):
            keys = block.column("key").to_pylist()
            once = list({k: i for i, k in enumerate(keys)}.values())  # several tasks may have sent a set
            block, keys = block.take(once), [keys[i] for i in once]
            sets = [np.frombuffer(s, "<u8") for s in block.column("shingles").to_pylist()]
            vectors = [counts(s, n_groups(len(s))) for s in sets]
            label = first = None
            if "class" in block.column_names:
                label = np.unique(block.column("class").to_pylist(), return_inverse=True)[1]
                first = np.array(block.column("first").to_pylist(), dtype=bool)
            found = forest(vectors, np.array([len(s) for s in sets]), lambda i, j: linked(sets[i], sets[j]), label, first)
            yield pa.RecordBatch.from_arrays([pa.array([keys[x[k]] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return run


#: Up to this many edges one task connects; beyond it stars are made in rounds.
EDGES = 1 << 19


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Connected components of all edges of a partition: node, root (the least node), without the roots."""
    above: dict = {}

    def root(x):
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], names=["node", "root"])


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the least node that it reaches) of the nodes of edges (a, b) that aren't roots."""
    edges = materialize(edges.filter("a != b").distinct())
    if edges.count() > EDGES:
        return components(edges)
    kind = edges.schema["a"].dataType.simpleString()
    return materialize(edges.coalesce(1).mapInArrow(_union, f"node {kind}, root {kind}"))


def _block_links(points: DataFrame, by: list[str]) -> DataFrame:
    spread = points.repartition(*by).sortWithinPartitions(*by)
    return spread.mapInArrow(_verified(by), "a binary, b binary")


def _in_blocks(points: DataFrame, salt: int, block: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Points with a block of their cluster, and the clusters (cluster, blocks)."""
    sizes = points.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    return points.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("key", F.lit(salt)), "blocks")).drop("blocks"), sizes


def _across(points: DataFrame, known: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """Links between what ``known`` leaves apart in clusters of several blocks.

    Each document outside its cluster's largest class meets all of its cluster whose size allows a
    link: in pairs of blocks, one of such documents and one of all.
    """
    roots = connected(known)
    classed = points.join(roots, points["key"] == roots["node"], "left").withColumn("class", F.coalesce("root", "key")).drop("node", "root")
    kinds = classed.groupBy("cluster", "class").agg(F.count(F.lit(1)).alias("n"))
    largest = kinds.groupBy("cluster").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    # Sizes of a link are in the same step of a quarter or in neighbouring ones.
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT)) + 1e-9).cast("int")
    open_ = classed.join(largest, "cluster").withColumns({"first": F.col("class") != F.col("main"), "step": step}).drop("main", "kinds")
    sized = lambda df: df.groupBy("cluster", "step").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    few, many = materialize(sized(open_.filter("first"))), materialize(sized(open_))
    each = lambda df, side: df.select("cluster", F.col("step").alias(f"{side}_step"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(side))
    near = each(few, "s").withColumn("p_step", F.explode(F.sequence(F.col("s_step") - 1, F.col("s_step") + 1)))
    pairs = near.join(each(many, "p"), ["cluster", "p_step"])
    # A set that is outside the largest class is in blocks of both sides; where it meets itself it counts as one that comes first.
    dealt = lambda df, sizes, side: df.join(sizes, ["cluster", "step"]).withColumn(side, F.pmod(F.xxhash64("key", F.lit(2)), "blocks").cast("int")).drop("blocks").withColumnRenamed("step", f"{side}_step")
    a = dealt(open_.filter("first"), few, "s").join(pairs, ["cluster", "s_step", "s"])
    b = dealt(open_.withColumn("first", F.lit(False)), many, "p").join(pairs, ["cluster", "p_step", "p"])
    columns = ["cluster", "s_step", "s", "p_step", "p", "key", "n", "shingles", "class", "first"]
    return _block_links(b.select(*columns).unionByName(a.select(*columns)), columns[:5])


def _cluster_links(points: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """Links (a, b) of keys that connect what is linked within each cluster."""
    placed, sizes = _in_blocks(points, 0, block, block_shingles)
    found = materialize(_block_links(placed, ["cluster", "block"]))
    wide = materialize(sizes.filter("blocks > 1").select("cluster"))
    if wide.isEmpty():
        return found
    points = materialize(points.join(wide, "cluster", "left_semi").dropDuplicates(["cluster", "key"]))
    # Of what is connected the least key stands for all.
    stand = points.join(connected(found.join(points.select(F.col("key").alias("a")), "a", "left_semi")).select(F.col("node").alias("key")), "key", "left_anti")
    more = materialize(_block_links(_in_blocks(stand, 1, block, block_shingles)[0], ["cluster", "block"]))
    own = found.join(points.select(F.col("key").alias("a")), "a", "left_semi").unionByName(more)
    return found.unionByName(more).unionByName(materialize(_across(points, own, block, block_shingles)))


def late_shingles(described: DataFrame, often: int = OFTEN, most: int = LATE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come often, sorted, and their places in the order of groups; ``most`` at most.

    The order of groups decides how much work there is, never what is found.
    """
    seen = materialize(described.filter("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")).filter(F.col("times") >= often))
    steps = seen.groupBy(F.floor(F.log2("times") * 8).alias("step")).count().orderBy(F.desc("step")).collect()  # some hundred rows
    least, total = None, 0
    for r in steps:
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kept = seen.filter(F.floor(F.log2("times") * 8) >= least).toPandas()  # LATE rows at most
    value = kept["shingle"].to_numpy(np.int64).view(np.uint64)
    by_value = np.argsort(value)
    return value[by_value], kept["times"].to_numpy(np.int64)[by_value]


#: Up to this many hashes of texts are sent to all executors (a long and a long each); beyond it texts are joined with them.
SENT = 1 << 20


def jaccard_components(docs: DataFrame, tile: int = TILE, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, often: int = OFTEN) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``.

    component_id is the smallest doc_id reachable by links, the document's own included. A null
    text, or one without words, has no shingles and no links. Rows with a null doc_id take part;
    a component of such rows alone has a null component_id. Repeated rows are all returned. An
    empty table gives no rows; columns besides doc_id and text are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("handle"))
    described = materialize(texts.mapInArrow(_describe, "doc_id long, n long, key binary, point long, handle long, vector binary, shingle long, times long"))
    late, place = late_shingles(described, often)
    filed = texts.select("text").mapInArrow(_file(late, place), "tile long, point long, reach long")
    shared = materialize(filed.repartition("tile").sortWithinPartitions("tile", "point").mapInArrow(_shared(tile), "tile long, a long, b long"))
    points = described.filter("vector is not null").select("key", "point", "n", "vector").dropDuplicates(["key"]).drop("key")
    met = shared.filter("b is null").select("tile", F.col("a").alias("point")).join(points, "point")
    edges = met.repartition("tile").sortWithinPartitions("tile").select("tile", "point", "n", "vector").mapInArrow(_tile_edges, "a long, b long")
    found = connected(edges.unionByName(shared.filter("b is not null").select("a", "b")))
    clusters = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    # One text for each set of a cluster is read again.
    one = described.filter("key is not null").groupBy("key", "point").agg(F.min("handle").alias("handle"))
    one = materialize(one.join(clusters, one["point"] == clusters["node"]).select("handle", F.col("root").alias("cluster")))
    read = texts.join(F.broadcast(one) if one.count() <= SENT else one, "handle")
    sets = materialize(read.select("cluster", "text").mapInArrow(_sets, "cluster long, key binary, n long, shingles binary"))
    roots = connected(_cluster_links(sets, block, block_shingles))
    rows = described.filter("shingle is null").select("doc_id", "n", "key")
    rooted = rows.join(roots, rows["key"] == roots["node"], "left").select("doc_id", "n", F.coalesce("root", "key").alias("root"))
    # The least id by root is made first: a hot component sends a row a task.
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = rooted.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
