"""The Merkle manifest, whitening and the Jaccard join against plain versions, on odd rows too."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("cellwright.llm")
from cellwright.llm import manifest, ngram_join, whitening  # noqa: E402

# Merkle manifest --------------------------------------------------------------------------------

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, at):
    for nodes in tree[:-1]:
        start = at // 8 * 8
        yield "".join(nodes[start:at]), "".join(nodes[at + 1 : start + 8])
        at //= 8


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for rs in by.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {x: levels([leaf(r, r[1]) for r in by[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for i, x in enumerate(langs):
        for j, r in enumerate(by[x]):
            steps = [*siblings(trees[x], j), *siblings(top, i)]
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(r, text)
            for a, b in steps:
                folded = digest(a + folded + b)
            out.append((r[0], trees[x][0][j], trees[x][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def manifest_rows(n=700):
    rng = random.Random(5)
    out = [(i * 7 - 100, " ".join(rng.choice(["Ab", "c", "É", "dD", "ef"]) for _ in range(rng.randint(0, 9))), rng.choice(["en", "fr", "Ä", ""]), rng.choice(["s", None]), i) for i in range(n)]
    out += [(5, "Only one", "zz", None, None), (None, "No Id", "en", "s", 1), (None, "No Id", "en", "s", 1), (None, None, None, None, None), (6, None, None, "x", 0), (6, "", None, "x", 0)]
    return out + [out[3]] * 40 + [(10_001, "Long " * 30_000, "fr", "s", 150_000)]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_manifest(spark, depth):
    rows = manifest_rows()
    docs = spark.createDataFrame(rows, FIELDS).withColumns({"leaf": F.lit("mine"), "tree": F.lit(1), "pos": F.lit(2)}).repartition(4)
    got = sorted(map(tuple, manifest.merkle_manifest(docs, levels=depth).collect()), key=repr)
    assert got == plain_manifest(rows)


def test_manifest_of_one_and_of_none(spark):
    one = [(3, "A", None, None, None)]
    got = list(map(tuple, manifest.merkle_manifest(spark.createDataFrame(one, FIELDS)).collect()))
    assert got == plain_manifest(one) and got[0][1] == got[0][2] == got[0][3]
    assert manifest.merkle_manifest(spark.createDataFrame([], FIELDS)).count() == 0


# Whitening --------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def test_whitening(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(7, 7)) * np.array([9, 6, 4, 3, 2, 1, 0.5])
    good = [(i, [float(np.float32(v)) for v in mix @ rng.normal(size=7)], i % 3) for i in range(400)]
    good += [good[0]] * 3 + [(None, good[7][1], None)]
    bad = [(900, None, 1), (901, [1.0, None] + [0.0] * 5, 1), (902, [float("nan")] + [0.0] * 6, 1), (903, [float("-inf")] + [0.0] * 6, 1), (904, [1.0, 2.0], 1), (905, [], 1), (906, [3e38] * 7, 1)]
    df = spark.createDataFrame(good + bad, VECTORS).withColumns({"n": F.lit("x"), "w": F.lit(0), "component": F.lit(1)}).repartition(3)
    got = whitening.whiten(df, components=5).collect()
    assert len(got) == 5 * len(good)
    x = np.floor(np.array([v for _, v, _ in good], dtype=float) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    c = x - s / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1], vector[:, ::-1]
    white = c @ vector[:, :5] / np.sqrt(value[:5])
    for k in range(5):
        mine = sorted((r for r in got if r["component"] == k + 1), key=lambda r: (r["vec_id"] is not None, r["vec_id"] or 0))
        order = sorted(range(n), key=lambda i: (good[i][0] is not None, good[i][0] or 0))
        w = np.array([r["whitened"] for r in mine])
        assert [r["deviation"] for r in mine] == deviation[order].tolist()
        assert min(np.abs(w - white[order, k]).max(), np.abs(w + white[order, k]).max()) < 1e-9
        assert abs(mine[0]["explained"] * value.sum() / value[k] - 1) < 1e-9
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9


def test_whitening_without_variance(spark):
    same = [(i, [1.0, 2.0, 3.0], 0) for i in range(5)]
    line = [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(6)]
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame(same[:1], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame(same, VECTORS)).count() == 0
    got = whitening.whiten(spark.createDataFrame(line, VECTORS)).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-9


def test_deviations_beyond_64_bits(spark):
    far = [(i, [float(v), -float(v)], 0) for i, v in enumerate((0, 2**40, -(2**40)))]
    got = {r["vec_id"]: r for r in whitening.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>, label int")).filter("component = 1").collect()}
    assert got[0]["deviation"] == 0 and got[1]["deviation"] is None and abs(got[1]["explained"] - 1) < 1e-9
    assert got[1]["whitened"] == pytest.approx(-got[2]["whitened"])


# Jaccard join -----------------------------------------------------------------------------------


def shingle_set(text):
    words = (text or "").encode("utf-8").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_join(rows):
    sets = [shingle_set(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    shared = " ".join(rng.choice(words) for _ in range(24))
    out = []
    for c in range(36):
        n = rng.choice([1, 3, 4, 5, 6, 9, 20, 60, 150, 700])
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(rng.choice([1, 2, 5, 25])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 40))):
                w[rng.randrange(n)] = rng.choice(words)
            if rng.random() < 0.3:
                w = w[: max(1, n - rng.randint(0, n // 8 + 1))]
            text = " ".join(w)
            out.append(((len(out) * 37) % 10007, f"{text}\n{shared}" if c % 3 == 0 and n > 5 else text))
    out += [(20_001, None), (20_002, ""), (20_003, " \n\t "), (20_004, out[3][1].upper()), (20_005, out[3][1]), (20_005, out[3][1]), (None, out[9][1]), (None, "no id and no other like this one"), (20_006, "İ é ß " * 30), (20_007, "x" * 30_000), (20_008, "same words " * 4_000)]
    return out + [(30_000 + k, out[5][1].replace(" ", "  ")) for k in range(60)]


@pytest.mark.parametrize("limits", [{}, {"tile": 3, "block": 4, "often": 2}, {"tile": 2, "block": 1}, {"block": 3, "block_shingles": 400, "often": 3}])
def test_jaccard_join(spark, texts, limits):
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"n": F.lit("x"), "key": F.lit(0), "cluster": F.lit(1), "root": F.lit(2), "handle": F.lit(3)}).repartition(5)
    got = sorted(map(tuple, ngram_join.jaccard_components(docs, **limits).collect()), key=repr)
    assert got == plain_join(texts)


def test_jaccard_join_of_none(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(none).count() == 0
    one = ngram_join.jaccard_components(spark.createDataFrame([(4, "a b c d e f")], "doc_id long, text string"))
    assert list(map(tuple, one.collect())) == [(4, 2, 4)]


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, size=rng.integers(40, 400), dtype=np.uint64)) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[rng.random(len(s)) < 0.95], rng.integers(0, 1 << 62, size=5, dtype=np.uint64)])) for s in sets]
    sizes = np.array([len(s) for s in sets])
    vectors = np.stack([ngram_join.counts(s, 64) for s in sets])
    tree = ngram_join.Tree(vectors, sizes)
    for i, s in enumerate(sets):
        near = set(tree.near(vectors[i], len(s), np.ones(len(sets), dtype=bool)).tolist())
        bound = np.minimum(vectors[i], vectors).sum(axis=1)
        allowed = (180 * bound >= 80 * (sizes + len(s))) & (100 * sizes >= 80 * len(s)) & (100 * len(s) >= 80 * sizes)
        assert near == set(np.flatnonzero(allowed).tolist())
        assert {j for j in range(len(sets)) if ngram_join.linked(s, sets[j])} <= near
