"""Each operator on odd rows: nulls, empty and very long texts, repeated rows, clashing columns, no rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("cellwright.llm")
from cellwright.llm import bpe, fingerprints, language, lines, lm_score, mixing, quality, simhash, token_counts  # noqa: E402
from cellwright.llm.tokenization import Stream, default_path, sufficient_lookahead, transducer, vocabulary  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and to in is that with for this are be on was from".split(), "fr": "de la le et les des une est que pour dans sur avec pas qui".split()}


def sentence(rng, lang, n):
    made = lambda: "".join(rng.choice(["th", "er", "on", "ing", "st"] if lang == "en" else ["eau", "oi", "é", "ou", "è"]) for _ in range(rng.randint(1, 4)))
    return " ".join(rng.choice(WORDS[lang]) if rng.random() < 0.4 else made() for _ in range(n))


def rows(seed=3, n=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        text = "\n".join(sentence(rng, lang, rng.randint(1, 60)) for _ in range(rng.randint(1, 6)))
        out.append((i * 3, text, lang, f"s{i % 9}", len(text)))
    shared = "All rights reserved by the site owners of this page"
    out = [(d, f"{t}\n{shared}" if d % 2 else t, lang, s, n) for d, t, lang, s, n in out]
    out += [(1000, None, "en", "s1", None), (1001, "", "en", None, 0), (1002, " \n\t ", None, "s2", 4), (1003, "one", "en", "s3", 3), (None, "no id here at all", "en", "s4", 17)]
    out += [(1004, "word " * 9000 + "end", "en", "s5", 45003), (1005, "x" * 30000, "fr", "s5", 30000), (1006, out[0][1], "en", "s6", 1), (1006, out[0][1], "en", "s6", 1), (1007, out[3][1] + " more", "en", None, 1)]
    out += [(1008, "<|endoftext|> inside ½ 日本語 don't '' İ", "en", "s7", 1), (1009, "12 34 ## !!", "en", "s7", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumns({"size": F.lit("mine"), "fingerprint": F.lit(1), "n_lines": F.lit("x"), "score": F.lit("y"), "row": F.lit(0), "key": F.lit(0)})
    return df.repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_line_dedup(docs, none):
    site = lambda s: s if s is not None else "\0"
    spread, first = {}, {}
    for d, t, _, s, _ in rows():
        for p, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                k = line.strip(" \t\n\x0b\x0c\r")
                spread.setdefault(k, set()).add(site(s))
                at = (-(2**63) if d is None else d, p)
                first[k] = min(first.get(k, at), at)
    want = Counter()
    for d, t, _, _, _ in rows():
        me = -(2**63) if d is None else d
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if len(spread.get(k := x.strip(" \t\n\x0b\x0c\r"), ())) < 4 or first[k] == (me, p))
        want[d, kept] += 1
    out = lines.dedup_lines(docs, min_sites=4)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want and {"size", "fingerprint", "n_removed"} <= set(out.columns)
    assert out.filter("n_removed > 0").count() > 5 and lines.dedup_lines(none).count() == 0


@pytest.mark.parametrize("lg_k,band", [(4, 4.0), (12, 0.0)])
def test_line_spread_is_exact_near_the_threshold(spark, lg_k, band):
    df = spark.range(12).selectExpr("id as doc_id", "concat('s', id) as source", "concat_ws('\n', transform(sequence(id, 11), i -> concat('line ', i))) as text")
    got = lines.line_spread(lines.text_lines(df), 6, lg_k, band).count()
    assert got == 7  # line i is on i + 1 sites


def test_line_dedup_of_many_rows_without_an_id(spark):
    df = spark.range(0, 100_000, 1, 8).selectExpr(
        "cast(null as long) as doc_id", "concat('s', id % 50) as source", "concat('own ', id, '\n\nshared line\n', if(id % 2 = 0, 'shared line', 'another ')) as text"
    )
    got = lines.dedup_lines(df).groupBy("n_lines", "n_removed", F.expr("size(split(text, '\n'))").alias("k")).count().collect()
    # The first occurrences are places 2 and 3, in every row without an id.
    assert {tuple(r) for r in got} == {(3, 1, 3, 50_000), (3, 0, 4, 50_000)}


def test_line_dedup_of_a_long_text_is_linear(spark):
    import time

    rows = [(0, "s0", "\n".join(f"line {i}" for i in range(60_000)))] + [(i, f"s{i}", rows_text) for i, rows_text in enumerate(["\n".join(f"line {k}" for k in range(60_000))] * 6, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    began = time.time()
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(df).select("doc_id", "n_lines", "n_removed").collect()}
    assert got == {0: (60_000, 0)} | {i: (60_000, 60_000) for i in range(1, 7)} and time.time() - began < 60


def test_mixing(docs, none):
    out = mixing.mix_sources(docs)
    got = out.toPandas()
    assert len(got) == len(rows()) and got["copies"].between(0, 2).all()
    size = lambda t: len((t or "").encode().split())
    per = Counter()
    for _, t, _, s, _ in rows():
        per[s] += size(t)
    names = sorted(k for k in per if k is not None) + [None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * sum(per.values())
    while True:
        level = rest / sum(weight[k] for k in open_)
        full = {k for k in open_ if level * weight[k] >= 2 * per[k]}
        if not full:
            break
        target |= {k: 2.0 * per[k] for k in full}
        rest -= sum(2.0 * per[k] for k in full)
        open_ -= full
    target |= {k: level * weight[k] for k in open_}
    for (s, t), _ in got.fillna({"source": "-"}).groupby(["source", "target"]):
        assert t == pytest.approx(target[None if s == "-" else s])
    again = mixing.mix_sources(docs.repartition(5))
    assert out.exceptAll(again).count() == 0 and mixing.mix_sources(none).count() == 0
    copies = mixing.emit_copies(docs, out)
    assert copies.columns == docs.columns and copies.count() == int(got["copies"].sum())
    taken = got.assign(w=got["copies"] * got["size"]).groupby("source", dropna=False).agg({"w": "sum", "target": "first", "size": "max"})
    assert ((taken["w"] - taken["target"]).abs() <= taken["size"] + 1e-6).all()


def test_mixing_does_not_depend_on_groups_and_spreads_shared_ids(spark):
    df = spark.range(0, 100_000, 1, 8).selectExpr(
        "case when id % 3 = 0 then null when id % 3 = 1 then 5 else id end as doc_id", "concat(repeat('word ', cast(id % 97 as int)), if(id % 2 = 0, cast(id as string), 'same')) as text",
        "if(id % 4 = 0, 'hot', null) as source", "id as own"
    )
    one, many = mixing.mix_sources(df), mixing.mix_sources(df.repartition(3), group=64)
    assert one.count() == 100_000 and one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    total = one.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.sum("copies").alias("n"))
    for r in total.collect():
        assert abs(r["taken"] - r["target"]) <= r["most"] + r["target"] / 1000
        # Each source gets its own copies, although its ids are those of the other as well.
        emitted = mixing.emit_copies(df, one).filter(F.col("source").eqNullSafe(F.lit(r["source"])))
        assert emitted.count() == r["n"] and emitted.agg(F.sum(F.size(F.array_remove(F.split("text", " "), "")))).first()[0] == r["taken"]
        assert emitted.groupBy("own").count().agg(F.max("count")).first()[0] <= 2


def chained(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), h)
    return h


def syncmers(letters):
    """Places and hashes of the closed syncmers, k-mer by k-mer."""
    k, s = fingerprints.K, fingerprints.S
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    w = [xxhash.xxh64_intdigest(x, 42) for x in letters]
    if len(w) < k:
        return [(0, xxhash.xxh64_intdigest(" ".join(str(signed(x)) for x in w).encode(), 42))] if w else []
    out = []
    for i in range(len(w) - k + 1):
        inner = [signed(chained(w[j : j + s])) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, chained(w[i : i + k])))
    return out


def plain_fingerprint(text):
    """Anchors of words, and the sketch of code points if these are few."""
    found = syncmers(text.encode().split())
    signed = lambda h: h - (1 << 32) if h >> 31 else h
    chars = sorted({signed(h >> 32) for _, h in syncmers([c.encode() for c in text])})[: fingerprints.ENOUGH] if text.encode().split() and len(found) < fingerprints.ENOUGH else []
    return found, chars


def plain_text(f):
    return "".join(f"{h >> 32:08x}{p:06x}" for p, h in f[0]) + ("." + "".join(f"{v & 0xFFFFFFFF:08x}" for v in f[1]) if f[1] else "")


def plain_likeness(f, g):
    a, b = ({h >> 32 for _, h in x[0]} for x in (f, g))
    both = sorted({*f[1], *g[1]})[: fingerprints.ENOUGH]
    alike = len(set(both) & set(f[1]) & set(g[1])) / len(both) if both else 1.0
    rest = max(0, fingerprints.ENOUGH - len(a | b))
    return (len(a & b) + rest * alike) / (len(a | b) + rest)


def test_syncmer_anchors_are_context_free(spark, docs, none):
    rng = random.Random(9)
    core = sentence(rng, "en", 60)
    df = spark.createDataFrame([(1, core), (2, sentence(rng, "en", 17) + " " + core), (3, core + " " + sentence(rng, "en", 30)), (4, sentence(rng, "en", 60))], "doc_id long, text string")
    got = {}
    for r in fingerprints.anchors(df).collect():
        got.setdefault(r["doc_id"], {})[r["pos"]] = r["hash"]
    assert {p + 17: h for p, h in got[1].items()} == {p: h for p, h in got[2].items() if 17 <= p <= 17 + 55}
    assert got[1] == {p: h for p, h in got[3].items() if p <= 55}
    n = len(got[1])
    assert 0.35 * 56 < n < 0.75 * 56  # two of four inner substrings: about a half of the k-mers


def test_fingerprints(docs, none):
    out = {}
    got = fingerprints.fingerprint_edits(docs).collect()
    for r in got:
        out.setdefault(r["doc_id"], []).append(r)
    assert len(got) == len(rows())
    by = {}
    for d, t, *_ in rows():
        by[d] = min(by.get(d, t or ""), t or "")
    order = sorted((d for d in by if d is not None), reverse=True) + [None]
    follower = dict(zip(order, order[1:] + order[:1]))
    for d, t, *_ in rows():
        t = t or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + by[follower[d]][:h]
        mine, other, after = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(by[follower[d]])
        want = (d, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_text(mine), plain_text(other), plain_likeness(mine, other), plain_likeness(mine, after), len({(p, h >> 32) for p, h in mine[0]} & {(p, h >> 32) for p, h in other[0]}))
        assert want in [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"], r["same_place"]) for r in out[d]]
    same = {r["fingerprint"] for r in (*out[0], *out[1006])}
    assert len(same) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.fingerprint_edits(none).count() == 0
    assert out[1000][0]["fingerprint"] == "" and out[1001][0]["near_edited"] == 1.0


def test_likeness_changes_little_with_one_word_more(spark):
    """A text and the same with one word more are near at every length."""
    rng = random.Random(17)
    word = sentence(rng, "en", 260).split()
    df = spark.createDataFrame([(n, " ".join(word[:n]), " ".join(word[: n + 1])) for n in range(20, 201)], "n int, a string, b string")
    both = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb")
    got = {r["n"]: r["l"] for r in both.select("n", fingerprints.likeness("fa", "fb").alias("l")).collect()}
    assert len(got) == 181 and min(got.values()) > 0.9, sorted(got.items(), key=lambda x: x[1])[:5]


def test_anchors_match_by_place(spark):
    rng = random.Random(19)
    core, more = sentence(rng, "en", 80), sentence(rng, "fr", 50)
    texts = [(1, f"{core} {more}"), (2, f"{sentence(rng, 'fr', 13)} {core}"), (3, sentence(rng, "en", 90)), (4, more), (None, core)]
    found = fingerprints.anchors(spark.createDataFrame(texts, "doc_id long, text string"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 2)], "a long, b long")
    got = {(r["b"], r["shift"]): (r["n_anchors"], r["first"], r["last"]) for r in fingerprints.match_anchors(pairs, found).collect()}
    own = dict(syncmers(core.encode().split()))
    assert got[2, 13] == (len(own), min(own), max(own)) and got[4, -80][0] == len(syncmers(more.encode().split()))
    assert not any(b == 3 and n > 2 for (b, _), (n, *_) in got.items())


def test_fingerprints_of_short_texts_and_of_texts_without_spaces(spark):
    rng = random.Random(31)
    han = "".join(chr(0x4E00 + i) for i in range(900))
    texts = [sentence(rng, "en", n) for n in (3, 6, 9, 15, 30, 70)] + ["".join(rng.choice(han) for _ in range(n)) for n in (40, 400, 9000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = fingerprints.fingerprint_edits(df).collect()
    assert all(0.1 < r["near_edited"] < 0.7 and r["near_next"] < 0.1 for r in got), got


def test_fingerprints_of_many_rows_without_an_id(spark):
    df = spark.range(0, 100_000, 1, 4).selectExpr("case when id = 7 then 7 end as doc_id", "concat('text number ', id) as text")
    got = fingerprints.fingerprint_edits(df)
    assert got.count() == 100_000 and got.filter("doc_id is null").select("fingerprint").distinct().count() > 99_000


def test_one_document_follows_itself(spark):
    r = fingerprints.fingerprint_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()


@pytest.mark.parametrize("head", [0, 20, 1 << 18])
def test_token_counts(docs, none, head):
    tok = vocabulary(default_path("word_bpe_49k.json")).library
    want = Counter((d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 500) for d, t, *_ in rows())
    out = token_counts.count_tokens(docs, limit=500, head=head)
    assert Counter(map(tuple, out.collect())) == want
    assert token_counts.count_tokens(none).count() == 0


def simple_hash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def component_of(fps, ids, radius=3):
    label = {i: i for i in range(len(fps))}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(len(fps)):
        known = [x for x in (least.get(find(i)), ids[i]) if x is not None]
        least[find(i)] = min(known) if known else None
    return [least[find(i)] for i in range(len(fps))]


def test_simhash(docs, none):
    ids, texts = [r[0] for r in rows()], [r[1] for r in rows()]
    fps = [simple_hash(t) for t in texts]
    assert [simhash.fingerprint(t, width=7) for t in texts] == fps
    want = Counter(zip(ids, (f"{f:016x}" for f in fps), component_of(fps, ids)))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for c in component_of(fps, ids)})


def test_keep_one_without_or_with_shared_ids(spark):
    a, b, c = ("alpha beta gamma delta epsilon " * 4, "one two three four five six seven " * 4, "ut enim ad minim veniam quis nostrud " * 4)
    df = spark.createDataFrame([(None, a), (None, a), (None, b), (None, c), (7, c), (8, c), (8, b + "x"), (8, b + "x"), (9, a + "and so on to another end")], "doc_id long, text string")
    fps = [simple_hash(r["text"]) for r in df.collect()]
    groups = component_of(fps, list(range(len(fps))))
    kept = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert len(kept) == len(set(groups)) and (7, c) in kept and (8, c) not in kept and (None, c) not in kept and len(set(kept)) == len(kept)
    assert {t for _, t in kept} >= {c} and len({component_of([*fps, simple_hash(t)], list(range(len(fps) + 1)))[-1] for _, t in kept}) == len(kept)


def test_covering_masks_cover():
    rng = random.Random(1)
    for depth in (0, 1):
        table = simhash.mask_table(depth)
        for _ in range(500):
            d = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(m & d == 0 for _, m in table)
    assert min(m.bit_count() for _, m in simhash.mask_table(2)) >= 56


@pytest.mark.parametrize("bucket", [1024, 3])
def test_links_of_a_crowd(spark, bucket):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = set(base)
    for _ in range(120):
        x = rng.choice(sorted(fps))
        fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash.links(df, bucket=bucket).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in edges)
    want = component_of(fps, signed)
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    groups = lambda labels: sorted(Counter(labels).values())
    assert groups(want) == groups([got.get(f, f) for f in signed])


def test_components_of_a_chain(spark):
    df = spark.range(1, 300).selectExpr("id as a", "id - 1 as b").unionByName(spark.createDataFrame([(900, 950)], "a long, b long"))
    got = dict(map(tuple, simhash.components(df).collect()))
    assert all(got[i] == 0 for i in range(1, 300)) and got[950] == 900


def test_language(spark, docs, none):
    rng = random.Random(8)
    data = [(i, sentence(rng, lang := ("en", "fr")[i % 2], rng.randint(5, 80)), lang) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.train(df, per_language=100)
    told = language.identify(df, model).filter(language.held_out(F.col("doc_id")))
    assert told.count() > 50 and told.filter("lang_pred = lang").count() >= 0.98 * told.count()
    odd = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert len(odd) == len({r[0] for r in rows()}) and all(0 <= r["score"] <= 1 for r in odd.values())
    assert {odd[i]["lang_pred"] for i in (1000, 1001, 1002, 1009)} == {"und"} and odd[1003]["lang_pred"] in ("en", "fr")
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id in (1000, 1001, 1002, 1009)").count() == 0
    junk = spark.createDataFrame([(1, "zqxj wvkp qqxz jjkw zzvx " * 30, None)], "doc_id long, text string, lang string")
    assert language.identify(junk, model).first()["rejected"]
    nothing = language.train(none)
    assert language.identify(docs, nothing).filter("lang_pred <> 'und'").count() == 0 and language.identify(none, model).count() == 0


def plain_prediction(model, text):
    """Nearest centroid of a text, n-gram by n-gram, in whole numbers and plain sums."""
    import math

    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not letters:
        return "und", 0.0
    line = f" {' '.join(letters)} "
    counts = Counter()
    mask, m = (1 << 64) - 1, 0x9E3779B97F4A7C15
    x = [ord(c) for c in line]
    keys = [v for v in x] + [a * 0x10001 + b + (1 << 40) for a, b in zip(x, x[1:])] + [a * 0x100000001 + b * 0x10001 + c + (1 << 41) for a, b, c in zip(x, x[1:], x[2:])]
    counts.update(((k * m) & mask) >> (65 - language.DIM.bit_length()) for k in keys)
    v = {k: math.log1p(n) * model.idf[k] for k, n in counts.items()}
    norm = math.sqrt(sum(t * t for t in v.values()))
    cos = [sum(t * float(c[k]) for k, t in v.items()) / norm for c in model.centroids]
    best = max(range(len(cos)), key=cos.__getitem__)
    return model.languages[model.owner[best]], min(1.0, max(0.0, cos[best]))


def test_language_by_brute_force(spark, docs):
    rng = random.Random(21)
    data = [(i, sentence(rng, lang := ("en", "fr")[i % 2], rng.randint(1, 60)), lang) for i in range(200)]
    data += [(1000 + i, t, None) for i, t in enumerate(["½ ² ① ٣ Ⅷ", "_", "½a", "é", "日本語 text", "", None, "12 ## ²²²", "ǅ ª", "a\u0301b"])]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.train(df, per_language=60)
    for r in language.identify(df, model).collect():
        lang, score = plain_prediction(model, r["text"])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-5), r
    told = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, model).collect()}
    assert [i for i in range(1000, 1010) if told[i] == "und"] == [1000, 1001, 1005, 1006, 1007]


def test_language_learns_a_bounded_number_of_languages(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "concat('some text ', id % 10) as text", "concat('l', id % 1000) as lang")
    model = language.train(df)
    assert len(model.languages) <= language.LANGUAGES and language.identify(df.limit(5), model).count() == 5


def test_language_rejects_foreign_texts_of_any_length(spark):
    rng = random.Random(12)
    foreign = "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 20
    short = [(10_000 + n, foreign[:n], None) for n in (8, 20, 35, 60, 200, 1000)] + [(20_000 + i, "天地玄黃宇宙洪荒日月盈昃辰宿列張"[:8 + i], None) for i in range(8)]
    own = [(30_000 + i, sentence(rng, ("en", "fr")[i % 2], n), None) for i in range(60) for n in (4, 12, 40)]
    # Long texts only, and a table of a few rows: no whole text is as short as what is told.
    for many, least in ((300, 60), (24, 60)):
        data = [(i, sentence(rng, lang := ("en", "fr")[i % 2], rng.randint(least, 80)), lang) for i in range(many)]
        model = language.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
        told = {r["doc_id"]: r["rejected"] for r in language.identify(spark.createDataFrame(short, "doc_id long, text string, lang string"), model).collect()}
        assert all(told.values()), told
        kept = language.identify(spark.createDataFrame(own, "doc_id long, text string, lang string"), model).filter("not rejected").count()
        assert kept >= 0.98 * len(own)


@pytest.mark.parametrize("chunk", [1, 2, 7, 500])
def test_counts_of_long_texts_do_not_depend_on_chunks(monkeypatch, chunk):
    text = sentence(random.Random(2), "fr", 700) + " 12 -- 日本語\n\n" + "x" * 1200 + " ½ end"
    whole = language._counts(text)
    monkeypatch.setattr(language, "CHUNK", chunk)
    assert np.array_equal(whole, language._counts(text)) and language._counts("12 " * 50) is None


def test_language_learns_from_labelled_rows_alone(spark):
    """Rows that share an id with a labelled one, without a lang or with another text, teach nothing."""
    rng = random.Random(9)
    data = [(i, sentence(rng, lang := ("en", "fr")[i % 2], rng.randint(20, 80)), lang) for i in range(200)]
    foreign = "Съешь же ещё этих мягких французских булок, да выпей чаю. "
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    many = spark.range(0, 100_000, 1, 4).selectExpr("0L as doc_id", f"repeat('{foreign}', 3) || id as text", "cast(null as string) as lang")
    same = spark.range(0, 50_000, 1, 4).selectExpr("4L as doc_id", "'the same text of a third of all rows, again and again' as text", "'en' as lang")
    clash = df.unionByName(many).unionByName(same).withColumns({"turn": F.lit("x"), "rank": F.lit(0), "share": F.lit(1)})
    model = language.train(clash, per_language=60)
    sample = language.sample_texts(clash, 60).collect()
    assert len(sample) <= 120 and not any("е" in r["text"] for r in sample) and len({r["text"] for r in sample}) == len(sample)
    assert model.languages == ["en", "fr"] and model.predict(foreign * 4)[2]
    held = {r[1] for r in df.filter(language.held_out(F.col("doc_id"))).collect()}
    assert not held & {r["text"] for r in sample}


def test_bpe(docs, none, spark):
    tok = vocabulary(default_path("byte_bpe_50k.json")).library
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for d, t, *_ in rows():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, bpe.encode_decode(docs).collect())) == want and bpe.encode_decode(none).count() == 0
    back = {(r["doc_id"], r["text"]) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {(d, t or "") for d, t, *_ in rows()}
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [128 + 60])], "doc_id long, ids array<int>")).count() == 2


def test_transducer_streams_like_the_whole():
    t = transducer(default_path("byte_bpe_50k.json"))
    rng = random.Random(6)
    for text in ("antidisestablishmentarianism" * 60, "".join(rng.choice("abcdeing th") for _ in range(6000)).replace(" ", ""), "aaaa" * 900):
        data = text.encode()
        whole = [t.ids[x] for x in t.merge(data)]
        for step in (1 if len(data) < 2000 else 97, 350):
            assert list(t.stream(data[i : i + step] for i in range(0, len(data), step))) == whole
    for _ in range(500):  # short runs are merged by ids
        data = "".join(rng.choice("abcdeinrst é日") for _ in range(rng.randint(1, 30))).encode()
        assert t._listed(data) == [t.ids[x] for x in t.merge(data)]
    assert sufficient_lookahead([(b"a", b"b"), (b"ab", b"c")]) == 2 and sufficient_lookahead([]) == 0


@pytest.mark.parametrize("chunk", [1, 3, 17, 400])
def test_texts_stream_like_the_whole(monkeypatch, chunk):
    """Chunks of any size give the library's ids, most of them before the text ends, and little is held."""
    path = default_path("byte_bpe_50k.json")
    coder, words = transducer(path), vocabulary(path)
    monkeypatch.setattr(Stream, "LONG", 40)
    rng = random.Random(4)
    run = lambda c, n: "".join(rng.choice(c) for _ in range(n))
    texts = [
        sentence(rng, "fr", 300), "don't we'll I'r e they've 'tis ''s 're'ss " * 9, run("abc", 3000), " " * 900 + "x", "\n \t " * 200, "!" * 500 + "s" * 300 + "<|endoftext|>" + "1" * 700,
        "a<|endof" + "<|endoftext|" + "<|endoftext|><|endoftext|>" * 3 + " b", run("天地玄黃宇宙，。", 1500), run("a'.1 \n", 2000), "x" * 200 + "'" * 200 + "s" * 200 + " " * 200 + "\n" * 200 + "é" * 200, "" , " ", "½٣" * 400, run(" ", 300),
    ]
    for text in texts:
        state, early, most = Stream(coder, words), [], 0
        for at in range(0, len(text), chunk):
            early += state.push(text[at : at + chunk])
            most = max(most, len(state.tail) + (len(state.run.held) if state.run else 0))
        rest = state.end()
        want = words.library.encode(text, add_special_tokens=False).ids
        assert early + rest == want, (text[:60], chunk)
        assert most <= coder.lookahead + 4 * (40 + 2 * state.keep + chunk) + 100
        if len(want) > 400:
            assert len(early) > 0.4 * len(want)
    text = sentence(rng, "en", 500)
    state = Stream(coder, words)
    early = sum(len(state.push(text[at : at + chunk])) for at in range(0, len(text), chunk))
    assert early > 0.95 * (early + len(state.end())) or chunk == 400
    assert [i for part in coder.encode(text, words, chunk) for i in part] == words.library.encode(text, add_special_tokens=False).ids


def brute_force_scores(data, path):
    """Every document against counts of all others: one pass over the corpus for each."""
    n_ids = lm_score._vocabulary_size(path)
    seqs = [[lm_score.START, *lm_score.encode(x or "", path).tolist()] for _, x, _ in data]
    pairs = [Counter(zip(s, s[1:])) for s in seqs]
    whole = {k: Counter() for k in (True, False)}
    for c, (_, _, mark) in zip(pairs, data):
        whole[bool(mark)].update(c)
    size = {k: sum(c.values()) for k, c in whole.items()}
    weight = {k: min(1.0, size[not k] / size[k]) for k in whole}
    share = {k: Counter() for k in whole}
    for k, c in whole.items():
        for (_, b), n in c.items():
            share[k][b] += n
    out = []
    for c, (_, _, mark) in zip(pairs, data):
        losses = []
        for k in (True, False):
            left, first = Counter(whole[k]), Counter()
            if k == bool(mark):
                left.subtract(c)
            for (a, _), n in left.items():
                first[a] += n
            q = lambda b: (share[k][b] + 1) / (size[k] + n_ids)
            p = lambda a, b: (weight[k] * left[a, b] + lm_score.MU * q(b)) / (weight[k] * first[a] + lm_score.MU)
            losses.append(sum(-n * np.log2(p(a, b)) for (a, b), n in c.items()) / max(1, sum(c.values())))
        out.append((sum(c.values()), *losses))
    return out


@pytest.mark.parametrize("head", [lm_score.HEAD, 300, 1])
def test_lm_score(spark, docs, none, head):
    rng = random.Random(5)
    data = [(i, sentence(rng, ("en", "fr")[i % 2], rng.randint(5, 60)), i % 2 == 0 and i < 50) for i in range(120)]
    data += [(200, data[0][1], True), (201, "", False), (202, None, True), (203, "word " * 3000, False), (204, data[3][1], False)]
    df = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string").repartition(3)
    targets = spark.createDataFrame([(i,) for i, _, mark in data if mark] * 2 + [(None,)], "doc_id long")
    marked = lm_score.mark_targets(lm_score.tokenize(df), targets)
    model = lm_score.train(marked, head=head)
    assert len(model.head[0]) <= head and (head == 300) <= (model.tail.count() > 0 < len(model.head[0]))
    got = {r["doc_id"]: r for r in lm_score.score(marked, model).collect()}
    assert len(got) == len(data)
    for (i, text, _), (n, t, o) in zip(data, brute_force_scores(data, model.path)):
        assert got[i]["n_tokens"] == n
        if n:
            assert (got[i]["target_loss"], got[i]["background_loss"], got[i]["score"]) == pytest.approx((t, o, t - o), abs=1e-9)
        else:
            assert got[i]["score"] is None
    good, bad = [got[i]["score"] for i in range(50, 120) if i % 2 == 0], [got[i]["score"] for i in range(120) if i % 2]
    assert max(good) < min(bad)
    odd = lm_score.score(lm_score.tokenize(docs).withColumn("is_target", F.lit(None).cast("boolean")), model, counted=False).collect()
    assert len(odd) == len(rows()) and {r["doc_id"] for r in odd if r["score"] is None} == {1000, 1001}
    empty = lm_score.mark_targets(lm_score.tokenize(none), targets)
    assert lm_score.score(empty, lm_score.train(empty, head=head)).count() == 0


def test_lm_score_spreads_rows_without_an_id(spark):
    df = spark.range(0, 5000, 1, 4).selectExpr("cast(null as long) as doc_id", "concat('word ', id % 7) as text").unionByName(spark.createDataFrame([(0, "x y")], "doc_id long, text string"))
    marked = lm_score.mark_targets(lm_score.tokenize(df), spark.createDataFrame([(0,)], "doc_id long"))
    assert marked.count() == 5001 and [r["doc_id"] for r in marked.filter("is_target").collect()] == [0] and marked.filter("doc_id is null").count() == 5000
    assert lm_score.score(marked, lm_score.train(marked)).count() == 5001


def test_encoding_of_long_runs():
    path = default_path(lm_score.VOCABULARY)
    for text in (" " * 100_000 + "a", "\n " * 50_000, "é" * 100_000, "a<|endoftext|>b", "!" * 70_000 + " x"):
        assert lm_score._encoding(path).decode(lm_score.encode(text, path).tolist()) == text
    text = sentence(random.Random(3), "fr", 40_000)
    assert lm_score.encode(text, path).tolist() == vocabulary(default_path("byte_bpe_50k.json")).library.encode(text, add_special_tokens=False).ids


def repeats(w, size=8):
    seen = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return len({i + j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(size)})


def test_quality(docs, none):
    got = {}
    for r in quality.judge_quality(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows())
    for d, t, *_ in rows():
        r, t = got[d][0], t or ""
        w = [x.decode() for x in t.encode().split()]
        ls = [x for x in t.split("\n") if x.encode().split()]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), repeats(w))
        assert r["base_failed"] == (len(w) < 20 or 100 * repeats(w) > 30 * len(w)) and not (r["kept"] and r["base_failed"])
    assert got[1003][0]["char_distance"] is None and got[1004][0]["base_failed"]
    assert quality.judge_quality(none).count() == 0


def test_quality_tells_shouting_from_prose(spark):
    rng = random.Random(7)
    data = [(i, sentence(rng, "en", 200), "en") for i in range(30)] + [(99, sentence(rng, "en", 200).upper().replace(" ", "!! "), "en"), (98, " ".join("#$%&"[rng.randrange(4)] * 3 + w for w in sentence(rng, "en", 150).split()), "en")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge_quality(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(30)) and not got[99] and not got[98]


def test_quality_tells_word_lists_from_prose(spark):
    rng = random.Random(13)
    made = lambda: "".join(rng.choice(["th", "er", "on", "ing", "st", "ar"]) for _ in range(rng.randint(2, 4)))
    data = [(i, sentence(rng, "en", n), "en") for i, n in enumerate([70, 100, 150, 300, 1000] * 20)]
    data += [(1000 + i, " ".join(w for w in (made() for _ in range(n)) if w not in quality.VOCABULARY), "en") for i, n in enumerate((160, 300, 700, 2000))]
    got = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert all(r["kept"] for i, r in got.items() if i < 1000) and not any(r["kept"] or r["base_failed"] for i, r in got.items() if i >= 1000)
