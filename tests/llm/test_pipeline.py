"""The corpus pipeline against a version without Spark, on a small table."""

import hashlib
import math
from collections import Counter

import pytest
from test_operators import SCHEMA, component_of, rows, simple_hash

pytest.importorskip("cellwright.llm")
pipeline = pytest.importorskip("corpus_pipeline")
from tokenizers import Tokenizer  # noqa: E402

from cellwright.llm import bpe, language, lines, mixing  # noqa: E402
from cellwright.llm.tokenization import default_path  # noqa: E402

BLANK = " \t\n\x0b\x0c\r"


def without_boilerplate(docs):
    sites, first = {}, {}
    place = lambda d, p: (-(2**63) if d is None else d, p)
    for d, t, _, s, _ in docs:
        for p, line in enumerate((t or "").split("\n")):
            if k := line.strip(BLANK):
                sites.setdefault(k, set()).add(s)
                first[k] = min(first.get(k, place(d, p)), place(d, p))
    out = []
    for d, t, lang, s, n in docs:
        if t is not None:
            stays = lambda p, k: not k or len(sites[k]) < lines.MIN_SITES or first[k] == place(d, p)
            t = "\n".join(x for p, x in enumerate(t.split("\n")) if stays(p, x.strip(BLANK)))
        out.append((d, t, lang, s, None if t is None else len(t)))
    return out


def one_of_each(docs):
    group = component_of([simple_hash(t) for _, t, *_ in docs], list(range(len(docs))))
    best = {}
    for g, row in zip(group, docs):
        if g not in best or (row[0] is None, row[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = row
    return list(best.values())


def mixed(docs):
    size = lambda t: len((t or "").encode().split())
    bits = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:12], 16)
    per = Counter()
    for _, t, _, s, _ in docs:
        per[s] += size(t)
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, rest, left = {}, mixing.TOTAL_SHARE * sum(per.values()), set(names)
    while left:
        level = rest / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > 2 * per[s]}
        target |= {s: 2.0 * per[s] for s in full} or {s: level * weight[s] for s in left}
        rest -= sum(2.0 * per[s] for s in full)
        left = left - full if full else set()
    out = []
    for s in names:

        def key(row):
            n, text = size(row[1]), hashlib.md5((row[1] or "").encode()).hexdigest()
            h = bits(f"{mixing.SEED}:{'-' if row[0] is None else row[0]}:{text}")
            width = max(n, 1).bit_length() - 1
            return width * 8 + ((n << 3 >> width) & 7), h

        rate = target[s] / per[s] if per[s] else 0.0
        u = bits(f"{mixing.SEED}/{s or ''}") / (1 << 48)
        for i, row in enumerate(sorted((r for r in docs if r[3] == s), key=key), 1):
            out += [row] * (math.floor(i * rate + u) - math.floor((i - 1) * rate + u))
    return out


def test_pipeline(spark, tmp_path):
    table = spark.createDataFrame(rows(n=120), SCHEMA)
    table.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path))
    model = language.train(spark.read.parquet(str(tmp_path / "documents.parquet")))
    docs = [r for r in rows(n=120) if not model.predict(r[1])[2]]
    assert 100 < len(docs) < len(rows(n=120))
    docs = mixed(one_of_each(without_boilerplate(docs)))
    library = Tokenizer.from_file(default_path(bpe.VOCABULARY))
    want = Counter()
    for d, t, *_ in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[(d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter(map(tuple, got.collect())) == want


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
