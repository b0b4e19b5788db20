"""Language identification by nearest centroid, with rejection by distance.

A text is a vector of TF-IDF weights of its character n-grams (one to three letters, lower case,
within and at the ends of words), hashed to ``DIM`` dimensions and normalised. Each language has
several centroids, from clusters of its sample documents, so that kinds of text within a language
need not share one mean. A text goes to the language of the centroid with the highest cosine. One
that lies further from it than nearly all texts of about its length is rejected: the sample's texts
are cut to pieces of every length that they reach, so that no length lacks a limit because whole
documents of that length are rare. Pieces are held against centroids of the other half of the
sample, since a text is nearer to centroids that were made from it.

Training uses a bounded sample: at most ``PER_LANGUAGE`` labelled texts a language, those with the
smallest hash, each once however many rows have it, and at most ``SAMPLE`` texts of the
``LANGUAGES`` values of lang with the most texts. The driver gets the counts of these texts and
makes centroids; how near the sample's pieces are to centroids is found in tasks, and a quantile
for each length step comes back. Prediction sees the text alone.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialize

DIM = 1 << 13
PER_LANGUAGE = 400
LANGUAGES, SAMPLE = 64, 4800
CENTROIDS = 4
ROUNDS = 12
SEED = 11
#: Share of the sample's pieces of a length step that may lie beyond its rejection limit, and the slack
#: that multiplies the limit: rejection is for what is unlike any language, not for odd documents.
TAIL, SLACK = 0.005, 0.6
STEPS = 12
#: Pieces cut from a sample text for each length step that it reaches.
PIECES = 3
#: Characters vectorised at a time, so that memory doesn't follow a text's length.
CHUNK = 1 << 16
UNKNOWN = "und"


_BETWEEN = re.compile(r"[\W\d_]+")


@lru_cache(1)
def _numbers() -> tuple[re.Pattern, re.Pattern]:
    """Numbers that aren't decimal digits, such as ½, in the basic plane and beyond: no letters, but word characters."""
    odd = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha()]
    return tuple(re.compile(f"[{''.join(c for c in odd if (c > '\uffff') == far)}]+") for far in (False, True))


def _letters(text: str) -> str:
    """The letters of a text in lower case, with one space for all that stands between them."""
    text = _BETWEEN.sub(" ", text.lower())
    if not text.isascii():
        near, far = _numbers()  # apart, since only the first is a table to the regex engine
        text = near.sub(" ", text)
        if max(text) > "\uffff":
            text = far.sub(" ", text)
        text = " ".join(text.split())
    return text.strip()


def _buckets(before: str, new: str) -> np.ndarray:
    """The buckets of the n-grams that end in ``new``, which follows ``before``."""
    x = np.frombuffer((before + new).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    m, k = np.uint64(0x9E3779B97F4A7C15), len(before)
    one = x[k:] * m
    two = ((x[:-1] * np.uint64(0x10001) + x[1:] + np.uint64(1 << 40)) * m)[max(0, k - 1) :]
    three = ((x[:-2] * np.uint64(0x100000001) + x[1:-1] * np.uint64(0x10001) + x[2:] + np.uint64(1 << 41)) * m)[max(0, k - 2) :]
    return (np.concatenate([one, two, three]) >> np.uint64(64 - DIM.bit_length() + 1)).astype(np.int64)


def _counts(text: str) -> np.ndarray | None:
    """n-gram counts of a whole text in DIM buckets; None if it has no letter.

    A long text is taken in chunks; the two characters before a chunk are kept, so that n-grams
    across two of them count.
    """
    total = np.zeros(DIM, dtype=np.float64)
    before, within, some, at = "", False, False, 0  # within: the last chunk ended inside a word
    while at < len(text):
        end = min(len(text), at + CHUNK)
        letters = _letters(text[at:end])
        if letters:
            new = letters if within and text[at].isalpha() else f" {letters}"
            total += np.bincount(_buckets(before, new), minlength=DIM)
            before, some = (before + new)[-2:], True
            within = text[end - 1].isalpha()
        else:
            within = False
        at = end
    if not some:
        return None
    return total + np.bincount(_buckets(before, " "), minlength=DIM)


def _step(n: float) -> int:
    """The length step of a text with so many n-grams."""
    return min(STEPS - 1, int(np.log2(max(n, 1)) * 0.75))


def _pieces(text: str) -> Iterator[str]:
    """Parts of a text, spread over it, with about as many n-grams as the middle of each length step."""
    for s in range(1, STEPS):  # a letter alone is beyond step 0
        size = max(1, int(2 ** ((s + 0.5) / 0.75) / 3) - 1)  # a letter or gap has three n-grams, an edge too
        if size >= len(text):
            return
        for k in range(PIECES):
            start = (len(text) - size) * k // PIECES
            yield text[start : start + size]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of unit length
    owner: np.ndarray  # index of each centroid's language
    limit: np.ndarray  # least cosine that is not rejected, by length step

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, rejected. A text without a letter is ``und``, 0, rejected."""
        counts = _counts(text) if text else None
        if counts is None or not len(self.centroids):
            return UNKNOWN, 0.0, True
        cos = self.centroids @ _unit(counts, self.idf)
        best = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[best])))
        return self.languages[self.owner[best]], score, score < self.limit[_step(counts.sum())]


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (np.log1p(counts) * idf).astype(np.float32)
    norm = np.sqrt(v @ v)
    return v / norm if norm > 0 else v


def _cluster(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; at most k unit centroids."""
    k = min(k, len(rows))
    centres = rows[[int(rng.integers(len(rows)))]]
    while len(centres) < k:  # the row furthest from all so far
        centres = np.vstack([centres, rows[int(np.argmin((rows @ centres.T).max(axis=1)))]])
    for _ in range(ROUNDS):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.vstack([rows[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(k)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Whether a document may not be learned from: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_texts(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, turn, text: at most ``per_language`` texts of a language, none of a held-out row or one without an id or lang.

    Rows are told apart by lang and text alone: hashes of texts are ranked, each once, and what
    they stand for is looked up among the same rows, of which one a hash is kept.
    """
    text = F.xxhash64("text", F.lit(SEED))
    open_ = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", text.alias("rank"))
    sizes = open_.groupBy("lang").agg(F.approx_count_distinct("rank").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    per_language = max(1, min(per_language, SAMPLE // max(1, len(sizes))))
    # A cut of the hash's range leaves about twice the sample to rank, whatever the input's size.
    shares = [(r["lang"], min(1.0, 2.0 * per_language / r["n"]) if r["n"] > 4 * per_language else 1.0) for r in sizes]
    share = docs.sparkSession.createDataFrame(shares, "lang string, share double")  # LANGUAGES rows at most
    low = open_.select("lang", "rank").join(F.broadcast(share), "lang").filter(F.col("rank").cast("double") / float(1 << 64) + 0.5 <= F.col("share"))
    turn = F.row_number().over(W.Window.partitionBy("lang").orderBy("rank"))
    chosen = low.select("lang", "rank").distinct().withColumn("turn", turn).filter(F.col("turn") <= per_language)
    # SAMPLE rows at most are broadcast; copies of a text meet by partial aggregation.
    return open_.join(F.broadcast(chosen), ["lang", "rank"]).groupBy("lang", "turn").agg(F.min("text").alias("text"))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for lang, turn, t in zip(*(b.column(n).to_pylist() for n in ("lang", "turn", "text"))):
            if (c := _counts(t)) is not None:
                at = np.flatnonzero(c)
                out.append((lang, turn, at.astype(np.uint16).tobytes(), c[at].astype(np.uint32).tobytes()))
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["lang", "turn", "at", "n"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Learns from text and lang of at most ``per_language`` texts a language, none held out.

    The driver gets sparse counts of the bounded sample and makes a language's vectors dense one
    language at a time. A value of lang beyond the ``LANGUAGES`` most frequent is not learned, nor
    is a row whose lang, text or doc_id is null. An empty table gives a model that knows nothing.
    """
    sample = materialize(sample_texts(docs, per_language).repartition("lang", "turn"))
    rows = sample.mapInArrow(_sparse, "lang string, turn int, at binary, n binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["turn"]))
    seen = np.zeros(DIM)
    for r in rows:
        seen[np.frombuffer(r["at"], np.uint16)] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    languages = sorted({r["lang"] for r in rows})
    rngs = [np.random.default_rng(SEED) for _ in range(3)]
    parts, halves = [], ([], [])
    for i, lang in enumerate(languages):
        own = [r for r in rows if r["lang"] == lang]
        units = np.zeros((len(own), DIM), dtype=np.float32)
        for k, r in enumerate(own):
            units[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.uint32)
            units[k] = _unit(units[k], idf)
        parts.append(_cluster(units, centroids, rngs[2]))
        half = np.array([r["turn"] % 2 for r in own])
        for h in range(2):  # centroids of the other half
            if (half != h).any():
                halves[h].append((lang, _cluster(units[half != h], centroids, rngs[h])))
    centres = np.vstack(parts) if parts else np.zeros((0, DIM), dtype=np.float32)
    owner = np.repeat(np.arange(len(languages)), [len(p) for p in parts])
    return Model(languages, idf, centres, owner, _limits(sample, idf, halves) if languages else np.zeros(STEPS))


def _limits(sample: DataFrame, idf: np.ndarray, halves: tuple[list, list]) -> np.ndarray:
    """Least cosine that is not rejected, by length step, from whole and cut sample texts.

    Each half of a language's texts is held against centroids of the other half. A step that no
    text reaches has the limit of the nearest one below. A sample without two texts of a language
    tells nothing, and the limits are 0.
    """
    known = [{lang for lang, _ in h} for h in halves]
    shared = sample.sparkSession.sparkContext.broadcast([np.vstack([c for _, c in h]) if h else None for h in halves])  # bounded by LANGUAGES

    def nearness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps, found = [], []
            for lang, turn, text in zip(*(b.column(n).to_pylist() for n in ("lang", "turn", "text"))):
                if lang not in known[turn % 2]:
                    continue
                for piece in (text, *_pieces(text)):
                    if (c := _counts(piece)) is not None:
                        at = np.flatnonzero(c)
                        v = np.log1p(c[at]) * idf[at]
                        steps.append(_step(c.sum()))
                        found.append(float((shared.value[turn % 2][:, at] @ v).max() / max(np.sqrt(v @ v), 1e-12)))
            yield pa.RecordBatch.from_arrays([pa.array(steps, pa.int32()), pa.array(found, pa.float64())], names=["step", "cosine"])

    near = sample.mapInArrow(nearness, "step int, cosine double").groupBy("step").agg(F.percentile("cosine", F.lit(TAIL)).alias("low"))
    least = {r["step"]: r["low"] for r in near.collect()}  # STEPS rows
    limit = np.zeros(STEPS)
    for s in range(STEPS):
        limit[s] = SLACK * least[s] if s in least else limit[max(s - 1, 0)]
    return limit


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected added (or replaced).

    lang_pred is ``und``, with score 0 and rejected, if the text is null or has no letter, or if
    nothing was learned. All rows and other columns are kept; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's languages

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    new = ("lang_pred", "score", "rejected")
    told = docs.withColumn("__told", predict("text"))
    return told.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[F.col(f"__told.{c}").alias(c) for c in new])


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those that are rejected; no column is added."""
    told = identify(docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("__row", F.col("__row.text").alias("text")), model)
    return told.filter(~F.col("rejected")).select("__row.*")
