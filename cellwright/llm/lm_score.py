"""Language-model scoring by cross-entropy difference of matched models.

Two bigram models over one vocabulary, a public tokenizer's ids and a start mark: one of the
target documents, one of all others, the background. A document's score is the mean over its
tokens of the target model's loss minus the background model's, in bits; the lower, the more it
is like the target. With c a side's counts, q(b) its unigram shares with one added to each count,
and w its weight,

    p(b | a) = (w c(a, b) + MU q(b)) / (w c(a) + MU)

The models are matched: same vocabulary, order and smoothing, no document in both, and the counts
of the larger side weigh so much less that both sides hold as many tokens (w is the other side's
tokens over its own, at most 1). No document tells the model that scores it: its own bigrams are
taken off the counts of its side (leave one out).

Counts are of every document and no bigram is left out: the table grows with the corpus. Frequent
bigrams, at least one in ``HEAD`` of all and therefore ``HEAD`` of them at most, are looked up from
a broadcast table; that takes the hot keys and most rows out of the shuffle. A document's other
bigrams go through a join. There is one path for every size.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokenization import BYTEPIECE, default_path, pieces

VOCABULARY = "byte_bpe_50k.tiktoken"
MU = 50.0
#: Bits of an id in a bigram's key, and the id that stands before a text's first token.
SHIFT = 20
START = (1 << SHIFT) - 1
#: Most bigrams of the broadcast table: 24 bytes each.
HEAD = 1 << 19
#: Tokens gathered before they are counted, and bigrams before a task hands them on.
TOKENS, FLUSH = 1 << 20, 1 << 19
#: Keys under which rows without a doc_id are spread when they meet the targets.
SPREAD = 1 << 12

#: Longer runs of white space are encoded in pieces of this length.
_WHITE = re.compile(r"(\s{256})")


@lru_cache(4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:  # a file of the installed package
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=BYTEPIECE, mergeable_ranks=ranks, special_tokens={})


def _vocabulary_size(path: str) -> int:
    return _encoding(path).max_token_value + 1


def _kind(path: str) -> str:
    return "<u2" if _vocabulary_size(path) <= 1 << 16 else "<u4"


def encode(text: str, path: str) -> np.ndarray:
    """Ids of a whole text; strings of special tokens are ordinary text."""
    one = _encoding(path).encode_ordinary
    found = [np.array(one(part), dtype=_kind(path)) for piece in pieces(text) for part in _WHITE.split(piece) if part]
    return np.concatenate(found) if found else np.zeros(0, _kind(path))


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (16 or 32 bits an id, in a binary) of every row. A null text has no ids."""
    path = path or default_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode(text.as_py() or "", path).tobytes() for text in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def mark_targets(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """``tokens`` with is_target: whether ``targets`` has the doc_id (null: never).

    Kept in the shared folder, so that texts are encoded and shuffled once, as ids. Targets grow
    with the input: they are joined, never broadcast. Rows without a doc_id are spread.
    """
    wanted = targets.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    wanted = wanted.select("doc_id", F.lit(0).alias("spread"), F.lit(True).alias("is_target"))
    spread = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(0).cast("int")
    rows = tokens.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), spread.alias("spread"), "ids")
    both = rows.join(wanted.hint("merge"), ["doc_id", "spread"], "left")
    return materialize(both.select(F.when(F.col("spread") == 0, F.col("doc_id")).alias("doc_id"), "ids", F.coalesce("is_target", F.lit(False)).alias("is_target")))


def _keys(ids: bytes, path: str) -> np.ndarray:
    """Keys of a text's bigrams, one a token."""
    x = np.frombuffer(ids, dtype=_kind(path)).astype(np.int64)
    before = np.concatenate([np.array([START], np.int64), x[:-1]]) if len(x) else x
    return (before << SHIFT) | x


def count_bigrams(docs: DataFrame, path: str) -> DataFrame:
    """key, n_target, n_other of every bigram; ``docs`` has ids and is_target (null: not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: tuple[list, list] = ([], [])  # of others, of targets
        held = 0
        total = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def fold():
            nonlocal total, keys, held
            other, target = (np.concatenate([np.zeros(0, np.int64), *k]) for k in keys)
            every, at = np.unique(np.concatenate([total[0], other, target]), return_inverse=True)
            old, middle = len(total[0]), len(total[0]) + len(other)
            sums = [np.bincount(at[:old], old_n, len(every)).astype(np.int64) for old_n in total[1:]]
            total = (every, sums[0] + np.bincount(at[middle:], minlength=len(every)), sums[1] + np.bincount(at[old:middle], minlength=len(every)))
            keys, held = ([], []), 0

        give = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in total], names=["key", "n_target", "n_other"])
        for b in batches:
            for ids, mark in zip(b.column("ids"), b.column("is_target").to_pylist()):
                keys[bool(mark)].append(k := _keys(ids.as_py(), path))
                held += len(k)
                if held > TOKENS:
                    fold()
                    if len(total[0]) > FLUSH:
                        yield give()
                        total = tuple(x[:0] for x in total)
        fold()
        yield give()

    counted = docs.select("ids", "is_target").mapInArrow(run, "key long, n_target long, n_other long")
    return counted.groupBy("key").agg(F.sum("n_target").alias("n_target"), F.sum("n_other").alias("n_other"))


SIDES = ("target", "other")


@dataclass
class Model:
    """What the vocabulary bounds as arrays, the frequent bigrams, and the table of the others."""

    path: str
    before: dict[str, np.ndarray]  # c(a) by id, the start mark last
    share: dict[str, np.ndarray]  # q(b) by id
    weight: dict[str, float]
    head: tuple[np.ndarray, dict[str, np.ndarray]]  # keys in order, and their counts
    tail: DataFrame  # key, n_target, n_other


def train(docs: DataFrame, path: str | None = None, head: int = HEAD) -> Model:
    """``docs`` has ids, from ``tokenize``, and is_target. ``head`` bounds the frequent bigrams."""
    path = path or default_path(VOCABULARY)
    bigrams = materialize(count_bigrams(docs, path))
    n_ids = _vocabulary_size(path)
    ends = bigrams.select("n_target", "n_other", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.shiftright("key", SHIFT).alias("id")), F.struct(F.lit(1).alias("side"), F.col("key").bitwiseAND(F.lit(START)).alias("id")))).alias("e"))
    unigrams = ends.groupBy("e.side", "e.id").agg(F.sum("n_target").alias("target"), F.sum("n_other").alias("other")).toPandas()  # two rows an id at most
    before, share, total = {}, {}, {}
    for kind in SIDES:
        counts = np.zeros((2, n_ids + 1))
        ids = np.where(unigrams["id"] == START, n_ids, unigrams["id"]).astype(int)
        counts[unigrams["side"].to_numpy(dtype=int), ids] = unigrams[kind]
        before[kind], total[kind] = counts[0], float(counts[1].sum())
        share[kind] = (counts[1, :n_ids] + 1) / (total[kind] + n_ids)
    weight = {kind: min(1.0, total[other] / total[kind]) if total[kind] and total[other] else 1.0 for kind, other in (SIDES, SIDES[::-1])}
    least = max(1, -(-int(sum(total.values())) // head))
    frequent = F.col("n_target") + F.col("n_other") >= least
    top = bigrams.filter(frequent).toPandas().sort_values("key")  # ``head`` rows at most
    return Model(path, before, share, weight, (top["key"].to_numpy(), {k: top[f"n_{k}"].to_numpy() for k in SIDES}), bigrams.filter(~frequent))


def score(docs: DataFrame, model: Model, counted: bool = True) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (mean bits a token), score, for every row of
    ``docs``: doc_id, ids and is_target (null: not a target).

    With ``counted`` the model was trained on ``docs``, and each row's own bigrams are taken off.
    The three are null for a null text or one without tokens. Rows that repeat are scored each;
    a null doc_id is passed through; an empty table gives no rows; other columns are ignored.
    """
    spark, path, n_ids = docs.sparkSession, model.path, _vocabulary_size(model.path)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "ids", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    shared = spark.sparkContext.broadcast((model.before, model.share, model.weight, *model.head))

    def known(b: pa.RecordBatch):
        """Of each row of a batch: its own sums and its bigrams that are not frequent."""
        before, share, weight, head, n_head = shared.value
        for row, doc_id, ids, is_target in zip(*(b.column(c) for c in ("row", "doc_id", "ids", "is_target"))):
            keys, n = np.unique(_keys(ids.as_py(), path), return_counts=True)
            first = keys >> SHIFT
            _, turn = np.unique(first, return_inverse=True)
            n_first = np.bincount(turn, n) if len(keys) else np.zeros(0)
            a, z = np.where(first == START, n_ids, first), keys & START
            at = np.minimum(np.searchsorted(head, keys), max(len(head) - 1, 0))
            hit = head[at] == keys if len(head) else np.zeros(len(keys), bool)
            sums = []
            for side in SIDES:
                own = float(counted and is_target.as_py() == (side == "target"))
                under = weight[side] * (before[side][a] - own * n_first[turn]) + MU
                over = weight[side] * (n_head[side][at[hit]] - own * n[hit]) + MU * share[side][z[hit]]
                sums.append(float(n @ np.log2(under) - n[hit] @ np.log2(over)))
            yield row.as_py(), doc_id.as_py(), int(n.sum()), sums, is_target.as_py(), keys[~hit], n[~hit]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {k: [] for k in ("row", "key", "n", "is_target", "doc_id", "n_tokens", "target", "other")}
            for row, doc_id, n_tokens, sums, is_target, keys, n in known(b):
                # The row of the document itself has a key of its own that no bigram has.
                m = len(keys)
                for c, values in zip(cols.values(), ([row] * (m + 1), [-1 - row, *keys.tolist()], [None, *n.tolist()], [is_target] * (m + 1), [doc_id, *[None] * m], [n_tokens, *[None] * m], [sums[0], *[None] * m], [sums[1], *[None] * m])):
                    c += values
            kinds = {"is_target": pa.bool_(), "target": pa.float64(), "other": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()], names=list(cols))

    wide = rows.mapInArrow(spread, "row long, key long, n long, is_target boolean, doc_id long, n_tokens long, target double, other double")
    shares = spark.createDataFrame([(i, *(float(MU * model.share[k][i]) for k in SIDES)) for i in range(n_ids)], "id long, mu_target double, mu_other double")
    joined = wide.join(model.tail, "key", "left").join(F.broadcast(shares), F.col("key").bitwiseAND(F.lit(START)) == F.col("id"), "left")  # a row an id

    def loss(side: str):
        own = F.when(F.col("is_target") == F.lit(side == "target"), F.col("n")).otherwise(0) if counted else F.lit(0)
        over = F.lit(model.weight[side]) * (F.coalesce(f"n_{side}", F.lit(0)) - own) + F.col(f"mu_{side}")
        return F.sum(F.coalesce(side, -F.col("n") * F.log2(over)))

    summed = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), loss("target").alias("t"), loss("other").alias("o"))
    some = F.col("n_tokens") > 0
    out = summed.select("doc_id", "n_tokens", F.when(some, F.col("t") / F.col("n_tokens")).alias("target_loss"), F.when(some, F.col("o") / F.col("n_tokens")).alias("background_loss"))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
