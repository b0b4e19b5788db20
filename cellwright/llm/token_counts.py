"""Token counts without ids: pieces once per distinct pre-token, times its frequency.

1. Every document's pre-tokens are counted in the task that reads it and summed over the corpus.
2. Each distinct pre-token's pieces are counted once; the table goes to the shared folder.
3. Documents' frequencies are joined to it and summed. Frequent pre-tokens, at most ``HEAD`` of
   them by construction, are looked up from a broadcast table, which takes the hot keys and most
   of the rows out of the shuffle; all others go through an ordinary join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokenization import default_path, pieces, vocabulary

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Most pre-tokens in the broadcast table (some 15 bytes each).
HEAD = 1 << 18
#: Distinct pre-tokens that a task counts in memory before it hands them on.
FLUSH = 1 << 18


def _frequencies(text: str, path: str) -> tuple[Counter, int]:
    """Pre-token frequencies of a text, and the number of special strings in it."""
    vocab, found, special = vocabulary(path), Counter(), 0
    for part, is_special in vocab.sections(text):
        if is_special:
            special += 1
        else:
            for piece in pieces(part):
                found.update(vocab.pretokens(piece))
    return found, special


def pretoken_pieces(docs: DataFrame, path: str) -> DataFrame:
    """pretoken, n (in the corpus), pieces: one row a distinct pre-token."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["pretoken", "n"])
        for b in batches:
            for t in b.column("text"):
                total.update(_frequencies(t.as_py() or "", path)[0])
                if len(total) > FLUSH:
                    yield give()
                    total.clear()
        yield give()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([vocab.count(t) for t in b.column("pretoken").to_pylist()], pa.int32())], names=["pretoken", "n", "pieces"])

    counts = docs.select("text").mapInArrow(seen, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return counts.mapInArrow(count, "pretoken string, n long, pieces int")


def _head(table: DataFrame, most: int) -> tuple[dict[str, int], int]:
    """The pre-tokens that occur at least ``least`` times, with the lowest power of two as
    ``least`` for which there are no more than ``most``; their pieces, and ``least``."""
    steps = table.groupBy(F.floor(F.log2("n")).alias("k")).count().orderBy(F.desc("k")).collect()  # 64 rows at most
    total, k = 0, 62
    for row in steps:
        if (total := total + row["count"]) > most:
            break
        k = row["k"]
    rows = table.filter(F.col("n") >= F.lit(1 << k)).select("pretoken", "pieces").toPandas()
    return dict(zip(rows["pretoken"], rows["pieces"].tolist())), 1 << k


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row.

    A null text is an empty one: no bytes, no tokens. A special string inside a text is one
    token, the library's default. Rows that share a doc_id, equal ones too, are counted each for
    itself; a null doc_id is passed through; an empty table gives no rows; columns besides doc_id
    and text are ignored.
    """
    path = path or default_path(VOCABULARY)
    spark = docs.sparkSession
    table = materialize(pretoken_pieces(docs, path))
    known, least = _head(table, head)
    shared = spark.sparkContext.broadcast(known)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            cols: dict[str, list] = {k: [] for k in ("row", "doc_id", "n_bytes", "pretoken", "n")}

            def put(*values):
                for c, v in zip(cols.values(), values):
                    c.append(v)

            for row, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                text = text or ""
                found, n = _frequencies(text, path)
                rare = []
                for t, m in found.items():
                    if (p := known.get(t)) is None:
                        rare.append((t, m))
                    else:
                        n += p * m
                put(row, doc_id, len(text.encode("utf-8")), f"\0{row}", n)  # meets no pre-token, nor one key
                for t, m in rare:
                    put(row, None, None, t, m)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "pretoken" else pa.int64()) for k, v in cols.items()], names=list(cols))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.mapInArrow(split, "row long, doc_id long, n_bytes long, pretoken string, n long")
    rare = table.filter(F.col("n") < least).select("pretoken", "pieces")
    joined = rows.join(rare, "pretoken", "left").select("row", "doc_id", "n_bytes", (F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n"))
    summed = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
