"""BPE encoding and decoding of whole texts by a streaming transducer.

A document goes through in pieces: pre-tokens, ids as soon as they are final, and back to text by
an incremental decoder, so a task holds a piece of a document besides the document itself. Ids
are hashed as they come, unless they are asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenization import default_path, transducer, vocabulary

VOCABULARY = "byte_bpe_50k.json"


def _digest(text: str, path: str) -> tuple[int, str, str]:
    coder, n, ids_hash, text_hash = transducer(path), 0, hashlib.sha256(), hashlib.sha256()

    def noted() -> Iterator[list[int]]:
        nonlocal n
        for ids in coder.encode(text, vocabulary(path)):
            if ids:
                ids_hash.update(("," * (n > 0) + ",".join(map(str, ids))).encode())
                n += len(ids)
            yield ids

    for back in coder.decode(noted()):
        text_hash.update(back.encode("utf-8"))
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row.

    A null text is an empty one: no tokens, the digests of empty strings. Special strings inside
    a text become their own id, the library's default. Null or repeated doc_ids are passed
    through, an empty table gives no rows, columns besides doc_id and text are ignored.
    """
    path = path or default_path(VOCABULARY)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_digest(t.as_py() or "", path) for t in b.column("text")]
            n, ids, back = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>``: the ids themselves, for use as training data."""
    path = path or default_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [[i for part in transducer(path).encode(t.as_py() or "", vocabulary(path)) for i in part] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; bytes that are no UTF-8 become U+FFFD. Null ids: null."""
    path = path or default_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if (ids := x.as_py()) is None else "".join(transducer(path).decode([ids])) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
