"""Document fingerprints from closed syncmers, with DataFrame functions only.

The letters are the words of a text. A k-mer is ``K`` words in a row, its inner substrings are
the ``K - S + 1`` runs of ``S`` words. A k-mer is a closed syncmer, and chosen, if the smallest
hash of its inner substrings is that of the first or the last of them. Whether a k-mer is chosen
depends on its own words alone, so texts that share a passage choose the same anchors in it
wherever it stands; no window around it matters.

The fingerprint has all anchors of a text in order, each with its place, so that matches can be
held against each other by place (``match_anchors``). The likeness of two fingerprints is the
Jaccard similarity of their sets of 32-bit hashes. Few anchors say little, as of a short text or of
one in a script without spaces. So a text with fewer than ``ENOUGH`` anchors also has a bottom-k
sketch of the closed syncmers of its code points, and what two texts' anchors together lack to
ENOUGH is the weight of the likeness of these: it fades as anchors get more, and at no length does
the measure change at once. Two of a text's anchors fall on one 32-bit value with a chance of
n^2 / 2^33, which takes one of n away; two texts' anchors do so alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialize, words

K = 5
S = 2
#: Anchors of words that need no code points beside them, and the size of the sketch of these.
ENOUGH = 64
#: Stands for a null doc_id: the lowest of all.
NO_ID = -(1 << 63)


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _closed(docs: DataFrame, letters: str, out: str) -> DataFrame:
    """Adds ``out``: an array of structs (pos, hash), the closed syncmers of an array of letters' hashes.

    Fewer than K letters have one anchor, the hash of all; none have none, nor has a null array.
    """
    n = F.coalesce(F.size(letters), F.lit(-1))
    docs = docs.withColumn("__s", F.when(n >= K, F.transform(F.sequence(F.lit(0), n - S), lambda i: F.xxhash64(*[F.get(letters, i + j) for j in range(S)]))))
    m = K - S + 1
    inner = lambda i, js: F.least(*[F.get("__s", i + j) for j in js]) if len(js) > 1 else F.get("__s", i + js[0])
    chosen = F.filter(F.sequence(F.lit(0), n - K), lambda i: inner(i, [0, m - 1]) <= inner(i, list(range(1, m - 1))))
    kmers = F.transform(chosen, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(letters, i + j) for j in range(K)]).alias("hash")))
    short = F.when(n > 0, F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.concat_ws(" ", F.transform(letters, lambda h: h.cast("string")))).alias("hash")))).otherwise(
        F.array().cast("array<struct<pos:int,hash:bigint>>")
    )
    return docs.withColumn(out, F.when(n >= K, kmers).otherwise(short)).drop("__s")


def _with_anchors(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the anchors of a text's words, in order."""
    return _closed(docs.withColumn("__w", word_hashes(F.col(text))), "__w", out)


def anchors(docs: DataFrame) -> DataFrame:
    """One row an anchor, for positional matching: doc_id, pos (of its first word), hash."""
    return _with_anchors(docs.select("doc_id", "text"), "text", "__a").select("doc_id", F.inline("__a"))


def match_anchors(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """What pairs of documents (a, b) share, by place: a, b, shift, n_anchors, first, last.

    ``found`` has rows of ``anchors``. Anchors that both have are counted by how far their place
    in b is from that in a; first and last are the places in a of the first and last of them. A
    passage that both have in one piece is one row. A pair that shares nothing has no row.
    """
    left = pairs.select("a", "b").distinct().join(found.select(F.col("doc_id").alias("a"), F.col("pos").alias("at"), "hash"), "a")
    both = left.join(found.select(F.col("doc_id").alias("b"), "pos", "hash"), ["b", "hash"])
    return both.groupBy("a", "b", (F.col("pos") - F.col("at")).alias("shift")).agg(F.count(F.lit(1)).alias("n_anchors"), F.min("at").alias("first"), F.max("at").alias("last"))


def _low(found: str) -> Column:
    """The distinct 32-bit hashes of anchors, as ints."""
    return F.array_distinct(F.transform(found, lambda x: F.shiftright(x["hash"], 32).cast("int")))


def with_fingerprint(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: a struct of ``anchors`` (pos, hash), ``words`` (their 32-bit hashes) and ``chars`` (the sketch of code points)."""
    docs = _with_anchors(docs, text, "__a")
    few = (F.size("__w") > 0) & (F.size("__a") < ENOUGH)
    docs = _closed(docs.withColumn("__c", F.when(few, F.transform(F.split(F.col(text), ""), lambda c: F.xxhash64(c)))), "__c", "__b")
    sketch = F.slice(F.sort_array(_low("__b")), 1, ENOUGH)
    return docs.withColumn(out, F.struct(F.col("__a").alias("anchors"), _low("__a").alias("words"), sketch.alias("chars"))).drop("__a", "__b", "__c", "__w")


def _placed(fingerprint: str) -> Column:
    """Anchors as numbers: a hash's upper half, and the place below."""
    return F.transform(f"{fingerprint}.anchors", lambda x: x["hash"].bitwiseAND(F.lit(-1 << 32)).bitwiseOR(x["pos"].cast("long")))


def _hex(value: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(value), digits, "0"))


def as_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits of an anchor's hash and six of its place, for each; after a point the sketch's, if there is one."""
    found = F.array_join(F.transform(fingerprint["anchors"], lambda x: F.concat(_hex(F.shiftrightunsigned(x["hash"], 32), 8), _hex(x["pos"], 6))), "")
    sketch = F.array_join(F.transform(fingerprint["chars"], lambda v: _hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 8)), "")
    return F.when(sketch == "", found).otherwise(F.concat(found, F.lit("."), sketch))


def likeness(a: str, b: str) -> Column:
    """The likeness of two structs (words, chars), 0 to 1; 1 where both texts have no words."""
    aw, bw, ac, bc = (F.col(x)[c] for c in ("words", "chars") for x in (a, b))
    shared = F.size(F.array_intersect(aw, bw))
    whole = F.size(aw) + F.size(bw) - shared
    both = F.slice(F.sort_array(F.array_union(ac, bc)), 1, ENOUGH)
    alike = F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(both, ac), bc)) / F.size(both))
    rest = F.greatest(F.lit(0), F.lit(ENOUGH) - whole)
    return F.when(rest == 0, shared / whole).otherwise((shared + rest * alike) / (whole + rest)).cast("double")


def next_ids(docs: DataFrame) -> DataFrame:
    """Each distinct doc_id (``id``) with the next in descending order; the first after the last.

    Ids alone are range-partitioned and kept in the shared folder; within a partition a window
    finds the neighbour, and a row a partition joins the edges. No task sees all ids. A null id
    is NO_ID, the last.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id")).distinct()
    ids = materialize(ids.repartitionByRange(parts, F.col("id").desc()).withColumn("part", F.spark_partition_id()))
    order = F.col("id").desc()
    w = W.Window.partitionBy("part").orderBy(order)
    near = ids.withColumns({"next": F.lead(F.struct("id")).over(w), "turn": F.row_number().over(w)})
    # One row a partition: the first id of the next partition that has rows.
    heads = near.filter("turn = 1").select("part", F.struct("id").alias("head"))
    round_ = W.Window.orderBy("part")
    heads = heads.withColumn("after", F.coalesce(F.lead("head").over(round_), F.first("head").over(round_.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing))))
    found = near.join(F.broadcast(heads.select("part", "after")), "part")  # as many rows as shuffle partitions
    return found.select("id", F.coalesce("next", "after")["id"].alias("next_id"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next and same_place, the number of anchors that text and edited text have at one place.
    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document in descending doc_id, the first after the last. A null text is an
    empty one, and the fingerprint of a text without words is empty. Of rows that share a doc_id,
    each is returned, and the smallest text stands as next document. A null doc_id counts as the
    lowest; what stands for such rows is found by partial aggregation, and for other rows that
    share an id in one window, which spills. They are joined by a merge that AQE splits. One
    document alone follows itself. An empty table gives no rows; further columns are ignored.
    """
    # Both sides of the last join start from the same shuffle of texts by id, which Spark makes
    # once. What travels besides is the part of a text that its predecessor needs, and its hashes.
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    needs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.floor(F.coalesce(F.char_length("text"), F.lit(0)) / 2).alias("need")).groupBy("id").agg(F.max("need").cast("int").alias("need"))
    after = materialize(needs.join(next_ids(docs), "id").select(F.col("id").alias("to"), F.col("next_id").alias("key"), "need"))
    known, without = texts.filter(F.col("key") != NO_ID), texts.filter(F.col("key") == NO_ID)
    # Counted, not ranked: a rank with a limit would be applied before the shuffle and forbid its reuse.
    turn = F.count(F.lit(1)).over(W.Window.partitionBy("key").orderBy("text").rowsBetween(W.Window.unboundedPreceding, 0))
    firsts = known.withColumn("turn", turn).filter("turn = 1").drop("turn").join(after.filter(F.col("to") != NO_ID), "key")
    least = without.groupBy("key").agg(F.min("text").alias("text")).join(after, "key")
    carried = ["to", F.substring("text", F.lit(1), F.col("need")).alias("part"), F.struct("f.words", "f.chars").alias("next")]
    sent = with_fingerprint(firsts.unionByName(least), "text", "f").select(*carried)
    # What rows without an id need is one row, and goes to them.
    one = texts.join(F.broadcast(after.filter(F.col("to") == NO_ID)), "key").groupBy("key", "to", "need").agg(F.min("text").alias("text"))
    lone = without.join(F.broadcast(with_fingerprint(one, "text", "f").select(*carried)), F.col("key") == F.col("to"))
    both = known.join(sent, known["key"] == sent["to"]).unionByName(lone)
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("part", F.lit(1), half))
    both = both.select("key", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "next")
    both = with_fingerprint(with_fingerprint(both, "text", "own"), "edited", "other")
    return both.select(
        F.nullif("key", F.lit(NO_ID)).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "next").alias("near_next"),
        F.size(F.array_intersect(_placed("own"), _placed("other"))).cast("long").alias("same_place"),
    )
