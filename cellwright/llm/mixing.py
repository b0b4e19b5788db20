"""Mixing sources to target weights by systematic sampling.

Each document of a source is worth ``target / source size`` expected copies. Documents are
ranked within their source, the prefix sum of the expected copies is shifted by one random
offset per source, and a copy is emitted for each integer that the sum crosses. Ranking runs
from small to large documents, so the copies are spread evenly over all sizes and a source's
words come near its target even where sizes differ by orders of magnitude.

The order within a size step is that of a hash of id and text. The prefix sums are distributed: a
source is cut into ordered groups, a range of that hash in a size step, as many ranges as leave
about ``GROUP`` rows to a group; ranks are counted within a group, and only the groups' counts are
summed along a source. Documents that are equal in id, source and text are one row with a count
until the end. So a source, an id or a text that a third of all rows share is spread as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialize, words

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
#: Steps to a doubling of size (2^STEP_BITS, each about 9 % wide), and rows that a group may have.
STEP_BITS = 3
GROUP = 1 << 16
SEED = 7


def hashed(key: Column) -> Column:
    """48 bits of a key's MD5, as a number."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=TOTAL_SHARE, most=MOST_COPIES) -> DataFrame:
    """``(source, size)`` rows to one row a source: source_size, target.

    Sources by code point (null last) take the weights in turn. Targets are the water level of
    ``min(level * weight, most * source size)`` that uses up ``share`` of all words: that is
    where resharing the excess of full sources by weight comes to rest. Sources without words
    have target 0. One row a source from here on; no documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", turn).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = W.Window.partitionBy()
    full_first = W.Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full_first.rowsBetween(W.Window.unboundedPreceding, -1)
    after = full_first.rowsBetween(0, W.Window.unboundedFollowing)
    per = per.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # Sources whose cap lies above their level are not full; the level of the first of them holds.
    open_level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return per.withColumn("open_level", open_level).select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("open_level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share=TOTAL_SHARE, most=MOST_COPIES, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """``documents`` to one row a document: doc_id, source, size, source_size, target, copies, and
    text_key, turn (a number of the row among those equal in doc_id, source and text).

    size is the number of words (null text: 0). copies is 0 to ``most``. Documents without
    words take part with the same expected copies and add no words. Null sources form a source
    of their own, a null doc_id counts as a document, rows that repeat are documents of their
    own (which of two equal rows is taken makes no difference), an empty table gives no rows;
    further columns are ignored. Reruns agree, whatever the files and groups: rank and offset
    come from hashes of the seed.
    """
    # A source as a key that isn't null, so that window and join below share one shuffle.
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), text_key(F.col("text")).alias("text_key"))
    sized = materialize(sized.groupBy("doc_id", "source", "size", "text_key").agg(F.count(F.lit(1)).alias("n")).withColumn("s", named))
    slot_bits = min(40, (sized.count() // group).bit_length())
    targets = source_targets(sized.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
    h = hashed(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text_key")))
    width = F.length(F.bin(F.greatest(F.col("size"), F.lit(1)))) - 1  # whole part of the binary logarithm
    sized = sized.withColumns({
        "h": h,
        "step": F.expr(f"(size << {STEP_BITS}) >> (length(bin(greatest(size, 1))) - 1)").bitwiseAND(F.lit((1 << STEP_BITS) - 1)).cast("int") + width * (1 << STEP_BITS),
        "slot": F.shiftright(h, 48 - slot_bits),
    })
    keys = ["s", "step", "slot"]
    before = W.Window.partitionBy("s").orderBy("step", "slot").rowsBetween(W.Window.unboundedPreceding, -1)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = hashed(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("source"), F.lit("")))) / F.lit(float(1 << 48))
    targets = targets.select(named.alias("s"), "source_size", "target", rate.alias("rate"), u.alias("u"))
    offsets = sized.groupBy(*keys).agg(F.sum("n").alias("m")).withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m").join(targets, "s")
    up_to = W.Window.partitionBy(*keys).orderBy("h", "doc_id", "text_key").rowsBetween(W.Window.unboundedPreceding, 0)
    ranked = sized.withColumn("first", F.sum("n").over(up_to) - F.col("n")).join(offsets, keys)
    # Equal rows apart again, in two steps, so that no array is long.
    ranked = ranked.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 4096))))
    ranked = ranked.withColumn("turn", F.explode(F.sequence(F.col("k") * 4096 + 1, F.least(F.col("n"), F.col("k") * 4096 + 4096))))
    at = F.col("offset") + F.col("first") + F.col("turn")
    crossed = F.floor(at * F.col("rate") + F.col("u")) - F.floor((at - 1) * F.col("rate") + F.col("u"))
    return ranked.select("doc_id", "source", "size", "source_size", "target", F.least(F.lit(most), crossed).cast("int").alias("copies"), "text_key", "turn")


def emit_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as ``mixed`` says, with all its own columns.

    Copies go back to documents by doc_id, source and text. Rows equal in all three (they may
    differ in other columns) are numbered in a window of their own, which spills.
    """
    same = W.Window.partitionBy("doc_id", "source", "__text").orderBy(F.lit(0))
    mine = docs.withColumn("__text", text_key(F.col("text"))).withColumn("__turn", F.row_number().over(same).cast("long"))
    theirs = mixed.filter("copies > 0").select(*[F.col(c).alias(k) for k, c in (("__id", "doc_id"), ("__source", "source"), ("__key", "text_key"), ("__row", "turn"), ("__copies", "copies"))])
    both = mine.join(theirs, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__text") == F.col("__key")) & (F.col("__turn") == F.col("__row")))
    return both.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
