"""Line dedup: cross-site boilerplate, found by the number of distinct sites of each line.

A line is a ``\\n``-separated piece of a text with a character that isn't ASCII white space,
compared without white space around it. Its key is a 96-bit hash. Each line's sites go into a
HyperLogLog sketch that Spark merges by aggregation, so no task holds the sites of a line, hot
lines included. The sketch decides where its error band lies clear of the threshold; lines
within the band get an exact count of distinct sites.

A line on ``min_sites`` sites or more is boilerplate. Its first occurrence (lowest doc_id, then
position) stays and all others go, so nothing the corpus says is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Sites on which a line counts as boilerplate.
MIN_SITES = 6
#: log2 of the sketch's registers: a relative standard error of 1.04 / sqrt(2^LG_K), 1.6 %.
LG_K = 12
#: Standard errors on either side of the threshold within which sites are counted exactly.
BAND = 4.0

KEY = ["h1", "h2"]
#: Stands for a null doc_id, so that it is the first of all.
NO_ID = -(1 << 63)


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\n\x0b\x0c\r"))


def _row(docs: DataFrame) -> list[Column]:
    """What tells rows apart: the doc_id and a hash of the text, so that rows without an id, or with
    one that many share, don't meet under one key."""
    return [F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("text_hash")]


def text_lines(docs: DataFrame) -> DataFrame:
    """One row a line that is not blank: doc, text_hash, site (a hash of source), pos, h1, h2."""
    lines = docs.select(*_row(docs), F.xxhash64(F.coalesce("source", F.lit("\0"))).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    trimmed = lines.select("doc", "text_hash", "site", "pos", _trimmed(F.col("line")).alias("line")).filter(F.col("line") != "")
    return trimmed.select("doc", "text_hash", "site", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def line_spread(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """Boilerplate lines: h1, h2, n_sites (sketched or exact), exact, and the first occurrence,
    a struct of doc and pos.

    Sketches are merged in each task before the shuffle, and so are the sites of the lines that
    are counted exactly: a hot line sends a row for each task, or for each site and task.
    """
    error = band * 1.04 / 2 ** (lg_k / 2)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    sketch = F.hll_sketch_agg("site", F.lit(lg_k))
    spread = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "pos")).alias("first"), F.hll_sketch_estimate(sketch).alias("estimate"))
    spread = materialize(spread.filter((F.col("n") >= min_sites) & (F.col("estimate") >= low)).select(*KEY, "first", "estimate"))
    near = spread.filter(F.col("estimate") <= high)
    counted = lines.select(*KEY, "site").distinct().join(near, KEY).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_sites"), F.first("first").alias("first"))
    return (
        spread.filter(F.col("estimate") > high).select(*KEY, "first", F.col("estimate").alias("n_sites"), F.lit(False).alias("exact"))
        .unionByName(counted.filter(F.col("n_sites") >= min_sites).select(*KEY, "first", "n_sites", F.lit(True).alias("exact")))
    )


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """``docs`` with ``text`` rid of boilerplate lines, and n_lines, n_removed (int) added.

    A null text stays null, an empty one empty, neither with lines. A null source is a site of
    its own. A null doc_id comes before all others when the first occurrence is sought. Rows
    that share a doc_id are treated alike: a first occurrence in one of them is one in the rows
    that have the same line at the same position. White space lines and the order of what stays
    are kept. An empty table gives an empty one. All other columns are kept; n_lines and
    n_removed replace columns of those names.
    """
    lines = text_lines(docs)
    over = line_spread(lines, min_sites, lg_k, band)
    hits = lines.select("doc", "text_hash", "pos", *KEY).join(over.select(*KEY, "first"), KEY)
    hits = hits.filter((F.col("doc") != F.col("first.doc")) | (F.col("pos") != F.col("first.pos")))
    # Places in one text, whose lines are one row's: equal rows have equal places.
    gone = hits.groupBy(F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash")).agg(F.collect_set("pos").alias("__gone"))
    doc, text_hash = _row(docs)
    joined = docs.join(gone, (doc == F.col("__doc")) & (text_hash == F.col("__hash")), "left")
    joined = joined.withColumn("__lines", F.split("text", "\n", -1))
    # array_except looks places up by hash: linear in the lines of a text.
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.transform(stay, lambda p: F.get("__lines", p))
    worded = lambda a: F.coalesce(F.size(F.filter(a, lambda l: _trimmed(l) != "")), F.lit(0))
    some = F.col("__gone").isNotNull()
    new = {
        "text": F.when(some, F.array_join(kept, "\n")).otherwise(F.col("text")),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(worded("__lines")),
        "n_removed": F.when(some, F.size("__gone")).otherwise(0),
    }
    plain = [c for c in docs.columns if c not in new]
    return joined.select(*[new["text"].alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c in plain or c == "text"], new["n_lines"].alias("n_lines"), new["n_removed"].alias("n_removed"))
