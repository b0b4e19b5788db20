"""Quality rules by distribution divergence, with DataFrame functions only.

Base rules look at length and at words that repeat. The method compares two histograms of a
document, its character classes and its common words, with those of its language, by
Jensen-Shannon distance (base 2, 0 to 1). The references are sums over all documents of a
language that pass the base rules. A document is too short for a verdict below ``MIN_CHARS`` or
``MIN_WORDS``.

The limit of the word distance follows from the reference: ``WORD_SHARE`` of the distance that a
text without any common word has, and what a sample of n words adds by chance, about
``SAMPLING`` / n to its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words

MIN_WORDS_BASE = 20
WINDOW = 8
REPEAT_PERCENT = 30
#: Guards: histograms of fewer characters or words say too little, and are not judged.
MIN_CHARS = 400
MIN_WORDS = 60
#: Largest distances of a document that is kept (for words see above).
MAX_CHAR_DISTANCE = 0.30
WORD_SHARE, SAMPLING = 0.8, 2.5

# The most frequent function words of each language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er sie nach wie war bei aus".split(),
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou".split(),
}
VOCABULARY = sorted({w for ws in COMMON_WORDS.values() for w in ws})
# Character classes, each taken from what the ones before it leave.
CLASSES = ("[a-z]+", "[A-Z]+", r"[\x20\x09-\x0D]+", "[0-9]+", r"[.,;:!?'\"()-]+", r"\p{L}+", "[#*$%&|<>]+")


def _base(docs: DataFrame) -> DataFrame:
    """Adds words, their counts and the character histogram to doc_id, lang and text."""
    docs = docs.withColumn("words", words(F.col("text")))
    docs = docs.withColumn("r0", F.coalesce("text", F.lit("")))
    for i, one in enumerate(CLASSES):
        docs = docs.withColumn(f"r{i + 1}", F.regexp_replace(f"r{i}", one, ""))
    lengths = [F.char_length(f"r{i}") for i in range(len(CLASSES) + 1)]
    hist = F.array(*[(a - b).cast("double") for a, b in zip(lengths, lengths[1:])], lengths[-1].cast("double"))
    docs = docs.select("doc_id", "lang", "text", "words", F.char_length("r0").alias("n_all"), F.size("words").alias("n_words"), hist.alias("chars"))
    common = F.filter("words", lambda w: F.lower(w).isin(*VOCABULARY))
    docs = docs.withColumn("common", F.transform(common, lambda w: F.lower(w)))
    counted = F.transform(F.array_distinct("common"), lambda w: F.struct(w.alias("word"), (F.size("common") - F.size(F.array_remove("common", w))).cast("double").alias("n")))
    return docs.withColumns({"commons": counted, "n_common": F.size("common")})


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS_BASE) | (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words"))


def references(based: DataFrame) -> DataFrame:
    """One row a language of COMMON_WORDS, and one (lang null) of all: character shares, word shares.

    Sums over every document that has MIN_WORDS and passes the base rules; a row for each language
    and bin reaches the driver's broadcast, whatever the input.
    """
    judged = based.filter((F.col("n_words") >= MIN_WORDS) & ~_base_failed())
    bins = F.concat(
        F.transform("commons", lambda s: F.struct(F.concat(F.lit("w"), s["word"]).alias("bin"), s["n"].alias("n"))),
        F.array(F.struct(F.lit("w").alias("bin"), (F.col("n_words") - F.col("n_common")).cast("double").alias("n"))),
        F.transform("chars", lambda n, i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("bin"), n.alias("n"))),
    )
    sums = materialize(judged.select(F.nullif("ref", F.lit("*")).alias("ref"), F.inline(bins)).groupBy("ref", "bin").agg(F.sum("n").alias("n")))
    sums = sums.filter("ref is not null").unionByName(sums.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("ref", F.lit("*")))
    total = sums.groupBy("ref", F.substring("bin", 1, 1).alias("kind")).agg(F.sum("n").alias("total"))
    share = sums.withColumn("kind", F.substring("bin", 1, 1)).join(total, ["ref", "kind"]).select("ref", "kind", "bin", (F.col("n") / F.greatest("total", F.lit(1.0))).alias("q"))
    return share.groupBy("ref").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bin", "q")))).alias("shares"))


def _term(p: Column, q: Column) -> Column:
    """What a bin adds to the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def _distance(counts: Column, total: Column) -> Column:
    """From (bin, n) structs and the ``shares`` map. Bins that a document lacks add q / 2 bits."""
    total = F.greatest(total.cast("double"), F.lit(1.0))
    q = lambda s: F.coalesce(F.element_at("shares", s["bin"]), F.lit(0.0))
    summed = F.aggregate(counts, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("seen")), lambda acc, s: F.struct((acc["d"] + _term(s["n"] / total, q(s))).alias("d"), (acc["seen"] + q(s)).alias("seen")), lambda acc: acc["d"] + (F.lit(1.0) - acc["seen"]) / 2)
    return F.sqrt(F.greatest(summed, F.lit(0.0)))


def _repeats(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in WINDOW-word windows that the text holds twice or more."""
    docs = docs.withColumn("__h", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("__h")
    docs = docs.withColumn("__w", F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("__h", i + j) for j in range(WINDOW)]))))
    some = F.size("__w") > F.size(F.array_distinct("__w"))
    docs = docs.withColumn("__s", F.when(some, F.array_sort(F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda j, k: F.get("__s", j)["h"] == F.coalesce(F.get("__s", k)["h"], F.bitwise_not(F.get("__s", j)["h"]))
    at = F.filter(F.sequence(F.lit(0), F.size("__s") - 1), lambda j: same(j, j + 1) | (F.when(j > 0, same(j, j - 1)).otherwise(False)))
    docs = docs.withColumn("__p", F.when(F.col("__s").isNotNull(), F.sort_array(F.transform(at, lambda j: F.get("__s", j)["i"]))))
    steps = F.transform("__p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("__p", j + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)
    return docs.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("__h", "__w", "__s", "__p")


def measure(docs: DataFrame) -> DataFrame:
    """What the rules and the histograms need of each document, kept in the shared folder: texts
    are read once. Besides the counts, a row has at most a number for each bin."""
    based = _repeats(_base(docs.select("doc_id", "lang", "text")))
    based = based.withColumn("__l", F.filter(F.split("text", "\n", -1), lambda l: F.trim(l, F.lit(" \t\n\x0b\x0c\r")) != ""))
    return materialize(based.select(
        "doc_id", F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise("*").alias("ref"), "n_all", "n_words", "chars", "commons", "n_common", "n_repeat_words",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("__l") - F.size(F.array_distinct("__l"))), F.lit(0)).cast("long").alias("n_dup_lines"),
    ))


def judge_quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and char_distance, word_distance (null where the guards forbid a verdict).

    A null text has no words and fails the base rules, as does an empty one. A document whose
    lang is null or not in COMMON_WORDS is compared with all documents together. Rows that repeat
    are judged alike and all returned; an empty table gives no rows; columns besides doc_id, text
    and lang are ignored.
    """
    based = measure(docs)
    refs = references(based)
    joined = based.join(F.broadcast(refs), "ref", "left")  # a row a language of COMMON_WORDS, and one
    word_bins = F.concat(
        F.transform("commons", lambda s: F.struct(F.concat(F.lit("w"), s["word"]).alias("bin"), s["n"].alias("n"))),
        F.array(F.struct(F.lit("w").alias("bin"), (F.col("n_words") - F.col("n_common")).cast("double").alias("n"))),
    )
    char_bins = F.transform("chars", lambda n, i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("bin"), n.alias("n")))
    enough = (F.col("n_words") >= MIN_WORDS) & (F.col("n_all") >= MIN_CHARS)
    out = joined.withColumns({
        "char_distance": F.when(enough, _distance(char_bins, F.col("n_all"))),
        "word_distance": F.when(enough, _distance(word_bins, F.col("n_words"))),
        "n_symbols": F.element_at("chars", len(CLASSES)).cast("long"),
        "base_failed": _base_failed(),
    })
    rest = F.coalesce(F.element_at("shares", F.lit("w")), F.lit(0.0))  # the reference's share of words that aren't common
    none_common = _term(F.lit(1.0), rest) + (F.lit(1.0) - rest) / 2
    word_limit = F.sqrt(F.lit(WORD_SHARE**2) * none_common + F.lit(SAMPLING) / F.col("n_words"))
    fine = F.coalesce(F.col("char_distance") <= MAX_CHAR_DISTANCE, F.lit(True)) & F.coalesce(F.col("word_distance") <= word_limit, F.lit(True))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fine).alias("kept"), "char_distance", "word_distance")
