"""Writing levels of cells: chunked, sorted by id, restartable chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import parent
from .shared import materialize


#: A task writes the cells of one cell so many levels up, about a million if it is dense.
TASK_LEVELS = 10


def chunk_column(level: int, chunk_level: int | None, cell: str = "cell_id"):
    return F.lit(0).cast("long") if chunk_level is None else F.expr(parent(cell, level - chunk_level))


def write_cells(df: DataFrame, path: str, level: int, chunk_level: int | None = None, shard_level: int | None = None, mode: str = "overwrite", cell: str = "cell_id") -> None:
    """Parquet under ``path``, a folder a chunk (or shard), rows in the order of ids.

    Only the chunks at hand are replaced, so jobs may each write some. Sorted ids keep the files'
    statistics tight, and delta encoding makes dense ids cost next to nothing. A folder of more than
    4^TASK_LEVELS cells is written by several tasks, each with cells side by side.
    """
    folder = shard_level if shard_level is not None else chunk_level
    out = df.withColumn("chunk_id", chunk_column(level, folder, cell))
    spread = out.repartition("chunk_id", F.expr(parent(cell, min(level - folder, TASK_LEVELS)))) if folder is not None else out.repartitionByRange(cell)
    (
        spread.sortWithinPartitions("chunk_id", cell).write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        .option("parquet.writer.version", "v2").partitionBy("chunk_id").parquet(path)
    )


def write_bucketed(df: DataFrame, table: str, level: int, chunk_level: int, buckets: int, cell: str = "cell_id") -> None:
    """A table bucketed by chunk: pyramids down to the chunk level then need no shuffle."""
    out = df.withColumn("chunk_id", chunk_column(level, chunk_level, cell))
    out.write.mode("overwrite").bucketBy(buckets, "chunk_id").sortBy("chunk_id", cell).saveAsTable(table)


def read_cells(spark: SparkSession, path: str, chunks: Iterable[int] | None = None) -> DataFrame:
    """A written level; ``chunks`` prunes folders."""
    spark.catalog.refreshByPath(path)
    df = spark.read.parquet(path)
    return df if chunks is None else df.filter(F.col("chunk_id").isin(list(chunks)))


def chunk_digests(cells: DataFrame, level: int, chunk_level: int | None, cell: str = "cell_id") -> DataFrame:
    """What is in each chunk, whatever the order of rows and columns: chunk_id, n, digest.

    The digest holds two sums of 64-bit hashes of rows, so rows that occur twice count twice. Names
    and types of columns take part, and so do nulls, which a hash of values alone passes over.
    """
    names = sorted(c for c in cells.columns if c != "chunk_id")
    schema = F.lit(",".join(f"{c}:{cells.schema[c].dataType.simpleString()}" for c in names))
    missing = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in names])
    values = [F.col(f"`{c}`") for c in names]
    total = lambda *xs: F.sum(F.xxhash64(*xs).cast("decimal(20,0)")).cast("string")
    keyed = cells.withColumn("chunk_id", chunk_column(level, chunk_level, cell))
    return keyed.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("/", total(schema, missing, *values), total(*values, missing, schema)).alias("digest"))


def chunk_changes(before: DataFrame, after: DataFrame, level: int, chunk_level: int | None, cell: str = "cell_id") -> DataFrame:
    """The chunks that differ: chunk_id, change (added, changed or gone), n_before, n_after.

    Each side is read once and summed up where it is read; a row a chunk is joined.
    """
    a = chunk_digests(before, level, chunk_level, cell).withColumnsRenamed({"n": "n_before", "digest": "__a"})
    b = chunk_digests(after, level, chunk_level, cell).withColumnsRenamed({"n": "n_after", "digest": "__b"})
    both = a.join(b, "chunk_id", "full").filter(~F.col("__a").eqNullSafe(F.col("__b")))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "gone").otherwise("changed")
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return both.select("chunk_id", change.alias("change"), zero("n_before"), zero("n_after"))


def update_cells(df: DataFrame, path: str, level: int, chunk_level: int | None, cell: str = "cell_id") -> DataFrame:
    """Bring a level written by ``write_cells`` up to ``df``: changed and new chunks are written, gone ones removed.

    Files of other chunks aren't touched. Returns the changes. A run that stops half-way is made good
    by the next, which compares with what is there then.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    there = files.exists(at) and any(s.getPath().getName().startswith("chunk_id=") for s in files.listStatus(at))
    before = read_cells(spark, path).drop("chunk_id") if there else df.limit(0)
    changes = materialize(chunk_changes(before, df, level, chunk_level, cell))
    todo = changes.filter("change <> 'gone'")
    if not todo.isEmpty():
        keyed = df.withColumn("__chunk", chunk_column(level, chunk_level, cell))
        write_cells(keyed.join(todo.select(F.col("chunk_id").alias("__chunk")), "__chunk", "left_semi").drop("__chunk"), path, level, chunk_level, cell=cell)
    for row in changes.filter("change = 'gone'").select("chunk_id").toLocalIterator():  # a folder each
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(at, f"chunk_id={row[0]}"), True)
    spark.catalog.refreshByPath(path)
    return changes
