"""What the operators share: session settings, tables written between steps, row keys, parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder, tune

BATCH_ROWS = 1000  # rows per Arrow batch: texts are long
TOKENIZER_FILE = "byte_bpe_50k.json"


def prepare(spark: SparkSession) -> SparkSession:
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def stored(df: DataFrame, **options) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lost executors lose nothing,
    later steps read only the columns they need, and the planner knows the size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("llm-"):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches, column: str = "text", limit: int = 4 << 20):
    """Parts of Arrow batches with at most ``limit`` bytes of ``column`` (or one row)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
            yield batch.slice(a, b - a)
            a = b


def texts(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator uses, under its own names; a null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever they are called."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def schema_of(df: DataFrame, names, more: str) -> T.StructType:
    """Columns of ``df`` and then those of the DDL string ``more``; not written as text, so nested names may be any."""
    return T.StructType([df.schema[n] for n in names] + T.StructType.fromDDL(more).fields)


def crc_bucket(id_col: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % buckets


def running_start(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before this one in ``order``.

    The rows (narrow ones, please) are range-sorted and written once, so that sampled bounds stay fixed;
    each range is summed by itself and starts at the total of the ranges before it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_spot"))
    )
    # one row per range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skips = placed.groupBy("_part").agg(F.sum(value).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"))
    inside = Window.partitionBy("_part").orderBy("_spot").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(skips), "_part")
        .withColumn(name, (F.col("_before") + F.col("_skip")).cast("long"))
        .drop("_part", "_spot", "_before", "_skip")
    )
