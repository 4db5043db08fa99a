"""Token ids as Parquet lists that can be read selectively."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import default_tokenizer, schema_of, slices, stored, texts
from .encoding import shared_encoder

ROW_GROUP = 32 << 20  # bytes
PAGE = 256 << 10  # bytes; the page index lets a reader skip pages
PAGE_ROWS = 512


def write_options(row_group: int = ROW_GROUP, page: int = PAGE, page_rows: int = PAGE_ROWS, delta: bool = False) -> dict:
    """Parquet settings: dictionary-encoded ids, or with ``delta`` version-2 pages with delta encoding."""
    return {
        "parquet.block.size": str(row_group), "parquet.page.size": str(page), "parquet.page.row.count.limit": str(page_rows),
        "parquet.enable.dictionary": str(not delta).lower(), "parquet.writer.version": "PARQUET_2_0" if delta else "PARQUET_1_0",
        "compression": "zstd",
    }


def write_tokens(df: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", **layout) -> DataFrame:
    """Writes one row per text, ascending by id, and returns the rows read back: doc_id, n_tokens, ids.

    ``ids`` are the tokenizer's ids of the whole text with ``end_id`` behind them.  Files are range-sorted
    by id (nulls first; equal ids by the text), with row groups of bounded size and page indexes, so a reader
    of some ids, or of the narrow columns, reads only their pages.  Empty and null texts are the end id
    alone; repeated rows are kept; other columns are ignored.  Without ``path`` the shared folder is used.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast({"path": tokenizer or default_tokenizer()})
    rows = texts(df, id_col, text_col)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # texts move once, before they are encoded; encoding runs once, on the way into the files
    placed = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encoded(batches):
        import numpy as np
        import pyarrow as pa

        encoder = shared_encoder(shared.value)
        for batch in slices(batches):
            ids, edges = encoder.encode(batch.column("text").to_pylist())
            ids = np.insert(ids, edges[1:], end_id)
            edges = edges + np.arange(len(edges))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(edges)), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))],
                names=["doc_id", "n_tokens", "ids"])

    table = placed.mapInArrow(encoded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>")
    options = write_options(**layout)
    if path is None:
        return stored(table, **options)
    table.write.options(**options).parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def token_index(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the rows of ``write_tokens``, from the files alone.

    ``start`` counts the ids of all rows before in the order of the files, also between rows of one id; the checksum
    covers the ids as little-endian unsigned 32-bit integers.  Files are read once and in place: a task counts along the
    stretch of a file that it reads, and the stretches, a row each, are added up by file name and place.
    """
    def summed(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        at, run, before = None, 0, 0
        for batch in batches:
            lists = batch.column("ids")
            edges, values = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(), "<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            size, firsts, starts = np.diff(edges), [], []
            for name, row, n in zip(batch.column("file_name").to_pylist(), batch.column("row_index").to_pylist(), size.tolist()):
                if at != (name, row):
                    run, before = row, 0
                firsts.append(run)
                starts.append(before)
                before += n
                at = (name, row + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), batch.column("file_name"), pa.array(firsts, pa.int64()), pa.array(starts, pa.int64())],
                names=["doc_id", "n_tokens", "ids_crc32", "file_name", "run", "before"])

    read = tokens.select("doc_id", "ids", "_metadata.file_name", "_metadata.row_index")
    narrow = stored(read.mapInArrow(summed, schema_of(read, ("doc_id",), "n_tokens long, ids_crc32 long, file_name string, run long, before long")))
    earlier = Window.orderBy("file_name", "run").rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
    runs = narrow.groupBy("file_name", "run").agg(F.sum("n_tokens").alias("n")).select(
        "file_name", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    return narrow.join(runs, ["file_name", "run"]).select("doc_id", (F.col("skip") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
