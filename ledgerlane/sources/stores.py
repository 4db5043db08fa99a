"""Stored tables whose loads replace the part they cover.

A store holds many tables under one path, in a folder per table and report year.  A load names its tables, and its
years if it is partial; what the store held of those is replaced, also where the load brings no row, and the rest stays
as it is.  Readers that name tables and years open those folders only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import conform, statement_table

PART_TABLE, PART_YEAR = "part_table", "part_year"
NO_YEAR = "none"  # folder of periods without a year


def _year(period: str = "report_period") -> Column:
    found = F.regexp_extract(F.coalesce(F.col(period), F.lit("")), "^([0-9]{4})", 1)
    return F.when(found == "", NO_YEAR).otherwise(found)


def _folders(spark: SparkSession, path: str, tables, years) -> dict[str, set[str]]:
    """Names of the data files in each folder of the named tables and years (a folder a year, so the list is short)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    out: dict[str, set[str]] = {}
    for table in tables:
        top = hadoop(path, f"{PART_TABLE}={table}")
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            continue
        for status in fs.listStatus(top):
            at = status.getPath()
            if status.isDirectory() and (years is None or at.getName().split("=", 1)[-1] in years):
                out[at.toString()] = {f.getPath().getName() for f in fs.listStatus(at)}
    return out


def replace_parts(df: DataFrame, path: str, tables, years=None, table: Column | None = None) -> None:
    """Write ``df`` as the new content of ``tables`` (of ``years`` only, if given) in the store at ``path``.

    ``df`` has report_period, and table_name unless ``table`` says which table a row belongs to.  Rows of other tables or
    years are not part of the load.  Table names are plain identifiers; years are text.  ``df`` may itself read the store:
    new files are in place before old ones go.
    """
    spark = df.sparkSession
    tables, years = list(tables), None if years is None else {str(y) for y in years}
    rows = df.withColumn(PART_TABLE, F.col("table_name") if table is None else table).withColumn(PART_YEAR, _year())
    rows = rows.filter(F.col(PART_TABLE).isin(tables))
    if years is not None:
        rows = rows.filter(F.col(PART_YEAR).isin(sorted(years)))
    before = _folders(spark, path, tables, years)
    # one task writes a few folders, not a file in each; a year that is too large is split by size at run time
    rows.hint("rebalance", PART_TABLE, PART_YEAR).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(PART_TABLE, PART_YEAR).parquet(path)
    after = _folders(spark, path, tables, years)
    for folder, files in before.items():
        if files & after.get(folder, set()):  # its files are the old ones: the load had no row for it
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_parts(spark: SparkSession, path: str, schema: T.StructType, tables, years=None) -> DataFrame:
    """Rows of ``tables`` (and ``years``) in the store, in the columns of ``schema``; a store without them gives no rows."""
    if not _folders(spark, path, tables, None if years is None else {str(y) for y in years}):
        return spark.createDataFrame([], schema)
    parts = T.StructType([T.StructField(PART_TABLE, T.StringType()), T.StructField(PART_YEAR, T.StringType())])
    rows = spark.read.schema(T.StructType(schema.fields + parts.fields)).parquet(path).filter(F.col(PART_TABLE).isin(list(tables)))
    if years is not None:
        rows = rows.filter(F.col(PART_YEAR).isin([str(y) for y in years]))
    return rows.drop(PART_TABLE, PART_YEAR)


def write_statements(rows: DataFrame, schema: T.StructType, path: str, table: str, years=None) -> None:
    """Replace a statement table, or some of its years.  Serial numbers that rows lack are given on reading, since a new
    year in the middle moves those after it."""
    replace_parts(conform(rows, schema), path, [table], years, table=F.lit(table))


def read_statements(spark: SparkSession, path: str, schema: T.StructType, table: str, years=None) -> DataFrame:
    """The stored statement table, numbered over all its years by company and period; ``years`` picks rows after that."""
    rows = statement_table(read_parts(spark, path, schema, [table]), schema)
    return rows if years is None else rows.filter(_year().isin([str(y) for y in years]))


def write_lineage(rows: DataFrame, path: str, tables) -> None:
    """Replace the lineage of ``tables``: theirs goes also where ``rows`` has none, that of other tables stays."""
    replace_parts(rows, path, tables)
