"""Reading and writing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..functions.codes import normalize_code
from ..functions.numbers import to_float
from ..functions.periods import period_key
from ..scale import global_row_number


def column_type(raw: str) -> str:
    """Spark type for a dictionary type, by prefix."""
    lowered = (raw or "").lower()
    return next((t for prefix, t in fv.TYPE_PREFIXES if lowered.startswith(prefix)), "string")


def statement_schema(table: str, dictionary) -> T.StructType:
    """Schema of a statement table from dictionary rows (field, type).

    Blank fields are skipped; common columns lead when the dictionary lacks them; extra columns
    and any catalog column named by the dictionary follow.
    """
    listed = [(f.strip(), column_type(t)) for f, t in dictionary if f and f.strip()]
    names = {f for f, _ in listed}
    columns = [c for c in fv.COMMON_COLUMNS if c[0] not in names] + listed
    columns += [c for c in fv.EXTRA_COLUMNS.get(table, ()) if c[0] not in {n for n, _ in columns}]
    return T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in dict(columns).items()))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in its order; missing ones NULL, blank numbers NULL."""
    def one(f: T.StructField):
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f.name)
        text = dict(df.dtypes)[f.name] == "string" and not isinstance(f.dataType, T.StringType)
        return (to_float(c) if text else c).try_cast(f.dataType).alias(f.name)

    return df.select(*[one(f) for f in schema.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; a byte-order mark before the first header is tolerated."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    filled = raw.na.fill("")
    return conform(filled, schema) if schema is not None else filled


def layered_csv(spark: SparkSession, folders, tables: dict[str, T.StructType], current: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables after loading CSV folders in order: a file replaces the table named like it.

    Unknown names are skipped and an empty file leaves the table as it was.
    """
    out = dict(current)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for folder in folders:
        root = hadoop(folder)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            continue
        for name in sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().endswith(".csv")):
            table = name[:-4]
            if table in tables:
                loaded = read_csv(spark, f"{folder.rstrip('/')}/{name}", tables[table])
                if not loaded.isEmpty():
                    out[table] = loaded
    return out


def load_companies(raw: DataFrame, headers=fv.COMPANY_HEADERS) -> DataFrame:
    """Company master under its column names, with normalised codes; missing headers blank."""
    pick = lambda src: F.coalesce(F.col(f"`{src}`").cast("string"), F.lit("")) if src in raw.columns else F.lit("")
    cols = [(normalize_code(pick(src)) if name == "stock_code" else pick(src)).alias(name) for src, name in headers]
    return raw.select(*cols).withColumn("serial_number", F.col("serial_number").try_cast("bigint"))


def load_research(raw: DataFrame | None, schema: T.StructType, spark: SparkSession) -> DataFrame:
    """Research metadata as text columns, codes normalised; no source gives an empty table."""
    if raw is None:
        return spark.createDataFrame([], schema)
    out = raw.withColumn("stockCode", normalize_code(F.col("stockCode"))) if "stockCode" in raw.columns else raw
    return replace_rows(conform(out, schema))


def replace_rows(df: DataFrame) -> DataFrame:
    """Text cells that are absent become empty text, as a whole-table load stores them."""
    return df.na.fill("", [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])


def union_by_first(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack tables on the columns of the first; absent cells become empty text."""
    same = [o.select(*[c for c in o.columns if c in first.columns]) for o in others]
    return replace_rows(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same, first))


def statement_table(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Statement rows as they are stored: numbered by company and period, in schema order."""
    key = period_key(F.col("report_period"))
    sortable = rows.withColumn("_y", key["year"]).withColumn("_o", key["ord"])
    numbered = global_row_number(sortable, ["stock_code", "_y", "_o", "report_period"], "_n")
    own = F.col("serial_number") if "serial_number" in rows.columns else F.lit(None)
    out = numbered.withColumn("serial_number", F.coalesce(own.cast("bigint"), F.col("_n")))
    return conform(out.drop("_y", "_o", "_n"), schema)


def write_table(df: DataFrame, path: str, partition_by=()) -> None:
    """Overwrite a table; with partitions only the ones present in ``df`` are replaced."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def table_listing(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    widths = F.create_map(*[x for t, df in tables.items() for x in (F.lit(t), F.lit(len(df.columns)))])
    return row_counts(tables).withColumn("column_count", widths[F.col("table_name")]).orderBy("table_name")


def preview(df: DataFrame, order, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of a table as text; NULL shows as empty.  Page size is held to 5..100."""
    size = max(5, min(100, page_size))
    start = (max(1, page) - 1) * size
    return df.orderBy(*order).offset(start).limit(size).select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    )


def reference_matches(requests: DataFrame, chunks: DataFrame, limit: int = 12) -> DataFrame:
    """Chunks a reference points to: equal path or title, else names that contain it.

    Requests: request_id, reference.  Exact hits are an equi-join; only the remainder is searched
    by containment, and each distinct reference once.
    """
    from ..operators.matching import contains_match
    from ..scale import top_per

    wanted = requests.select(F.col("reference").alias("_ref")).distinct()
    exact = chunks.select("chunk_id", F.explode(F.array_distinct(F.array("file_path", "title"))).alias("_ref")).join(wanted, "_ref")
    exact = exact.select("_ref", "chunk_id").distinct()
    rest = wanted.join(exact, "_ref", "left_anti").filter(F.col("_ref") != "")
    names = chunks.select("chunk_id", F.concat_ws("\n", "file_path", "title").alias("_name"))
    # many chunks share a document: search each distinct name once
    distinct = names.select("_name").distinct()
    near = contains_match(distinct, ["_name"], "_name", rest, "_ref").join(names, "_name").select("_ref", "chunk_id")
    found = exact.withColumn("match", F.lit("exact")).unionByName(near.withColumn("match", F.lit("contains")))
    top = top_per(found, ["_ref"], ["chunk_id"], limit, rank="position")
    return requests.join(top, requests["reference"] == top["_ref"]).drop("_ref")
