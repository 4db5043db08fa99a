"""Text chunks: reports, research files, company profiles and research metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.codes import file_metadata, normalize_code
from ..functions.text import chunks, normalize_text, text_or_empty

CHUNK_COLUMNS = ("source_type", "title", "stock_code", "stock_name", "report_period", "file_path")


def explode_chunks(docs: DataFrame, text: str = "text", size: int = 500, overlap: int = 80) -> DataFrame:
    """One row per chunk, with ``chunk_index`` from 0; blank texts give no rows.  Map-side only."""
    rest = [c for c in docs.columns if c != text]
    clean = docs.withColumn("_clean", normalize_text(F.col(text)))
    return clean.select(*rest, F.posexplode(chunks(F.col("_clean"), size, overlap)).alias("chunk_index", "text"))


def scan_reports(files: DataFrame, limit: int = fv.REPORT_SIZE_LIMIT) -> DataFrame:
    """path, length, text -> one row per report with its metadata; oversized files keep only
    their stem as text and are marked not readable."""
    stem = F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    readable = F.col("length") <= limit
    rows = files.select("path", stem.alias("stem"), readable.alias("readable"), F.when(readable, F.col("text")).otherwise(stem).alias("text"))
    meta = rows.withColumn("m", file_metadata(F.col("stem"), F.col("text")))
    return meta.select(
        F.col("path").alias("file_path"), "stem", "text",
        (F.col("readable") & (F.col("text") != F.col("stem"))).alias("readable"),
        "m.title", normalize_code(F.col("m.stock_code")).alias("stock_code"), "m.stock_name", "m.report_period", "m.report_date",
    )


def fill_template(template: str, columns) -> Column:
    """Text with ``{column}`` replaced by the column's value."""
    return reduce(
        lambda t, c: F.replace(t, F.lit("{" + c + "}"), text_or_empty(F.col(c))),
        [c for c in columns if "{" + c + "}" in template],
        F.lit(template),
    )


def _chunk_rows(df: DataFrame, source_type: str, title: str, code: Column, name: Column, sentence: str) -> DataFrame:
    rows = df.select(
        F.lit(source_type).alias("source_type"), text_or_empty(F.col(title)).alias("title"),
        code.alias("stock_code"), name.alias("stock_name"), F.lit("").alias("report_period"), F.lit("").alias("file_path"),
        fill_template(sentence, df.columns).alias("text"),
    )
    return explode_chunks(rows)


def profile_chunks(companies: DataFrame, sentence: str = fv.PROFILE_SENTENCE) -> DataFrame:
    return _chunk_rows(companies, "company_profile", "stock_abbr", F.col("stock_code"), F.col("stock_abbr"), sentence)


def research_meta_chunks(stock: DataFrame, industry: DataFrame, stock_sentence: str = fv.STOCK_META_SENTENCE,
                         industry_sentence: str = fv.INDUSTRY_META_SENTENCE) -> DataFrame:
    blank = F.lit("")
    a = _chunk_rows(stock, "stock_research_meta", "title", F.col("stockCode"), F.col("stockName"), stock_sentence)
    b = _chunk_rows(industry, "industry_research_meta", "title", blank, blank, industry_sentence)
    return a.unionByName(b)


def report_chunks(reports: DataFrame, source_type: str = "financial_report_pdf") -> DataFrame:
    rows = reports.select(
        F.lit(source_type).alias("source_type") if "source_type" not in reports.columns else "source_type",
        "title", "stock_code", F.col("stock_abbr" if "stock_abbr" in reports.columns else "stock_name").alias("stock_name"),
        "report_period", "file_path", "text",
    )
    return explode_chunks(rows)
