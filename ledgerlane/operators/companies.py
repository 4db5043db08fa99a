"""Company master data: merging, alignment and aliases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import normalize_code
from ..functions.text import text_or_empty


def _filled(c: str) -> Column:
    return F.nullif(F.trim(text_or_empty(F.col(c))), F.lit(""))


def attach_company(docs: DataFrame, companies: DataFrame, code: str = "stock_code", name: str = "stock_name") -> DataFrame:
    """Company of a document by code, else by abbreviation or full name.

    Both lookups are equi-joins on keys that are unique on the company side.
    """
    by_code = companies.groupBy(F.col("stock_code").alias(code)).agg(F.max("stock_abbr").alias("_abbr"))
    names = companies.select("stock_code", "stock_abbr", F.explode(F.array("stock_abbr", "company_name")).alias(name))
    by_name = names.filter(F.col(name) != "").groupBy(name).agg(
        F.max_by(F.struct("stock_code", "stock_abbr"), "stock_code").alias("_named")
    )
    out = docs.join(by_code, code, "left").join(by_name, name, "left")
    rest = [c for c in docs.columns if c not in (code, name)]
    hit = F.col("_abbr").isNotNull()
    return out.select(
        *rest, name,
        normalize_code(F.when(hit, F.col(code)).otherwise(F.coalesce("_named.stock_code", F.col(code)))).alias(code),
        F.coalesce("_abbr", "_named.stock_abbr", name).alias("stock_abbr"),
    )


def missing_in_master(statements: DataFrame, master: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Statement companies absent from the master, and whether the alias table covers them."""
    seen = statements.filter(F.col("stock_code") != "").select("table_name", "stock_code", "stock_abbr").distinct()
    missing = seen.join(master.select("stock_code").distinct(), "stock_code", "left_anti")
    if aliases is None:
        blank = F.lit("")
        return missing.select("*", F.lit("missing_master_data").alias("status"), blank.alias("alias_source_table"), blank.alias("alias_source"))
    known = aliases.groupBy("stock_code").agg(
        F.max_by(F.struct("source_table", "source"), "source_table").alias("_alias")
    )
    return missing.join(known, "stock_code", "left").select(
        "table_name", "stock_code", "stock_abbr",
        F.when(F.col("_alias").isNotNull(), "covered_by_alias_table").otherwise("missing_master_data").alias("status"),
        F.coalesce("_alias.source_table", F.lit("")).alias("alias_source_table"),
        F.coalesce("_alias.source", F.lit("")).alias("alias_source"),
    )


def rebuild_aliases(statements: DataFrame, master: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One alias row per unknown company and table; the name comes from texts when they have one."""
    seen = statements.filter(F.trim("stock_code") != "").groupBy("table_name", F.trim("stock_code").alias("stock_code")).agg(
        F.max(_filled("stock_abbr")).alias("abbr")
    )
    unknown = seen.join(master.select("stock_code").distinct(), "stock_code", "left_anti")
    if chunks is not None:
        named = chunks.filter((F.trim("stock_code") != "") & (F.trim("stock_name") != "")).groupBy(
            F.trim("stock_code").alias("stock_code")
        ).agg(F.min(F.trim("stock_name")).alias("named"))
        unknown = unknown.join(named, "stock_code", "left")
    else:
        unknown = unknown.withColumn("named", F.lit(None).cast("string"))
    abbr = F.coalesce("abbr", "named")
    return unknown.select(
        "stock_code",
        F.coalesce(abbr, F.lit("")).alias("stock_abbr"),
        F.coalesce(F.col("named"), abbr, F.col("stock_code")).alias("company_name"),
        F.col("table_name").alias("source_table"),
        F.lit("inferred_from_financial_tables").alias("source"),
    )


def alias_statistics(aliases: DataFrame) -> DataFrame:
    return aliases.agg(
        F.count(F.lit(1)).alias("alias_count"), F.countDistinct("stock_code").alias("missing_company_info_count")
    )


def merge_companies(sources: list[DataFrame], attributes=("stock_abbr", "company_name")) -> DataFrame:
    """One row per company over several lists; each attribute from the first list that has it.

    The first non-empty value is a plain aggregate (minimum by source rank), so a company that
    holds most rows is reduced before the shuffle.
    """
    def ranked(rank: int, df: DataFrame) -> DataFrame:
        code = normalize_code(F.col("stock_code"))
        cols = [(_filled(a) if a in df.columns else F.lit(None).cast("string")).alias(a) for a in attributes]
        key = F.coalesce(F.nullif(code, F.lit("")), *[_filled(a) for a in attributes[:2] if a in df.columns])
        return df.select(key.alias("company_key"), code.alias("stock_code"), F.lit(rank).alias("_rank"), *cols)

    rows = reduce(DataFrame.unionByName, [ranked(i, df) for i, df in enumerate(sources)])
    first = lambda a: F.min(F.when(F.col(a).isNotNull(), F.struct("_rank", a)))[a].alias(a)
    return (
        rows.filter(F.col("company_key").isNotNull())
        .groupBy("company_key")
        .agg(F.max("stock_code").alias("stock_code"), F.min("_rank").alias("source_rank"), *[first(a) for a in attributes])
        .withColumn("company_name", F.coalesce("company_name", "stock_abbr"))
    )


def company_label(rows: DataFrame, companies: DataFrame, fallback: str = "stock_abbr", name: str = "label") -> DataFrame:
    """Display name: company abbreviation, else full name, else the given text, else the code."""
    known = companies.groupBy("stock_code").agg(
        F.max(F.coalesce(_filled("stock_abbr"), _filled("company_name"))).alias("_label")
    )
    return rows.join(known, "stock_code", "left").withColumn(
        name, F.coalesce("_label", _filled(fallback), F.col("stock_code"))
    ).drop("_label")


def route_research(files: DataFrame, stock_meta: DataFrame, industry_meta: DataFrame) -> DataFrame:
    """Source type of research files by title: stock reports first, then industry reports."""
    stock = stock_meta.groupBy("title").agg(
        F.max_by(F.struct(normalize_code(F.col("stockCode")).alias("code"), F.col("stockName").alias("name")), "stockCode").alias("_stock")
    )
    industry = industry_meta.select("title").distinct().withColumn("_industry", F.lit(True))
    kind = (
        F.when(F.col("_stock").isNotNull(), "stock_research_pdf")
        .when(F.col("_industry"), "industry_research_pdf")
        .otherwise("research_pdf")
    )
    return (
        files.join(stock, "title", "left").join(industry, "title", "left")
        .withColumn("source_type", kind)
        .withColumn("stock_code", F.coalesce("_stock.code", F.lit("")))
        .withColumn("stock_name", F.coalesce("_stock.name", F.col("stock_name") if "stock_name" in files.columns else F.lit("")))
        .drop("_stock", "_industry")
    )
