"""Why a metric moved: conclusion from the facts, evidence from themes or retrieval, one row a request.

Requests: request_id, stock_code, stock_abbr, company_name, metric_key, metric_label, report_period
(NULL = latest annual, else latest).  Facts and chunks as elsewhere.  Each request meets its own
company's facts and its own company's chunks; texts are read and judged once for all companies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import numbers as N
from ..functions import text as T
from ..lexicon import DEFAULT, Lexicon
from ..session import checkpointed
from . import retrieval as R


def conclusion(growth: Column, growth_status: Column) -> Column:
    """Sentence on value and growth; empty where the value is missing or doubtful."""
    c = F.col
    value = N.format_metric(c("metric_value"), c("metric_key").isin(*fv.EPS_COLUMNS))
    said = F.format_string(fv.ATTRIBUTION_VALUE, "stock_abbr", "report_period", "metric_label", value)
    moved = F.concat(F.when(growth >= 0, fv.ATTRIBUTION_UP).otherwise(fv.ATTRIBUTION_DOWN), N.two_decimals(F.abs(growth)), F.lit("%"))
    tail = (
        F.when(growth.isNotNull(), moved)
        .when(growth_status == "not_applicable", fv.ATTRIBUTION_GROWTH + fv.GROWTH_NOT_APPLICABLE)
    )
    doubtful = N.is_suspicious(c("metric_value"), ~c("metric_key").isin(*fv.EPS_COLUMNS))
    return F.when(c("report_period").isNull() | doubtful, "").otherwise(F.concat(F.concat_ws("，", said, tail), F.lit("。")))


def company_themes(requests: DataFrame, chunks: DataFrame, themes=fv.THEMES, least_cjk: float = 0.2, longest: int | None = None) -> DataFrame:
    """stock_code, themes (array), references (array): the first sentence on each theme in the chunks of a company.

    A chunk is a company's by code, short or full name.  A company has at most a row per theme.
    """
    names = F.filter(F.array_distinct(F.array("stock_abbr", "company_name")), lambda n: n.isNotNull())
    owners = requests.select(F.col("stock_code").alias("owner"), F.explode(
        F.concat(F.array(F.concat(F.lit("c:"), "stock_code")), F.transform(names, lambda n: F.concat(F.lit("n:"), n)))).alias("_scope")).distinct()
    scopes = F.array_compact(F.array(F.concat(F.lit("c:"), "stock_code"), F.concat(F.lit("n:"), "stock_name")))
    told = R.theme_sentences(chunks.withColumn("_scopes", scopes), themes, keys=("owner",), least_cjk=least_cjk, longest=longest, owners=owners)
    listed = F.array_sort(F.collect_list(F.struct("theme_order", "theme", "paper_path", "sentence")))
    return told.groupBy(F.col("owner").alias("stock_code")).agg(listed.alias("_t")).select(
        "stock_code", F.transform("_t", lambda x: x["theme"]).alias("themes"),
        F.transform("_t", lambda x: F.struct(x["paper_path"].alias("paper_path"), x["sentence"].alias("text"))).alias("theme_references"))


def _cleaned(refs: DataFrame) -> DataFrame:
    """request_id, references: the first three distinct ones that can be quoted."""
    rows = refs.select("request_id", F.posexplode("references").alias("at", "r")).select(
        "request_id", "at", "r.paper_path", T.reference_snippet(F.col("r.text"), 120).alias("snippet"))
    kept = R.dedupe_references(rows, ["request_id"], "at")
    return kept.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("reference_rank", "paper_path", "snippet"))).alias("_r")).select(
        "request_id", F.transform("_r", lambda x: F.struct(x["paper_path"].alias("paper_path"), x["snippet"].alias("text"))).alias("references"))


def attribution_answers(requests: DataFrame, facts: DataFrame, chunks: DataFrame, lex: Lexicon = DEFAULT, themes=fv.THEMES,
                        least_cjk: float = 0.2, themed=fv.REVENUE_COLUMNS, ask: str = fv.ATTRIBUTION_QUESTION,
                        terms: int | None = None, limits: tuple | None = None, longest: int | None = None) -> DataFrame:
    """request_id, question, status, summary, references of each request.

    Requests on a metric of ``themed`` are answered by themes where their company's texts name one; all others by retrieval
    with the question ``ask`` (company, metric).  The conclusion from the facts comes first; without one, that of the
    evidence.  Status: answered, or thin_evidence where no reference is left.  Null codes find neither facts nor texts.
    """
    c = F.col
    chunks = R.in_order(chunks) if limits else chunks  # texts are cut once, for the themes and the search
    known = R.attribution_facts(requests, facts)
    known = known.withColumn("conclusion", F.coalesce(conclusion(c("yoy"), c("yoy_status")), F.lit("")))
    themes_told = checkpointed(company_themes(requests.filter(c("metric_key").isin(*themed)), chunks, themes, least_cjk, longest))  # read twice
    told = requests.filter(c("metric_key").isin(*themed)).join(themes_told, "stock_code")
    by_theme = told.select(
        "request_id", c("theme_references").alias("references"),
        F.format_string(fv.ATTRIBUTION_THEMES, "stock_abbr", F.array_join("themes", "、")).alias("content"))
    rest = requests.join(told.select("request_id"), "request_id", "left_anti").select(
        "request_id", F.format_string(ask, "stock_abbr", "metric_label").alias("question"), F.lit(True).alias("prefer_causes"),
        "stock_code", "stock_abbr", "company_name")
    by_search = R.retrieve(rest, chunks, lex, terms, limits).select("request_id", "references", "content")
    found = by_theme.unionByName(by_search)
    out = known.join(found.select("request_id", "content"), "request_id").join(_cleaned(found), "request_id", "left")
    lines = F.array_join(F.transform("references", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["text"])), "\n")
    first = F.when(c("conclusion") != "", c("conclusion"))
    bare = F.coalesce(first, c("content"))
    summary = (
        F.when(c("references").isNotNull(), F.concat(
            F.coalesce(first, T.reference_snippet(c("content"), 120), c("content")), F.lit(fv.ATTRIBUTION_EVIDENCE), lines))
        .when(bare.contains(fv.THIN_MARK), bare).otherwise(F.concat(bare, F.lit(fv.ATTRIBUTION_THIN)))
    )
    return out.select(
        "request_id", F.format_string(ask, "stock_abbr", "metric_label").alias("question"),
        F.when(c("references").isNotNull(), "answered").otherwise("thin_evidence").alias("status"), summary.alias("summary"), "references")
