"""Data-quality checks on statement tables.

Rules are evaluated on the wide row: last year's row and the peers of the period are joined
once per table, each cell's reason is a specialised expression with its limits as literals,
and issues and repaired tables both come out of that one projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import numbers as N
from ..functions.periods import is_valid_period, normalize_period, previous_period
from ..functions.text import has_encoding_issue
from ..scale import group_ranks
from ..session import checkpointed

LABELS = {m[1]: m[2] for m in reversed(fv.METRICS)}


def metric_columns(sheet: DataFrame) -> list[str]:
    return [c for c in sheet.columns if c not in fv.ROW_METADATA and c not in ("row_id", "table_name")]


def with_row_id(sheet: DataFrame) -> DataFrame:
    if "row_id" in sheet.columns:
        return sheet
    if "serial_number" in sheet.columns:
        return sheet.withColumn("row_id", F.col("serial_number").cast("string"))
    return sheet.withColumn("row_id", F.concat_ws("|", "stock_code", "report_period"))


# --- peers -------------------------------------------------------------------------------


def cells(sheets: dict[str, DataFrame], columns=None) -> DataFrame:
    """table_name, column_name, report_period, value for every filled metric cell."""
    parts = []
    for table, df in sheets.items():
        use = [c for c in metric_columns(df) if columns is None or c in columns]
        if use:
            one = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in use]))
            parts.append(df.select(F.lit(table).alias("table_name"), normalize_period(F.col("report_period")).alias("report_period"), one))
    return reduce(DataFrame.unionByName, parts).filter(F.col("value").isNotNull() & (F.col("report_period") != ""))


def peer_profile(sheets: dict[str, DataFrame], columns=None) -> DataFrame:
    """Count, median and nearest-rank 90th percentile per table, column and period.

    A peer group spans all companies.  Its cells are counted by bins that never decrease with the value; only those in
    the at most three bins that hold a rank asked for are sorted, over all tasks, so most cells are never shuffled.
    """
    keys = ["table_name", "column_name", "report_period"]
    every = cells(sheets, columns).withColumn("_bin", _bin(F.col("value")))
    n, first, last = F.col("peer_count"), F.col("_first"), F.col("_last")
    targets = {
        "low": F.floor((n + 1) / 2),
        "high": F.floor(n / 2) + 1,
        "p90": F.bround((n - 1) * 0.9).cast("long") + 1,
    }
    at = lambda t: (first <= t) & (last >= t)
    any_at = reduce(lambda a, b: a | b, [at(t) for t in targets.values()])
    group = Window.partitionBy(*keys)
    counts = every.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    ranked = counts.withColumn("_last", F.sum("_n").over(group.orderBy("_bin"))).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    held = checkpointed(ranked.withColumn("peer_count", F.sum("_n").over(group)).filter(any_at).select(*keys, "_bin", "_first", "peer_count"))
    near = group_ranks(_in_bins(every, held.select(*keys, "_bin")), [*keys, "_bin"], "value")
    skip = F.col("_first") - 1
    picked = near.join(held, [*keys, "_bin"]).select(
        *keys, "value", "peer_count", (skip + F.col("first_rank")).alias("_first"), (skip + F.col("last_rank")).alias("_last"))
    return (
        picked.filter(any_at).groupBy(*keys)
        .agg(F.max("peer_count").alias("peer_count"), *[F.max(F.when(at(t), F.col("value"))).alias(k) for k, t in targets.items()])
        .select(*keys, "peer_count", ((F.col("low") + F.col("high")) / 2.0).alias("median"), "p90")
    )


WELL_FORMED = "^20[0-9]{2}(FY|HY|Q1|Q2|Q3|Q4)$"


def _in_bins(every: DataFrame, held: DataFrame) -> DataFrame:
    """The cells in some bins.  Those of well-formed periods, three a column at most, are broadcast."""
    keys, good = held.columns, F.col("report_period").rlike(WELL_FORMED)
    found, odd = every.join(F.broadcast(held.filter(good)), keys, "left_semi"), held.filter(~good)
    return found if odd.isEmpty() else found.unionByName(every.join(odd, keys, "left_semi"))


BINS = 500  # per factor of e


def _bin(value: Column) -> Column:
    """Whole number that never decreases with the value (NaN is the greatest value)."""
    size = F.floor(F.signum(value) * F.log1p(F.abs(value)) * BINS)
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).otherwise(size)


def _peer_limit() -> Column:
    floors = F.create_map(*[F.lit(x) for kv in fv.PEER_FLOORS.items() for x in kv])
    return F.greatest(
        F.abs("p90") * fv.PEER_P90_FACTOR,
        F.abs("median") * fv.PEER_MEDIAN_FACTOR,
        F.coalesce(F.try_element_at(floors, F.col("column_name")), F.lit(fv.PEER_FLOOR_DEFAULT)),
    )


def peer_limits(profile: DataFrame) -> DataFrame:
    """table_name, period, limits: one map of column -> largest believable size per period."""
    return (
        profile.filter(F.col("peer_count") >= fv.PEER_MIN_COUNT)
        .groupBy("table_name", F.col("report_period").alias("_period"))
        .agg(F.map_from_entries(F.collect_list(F.struct("column_name", _peer_limit()))).alias("_limits"))
    )


def _join_limits(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Peer limits by period.  Well-formed periods number at most 600 (20YY x 6), so that side
    is broadcast; rows with a malformed period take an ordinary join."""
    well = F.col("_period").rlike(WELL_FORMED)
    odd = limits.filter(~well)
    if odd.isEmpty():  # as a rule: the rows are then read once
        return rows.join(F.broadcast(limits), "_period", "left")
    return rows.filter(well).join(F.broadcast(limits.filter(well)), "_period", "left").unionByName(
        rows.filter(~well).join(odd, "_period", "left"))


# --- rules -------------------------------------------------------------------------------


def _first(*rules) -> Column:
    """Name of the first rule whose condition holds."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules]) if rules else F.lit(None).cast("string")


def _amount_rules(c: str, now, before, anchor: dict) -> list:
    v, size = now(c), F.abs(now(c))
    over = lambda total, factor: size > F.greatest(F.abs(total) * factor, F.lit(10.0))
    revenue = F.coalesce(now("main_business_revenue"), now("total_operating_revenue"))
    rules = []
    if c in fv.AMOUNT_LIMITS:
        rules.append(("amount_exceeds_absolute_limit", size > fv.AMOUNT_LIMITS[c]))
    if c in fv.NON_NEGATIVE_COLUMNS:
        rules.append(("negative_amount_not_allowed", v < 0))
    if c in ("net_profit", "total_profit"):
        rules.append(("profit_exceeds_revenue", revenue.isNotNull() & over(revenue, 1.05)))
    if c == "main_business_revenue":
        total = now("total_operating_revenue")
        rules.append(("main_business_exceeds_total_revenue", total.isNotNull() & over(total, 1.05)))
    if c in fv.COMPONENT_TOTALS:
        total = now(fv.COMPONENT_TOTALS[c])
        rules.append(("component_exceeds_total", total.isNotNull() & over(total, 1.05)))
    assets = now("asset_total_assets")
    if c == "liability_total_liabilities":
        rules.append(("liability_exceeds_assets", assets.isNotNull() & over(assets, 1.5)))
    if c == "equity_parent_net_assets":
        rules.append(("equity_exceeds_assets", assets.isNotNull() & over(assets, 1.2)))
    if c in fv.CASH_FLOW_COLUMNS:
        zero = F.lit(0.0)
        base = F.greatest(*[F.coalesce(F.abs(a), zero) for a in anchor.values()], F.lit(1.0))
        rules.append(("cashflow_scale_mismatch", size > base * 3.5))
    factor = fv.AMOUNT_HISTORY_FACTORS.get(c, fv.AMOUNT_HISTORY_DEFAULT)
    rules.append(("history_scale_jump", before(c).isNotNull() & (size >= 50.0) & N.scale_gap(v, before(c), factor)))
    limit = F.try_element_at(F.col("_limits"), F.lit(c))
    rules.append(("peer_outlier", F.coalesce(size > limit, F.lit(False))))
    return rules


def _ratio_rules(c: str, now, before) -> list:
    v, size = now(c), F.abs(now(c))
    rules = []
    if c == "asset_liability_ratio":
        rules.append(("asset_liability_ratio_out_of_range", ~v.between(0.0, 100.0)))
    if c in ("roe", "roe_weighted_excl_non_recurring"):
        rules.append(("abnormal_roe", size > fv.MAX_ABS_ROE))
    rules.append(("abnormal_growth_or_ratio", size > fv.MAX_ABS_RATIO))
    factor = fv.RATIO_HISTORY_FACTORS.get(c, fv.RATIO_HISTORY_DEFAULT)
    rules.append(("ratio_scale_jump", before(c).isNotNull() & (size > 10.0) & N.scale_gap(v, before(c), factor)))
    base = fv.GROWTH_BASES.get(c)
    if base:
        jump = fv.AMOUNT_HISTORY_FACTORS.get(base, fv.AMOUNT_HISTORY_DEFAULT)
        a, b = now(base), before(base)
        both = a.isNotNull() & b.isNotNull()
        computed = N.growth(a, b)
        rules += [
            ("growth_scale_mismatch", both & N.scale_gap(a, b, jump)),
            ("recomputed_growth_out_of_range", F.abs(computed) > fv.MAX_ABS_RATIO),
            ("growth_recompute_mismatch", F.abs(v - computed) > F.greatest(F.lit(20.0), F.abs(computed) * 0.6)),
            ("growth_scale_mismatch", both & (N.change_multiple(a, b) >= jump) & (size < 80.0)),
        ]
    return rules


def _eps_rules(c: str, now, before) -> list:
    size = F.abs(now(c))
    factor = fv.RATIO_HISTORY_FACTORS.get(c, fv.RATIO_HISTORY_DEFAULT)
    return [
        ("abnormal_eps", size > fv.MAX_ABS_EPS),
        ("eps_scale_jump", before(c).isNotNull() & (size > 0.5) & N.scale_gap(now(c), before(c), factor)),
    ]


def _anchor(sheet: DataFrame, table: str, sheets: dict, parity: bool) -> tuple[DataFrame, dict]:
    """Scale anchor of a cash-flow row: income and balance of the same company and period.

    ``parity`` looks only at the row itself.
    """
    sources = {
        "revenue": ("income_sheet", ("main_business_revenue", "total_operating_revenue")),
        "assets": ("balance_sheet", ("asset_total_assets",)),
        "liabilities": ("balance_sheet", ("liability_total_liabilities",)),
    }
    out, sides = sheet, {}
    for name, (other, cols) in sources.items():
        own = [F.col(c) for c in cols if c in sheet.columns]
        if parity or other not in sheets or own or not any(c in sheets[other].columns for c in cols):
            out = out.withColumn(f"_{name}", F.coalesce(*own) if own else F.lit(None).cast("double"))
            continue
        have = [F.col(c) for c in cols if c in sheets[other].columns]
        sides.setdefault(other, []).append(F.max(F.coalesce(*have)).alias(f"_{name}"))
    for other, asked in sides.items():
        side = sheets[other].groupBy("stock_code", "report_period").agg(*asked)
        out = out.join(side, ["stock_code", "report_period"], "left")
    return out, {n: F.col(f"_{n}") for n in sources}


def judged(sheet: DataFrame, table: str, sheets: dict[str, DataFrame], limits: DataFrame, parity: bool = False) -> DataFrame:
    """The table with a ``_why_<column>`` reason next to each metric column (NULL = fine)."""
    columns = metric_columns(sheet)
    have = set(columns)
    rows = with_row_id(sheet).withColumn("_period", normalize_period(F.col("report_period")))
    order = F.col("serial_number") if "serial_number" in sheet.columns else F.col("row_id")
    # of duplicate keys the highest serial number is the previous row
    before_rows = (
        rows.filter((F.col("stock_code") != "") & (F.col("_period") != ""))
        .groupBy("stock_code", F.col("_period").alias("_previous"))
        .agg(F.max_by(F.struct(*columns), order).alias("_before"))
    )
    rows = rows.withColumn("_previous", previous_period(F.col("_period"))).join(before_rows, ["stock_code", "_previous"], "left")
    if any(c in fv.CASH_FLOW_COLUMNS for c in columns):
        rows, anchor = _anchor(rows, table, sheets, parity)
    else:
        anchor = {}
    rows = _join_limits(rows, limits.filter(F.col("table_name") == table).drop("table_name"))

    def now(c):
        return F.col(c).cast("double") if c in have else F.lit(None).cast("double")

    def before(c):
        return F.col(f"_before.{c}").cast("double") if c in have else F.lit(None).cast("double")

    why = {}
    for c in columns:
        if c in fv.AMOUNT_LIMITS:
            rules = _amount_rules(c, now, before, anchor)
        elif c in fv.EPS_COLUMNS:
            rules = _eps_rules(c, now, before)
        elif c in fv.RATIO_COLUMNS or c.endswith(("_growth", "_ratio")):
            rules = _ratio_rules(c, now, before)
        else:
            rules = []
        if rules:
            why[c] = F.when(now(c).isNotNull(), _first(*rules))
    rows = rows.withColumns({f"_why_{c}": e for c, e in why.items()})
    follow = {
        g: F.coalesce(
            F.col(f"_why_{g}") if g in why else F.lit(None).cast("string"),
            F.when(F.col(f"_why_{b}").isNotNull() & F.col(g).isNotNull(), F.lit("base_metric_sanitized")),
        )
        for g, b in fv.GROWTH_BASES.items()
        if g in have and b in why
    }
    rows = rows.withColumns({f"_why_{g}": e for g, e in follow.items()}) if follow else rows
    return rows.drop("_before", "_previous", "_limits", "_revenue", "_assets", "_liabilities", "_period")


def judge_all(sheets: dict[str, DataFrame], parity: bool = False, written: bool = True) -> dict[str, DataFrame]:
    """All tables judged.  Where issues, repaired tables and reports read them, each is written once, or every reader
    would evaluate the rules again; a job that reads them once sets ``written`` to False."""
    limits = checkpointed(peer_limits(peer_profile(sheets, columns=tuple(fv.AMOUNT_LIMITS))))
    done = {t: judged(df, t, sheets, limits, parity) for t, df in sheets.items()}
    return {t: checkpointed(df) for t, df in done.items()} if written else done


def cell_issues(judged_sheets: dict[str, DataFrame]) -> DataFrame:
    """One row per implausible cell."""
    parts = []
    for table, df in judged_sheets.items():
        flagged = [c[5:] for c in df.columns if c.startswith("_why_")]
        if not flagged:
            continue
        hit = F.inline(F.array(*[
            F.struct(
                F.lit(c).alias("column_name"), F.lit(LABELS.get(c, c)).alias("column_label"),
                F.col(c).cast("double").alias("value"), F.col(f"_why_{c}").alias("reason"),
            )
            for c in flagged
        ]))
        extra = [(F.col(c) if c in df.columns else F.lit("")).alias(c) for c in ("source_file", "source_excerpt")]
        parts.append(
            df.select(F.lit(table).alias("table_name"), "row_id", "stock_code", "report_period", *extra, hit)
            .filter(F.col("reason").isNotNull())
        )
    return reduce(DataFrame.unionByName, parts)


def sanitize(judged_sheets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The statement tables with flagged cells set to NULL."""
    out = {}
    for table, df in judged_sheets.items():
        keep = [c for c in df.columns if not c.startswith("_why_")]
        out[table] = df.select(*[
            F.when(F.col(f"_why_{c}").isNull(), F.col(c)).alias(c) if f"_why_{c}" in df.columns else F.col(c) for c in keep
        ])
    return out


# --- whole-table checks ------------------------------------------------------------------


def duplicate_keys(sheet: DataFrame, keys=("stock_code", "report_period"), limit: int | None = None) -> DataFrame:
    out = (
        sheet.groupBy(*keys).agg(F.count(F.lit(1)).alias("duplicate_count"))
        .filter(F.col("duplicate_count") > 1)
        .orderBy(F.col("duplicate_count").desc(), *keys)
    )
    return out.limit(limit) if limit is not None else out


def coverage(sheet: DataFrame, table: str, fields) -> DataFrame:
    """Filled count and ratio per critical field; a field the table lacks counts 0."""
    have = [f for f in fields if f in sheet.columns]
    total = sheet.agg(F.count(F.lit(1)).alias("row_count"), *[F.count(f).alias(f) for f in have])
    rows = F.inline(F.array(*[
        F.struct(
            F.lit(f).alias("field_name"), (F.col(f) if f in have else F.lit(0)).cast("long").alias("non_null"),
            F.lit(f in have).alias("present"),
        )
        for f in fields
    ]))
    ratio = F.round(F.coalesce(F.try_divide("non_null", "row_count"), F.lit(0.0)), 4)
    return total.select(F.lit(table).alias("table_name"), "row_count", rows).withColumn("coverage_ratio", ratio)


def critical_missing(sheet: DataFrame, table: str, fields) -> DataFrame:
    """Rows without a value per critical field; NULL with ``column_missing`` when it is absent."""
    c = coverage(sheet, table, fields)
    return c.select(
        "table_name", F.col("field_name").alias("column_name"),
        F.when(F.col("present"), F.col("row_count") - F.col("non_null")).alias("missing_rows"),
        F.when(F.col("present"), "null_value").otherwise("column_missing").alias("reason"),
    )


def issues_by_column(issues: DataFrame) -> DataFrame:
    return issues.groupBy("column_name").agg(F.count(F.lit(1)).alias("issue_count")).orderBy(F.col("issue_count").desc(), "column_name")


def sanitized_rows(issues: DataFrame) -> DataFrame:
    return issues.groupBy("table_name").agg(F.countDistinct("row_id").alias("sanitized_rows")).orderBy("table_name")


def risky_companies(issues: DataFrame, limit: int = 10) -> DataFrame:
    return (
        issues.filter(F.col("stock_code") != "").groupBy("stock_code").agg(F.count(F.lit(1)).alias("issue_count"))
        .orderBy(F.col("issue_count").desc(), "stock_code").limit(limit)
    )


def conflicts_by_field(found: DataFrame) -> DataFrame:
    return found.groupBy("table_name", "field_name").agg(F.count(F.lit(1)).alias("conflict_count"))


def invalid_periods(sheet: DataFrame) -> DataFrame:
    c = F.col("report_period")
    return with_row_id(sheet).filter(~is_valid_period(c)).select(
        "row_id", "stock_code", F.coalesce(c, F.lit("")).alias("report_period"), normalize_period(c).alias("normalized_period")
    )


def missing_keys(sheet: DataFrame) -> DataFrame:
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return with_row_id(sheet).filter(blank("stock_code") | blank("report_period")).select("row_id", "stock_code", "report_period")


def damaged_labels(facts: DataFrame) -> DataFrame:
    return facts.filter(has_encoding_issue(F.col("metric_label"))).select(
        "metric_key", "metric_label", "stock_code", "report_period"
    )


def lineage_conflicts(lineage: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Conflict rows of the lineage table, else those of the extraction report."""
    found = lineage.filter(F.col("decision") != "chosen")
    return found if fallback is None or not found.isEmpty() else fallback
