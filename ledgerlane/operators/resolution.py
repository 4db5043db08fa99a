"""Choosing one value per statement field out of many candidates, with its lineage.

Candidates: table_name, stock_code, report_period, field_name, value, priority, seq, mode,
source_file, source_excerpt.  ``mode`` is ``last`` (a later value of equal priority wins) or
``reasonable`` (the first stands, unless it is below 1 in size and a later one is not).

Both modes are a maximum over (priority, epoch, reasonable, earliest): ``epoch`` counts the
``last`` candidates seen so far at that priority, so the newest one outranks what came before
it.  A maximum needs no fold: the winner is a plain aggregate with map-side combine, and the
value held before each candidate is a prefix maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import numbers as N
from ..functions.periods import previous_period
from ..scale import running, top_per

FIELD_KEY = ["table_name", "stock_code", "report_period", "field_name"]
BUCKET_ROWS = 1_000_000


def cumulative(quarters: list[Column]) -> list[Column]:
    """Year-to-date values of four quarters: NULL until the first value, then carried on."""
    out, total = [], None
    for q in quarters:
        total = q if total is None else F.coalesce(total + q, total, q)
        out.append(total)
    return out


def cumulative_quarters(df: DataFrame, keys, quarter: str, value: str, name: str) -> DataFrame:
    """Year-to-date values over rows (at most four per key)."""
    w = Window.partitionBy(*keys).orderBy(quarter).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def _with_epoch(candidates: DataFrame, bucket_rows: int) -> DataFrame:
    return running(
        candidates, [*FIELD_KEY, "priority"], ["seq"], F.floor(F.col("seq") / bucket_rows),
        {"epoch": ("sum", (F.col("mode") == "last").cast("long"))}, inclusive=True,
    )


def _rank() -> Column:
    """Comparable claim of a candidate; carries its own source so a loser keeps its file."""
    return F.struct(
        "priority",
        "epoch",
        (F.abs("value") >= 1).alias("sized"),
        (-F.col("seq")).alias("earliest"),
        "value", "source_file", "source_excerpt",
    )


def usable(candidates: DataFrame) -> DataFrame:
    """Values inside the limits of their field."""
    kept = candidates.withColumn("value", N.sanitize_field(F.col("field_name"), F.col("value")))
    return kept.filter(F.col("value").isNotNull())


def resolve_fields(candidates: DataFrame, bucket_rows: int = BUCKET_ROWS, mixed: bool = True) -> DataFrame:
    """The winning candidate per field.  ``mixed=False`` states that all modes are ``last``,
    which needs no epoch and so a single aggregation."""
    if not mixed:
        best = F.max(F.struct("priority", "seq", "value", "source_file", "source_excerpt"))
    else:
        candidates, best = _with_epoch(candidates, bucket_rows), F.max(_rank())
    won = candidates.groupBy(*FIELD_KEY).agg(best.alias("best"))
    return won.select(*FIELD_KEY, "best.value", "best.priority", "best.source_file", "best.source_excerpt")


def conflicts(candidates: DataFrame, bucket_rows: int = BUCKET_ROWS, mixed: bool = True) -> DataFrame:
    """Candidates that differ from the value held when they arrived, and what was decided."""
    if mixed:
        rows, claim = _with_epoch(candidates, bucket_rows), _rank()
    else:
        rows = candidates
        claim = F.struct("priority", "seq", "value", "source_file", "source_excerpt")
    held = running(
        rows.withColumn("claim", claim), FIELD_KEY, ["seq"], F.floor(F.col("seq") / bucket_rows),
        {"held": ("max", F.col("claim"))},
    )
    replaced = F.col("claim") > F.col("held")
    pick = lambda yes, no: F.when(replaced, yes).otherwise(no)
    return held.filter(N.values_conflict(F.col("held.value"), F.col("value"))).select(
        *FIELD_KEY,
        "seq",
        pick(F.lit("replace_existing"), F.lit("keep_existing")).alias("decision"),
        F.col("held.value").alias("existing_value"),
        F.col("value").alias("candidate_value"),
        F.col("held.priority").alias("existing_priority"),
        F.col("priority").alias("candidate_priority"),
        F.col("held.source_file").alias("existing_source_file"),
        F.col("source_file").alias("candidate_source_file"),
        F.col("held.source_excerpt").alias("existing_source_excerpt"),
        F.col("source_excerpt").alias("candidate_source_excerpt"),
    )


def cap_conflicts(found: DataFrame, per_row: int | None = None, overall: int | None = None) -> DataFrame:
    """Report-sized excerpt of a conflict log: so many per statement row, so many in all."""
    order = ["table_name", "stock_code", "report_period", "seq", "field_name"]
    if per_row is not None:
        found = top_per(found, ["table_name", "stock_code", "report_period"], ["seq", "field_name"], per_row)
    found = found.orderBy(*order)
    return found.limit(overall) if overall is not None else found


def row_sources(candidates: DataFrame) -> DataFrame:
    """Row-level source: the latest candidate of the highest priority; empty text never wins."""
    claim = F.struct("priority", "seq")

    def latest(name):
        return F.max_by(F.when(F.col(name) != "", F.col(name)), F.when(F.col(name) != "", claim)).alias(name)

    def first(name):
        return F.min_by(F.when(F.col(name) != "", F.col(name)), F.when(F.col(name) != "", F.col("seq"))).alias(name)

    return candidates.groupBy("table_name", "stock_code", "report_period").agg(
        latest("source_file"), latest("source_excerpt"), latest("report_date"),
        F.max("priority").alias("row_priority"), first("stock_abbr"),
    )


def widen(resolved: DataFrame, table: str, sources: DataFrame) -> DataFrame:
    """One row per company and period with a column per field of ``table``."""
    fields = [m[1] for m in fv.METRICS if m[0] == table]
    fields += [m[3] for m in fv.METRICS if m[0] == table and m[3]]
    values = resolved.filter(F.col("table_name") == table).groupBy("stock_code", "report_period").agg(
        *[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in dict.fromkeys(fields)]
    )
    meta = sources.filter(F.col("table_name") == table).drop("table_name")
    year = F.regexp_extract("report_period", "^([0-9]{4})", 1)
    return values.join(meta, ["stock_code", "report_period"]).withColumn("report_year", year)


def lineage(resolved: DataFrame, found: DataFrame, fields=fv.KEY_LINEAGE_FIELDS, updated_at: Column | None = None) -> DataFrame:
    """Chosen rows, then conflict rows, for the fields whose lineage is kept.

    The stage of a value is the excerpt it was read with; ``updated_at`` is the time of the load (now, unless given).
    """
    empty = F.lit("")
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss") if updated_at is None else updated_at
    chosen = resolved.filter(F.col("field_name").isin(*fields) & F.col("value").isNotNull()).select(
        *FIELD_KEY,
        F.col("value").alias("field_value"), "source_file", "source_excerpt",
        F.col("priority").alias("source_priority"),
        F.lit("chosen").alias("decision"),
        F.lit(None).cast("double").alias("candidate_value"),
        empty.alias("candidate_source_file"), empty.alias("candidate_source_excerpt"),
        F.lit(None).cast("int").alias("candidate_priority"),
    )
    took = F.col("decision") == "replace_existing"

    def side(a, b):
        return F.when(took, F.col(a)).otherwise(F.col(b))

    lost = found.filter(F.col("field_name").isin(*fields)).select(
        *FIELD_KEY,
        side("candidate_value", "existing_value").alias("field_value"),
        side("candidate_source_file", "existing_source_file").alias("source_file"),
        side("candidate_source_excerpt", "existing_source_excerpt").alias("source_excerpt"),
        side("candidate_priority", "existing_priority").alias("source_priority"),
        "decision",
        side("existing_value", "candidate_value").alias("candidate_value"),
        side("existing_source_file", "candidate_source_file").alias("candidate_source_file"),
        side("existing_source_excerpt", "candidate_source_excerpt").alias("candidate_source_excerpt"),
        side("existing_priority", "candidate_priority").alias("candidate_priority"),
    )
    stage = lambda excerpt: F.coalesce(F.col(excerpt), empty)
    return chosen.unionByName(lost).withColumns({
        "extractor_stage": stage("source_excerpt"), "updated_at": when, "candidate_extractor_stage": stage("candidate_source_excerpt")})


def recompute_income_growth(income: DataFrame) -> DataFrame:
    """Growth of the four income fields from last year's row, where that row exists.

    A printed growth is overwritten then, even by NULL.  Joined on the previous period, not a
    lag, so a gap year gives no growth.
    """
    pairs = [(v, g) for v, g in fv.INCOME_GROWTH if v in income.columns]
    before = income.groupBy("stock_code", "report_period").agg(
        *[F.max(v).alias(f"_{v}") for v, _ in pairs], F.lit(True).alias("_has_previous")
    ).withColumnRenamed("report_period", "_previous")
    out = income.withColumn("_previous", previous_period(F.col("report_period"))).join(
        before, ["stock_code", "_previous"], "left"
    )
    for v, g in pairs:
        old = F.col(g) if g in income.columns else F.lit(None).cast("double")
        out = out.withColumn(g, F.when(F.col("_has_previous"), N.growth(F.col(v), F.col(f"_{v}"))).otherwise(old))
    return out.drop("_previous", "_has_previous", *[f"_{v}" for v, _ in pairs])


def _contradicted(series: DataFrame, candidates: DataFrame, bucket_rows: int) -> DataFrame:
    """Year totals of ``series`` that conflict with the annual value held when they arrived: an as-of prefix state per field."""
    none = F.lit(None)
    kinds = {f.name: f.dataType for f in candidates.schema}
    claim = F.struct("priority", "seq", "value", "source_file", "source_excerpt")
    total = F.struct("doc", "year", "priority", "value", "source_file", "source_excerpt")
    probes = series.filter(F.col("report_period").endswith("FY")).select(*FIELD_KEY, "seq", total.alias("total"))
    known = candidates.filter(F.col("report_period").endswith("FY")).select(*FIELD_KEY, F.col("seq").cast(kinds["seq"]), claim.alias("claim"))
    rows = known.withColumn("total", none.cast(probes.schema["total"].dataType)).unionByName(
        probes.withColumn("claim", none.cast(known.schema["claim"].dataType)))
    held = running(rows.withColumn("_probe", F.col("total").isNotNull()), FIELD_KEY, ["seq", "_probe"], F.floor(F.col("seq") / bucket_rows),
                   {"held": ("max", F.col("claim"))})
    return held.filter(F.col("_probe") & N.values_conflict(F.col("held.value"), F.col("total.value")))


def veto_series(series: DataFrame, candidates: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Drop a quarter series whose year total conflicts with the annual value that earlier candidates had left.

    ``series``: table_name, stock_code, field_name, year, doc, seq, report_period, value, priority, source_file,
    source_excerpt; ``candidates``: those of ``resolve_fields``, all of mode ``last``.  What arrives after a series, such as a
    revised summary, does not count against it.
    """
    vetoed = _contradicted(series, candidates, bucket_rows).select("table_name", "stock_code", "field_name", "total.year", "total.doc")
    return series.join(vetoed.distinct(), ["table_name", "stock_code", "field_name", "year", "doc"], "left_anti")


def series_conflicts(series: DataFrame, candidates: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A conflict row, as ``conflicts`` has them, for each quarter series that ``veto_series`` drops."""
    c = F.col
    return _contradicted(series, candidates, bucket_rows).select(
        *FIELD_KEY, "seq", F.lit("keep_existing").alias("decision"), c("held.value").alias("existing_value"), c("total.value").alias("candidate_value"),
        c("held.priority").alias("existing_priority"), c("total.priority").alias("candidate_priority"),
        c("held.source_file").alias("existing_source_file"), c("total.source_file").alias("candidate_source_file"),
        c("held.source_excerpt").alias("existing_source_excerpt"), c("total.source_excerpt").alias("candidate_source_excerpt"))
