"""Many bounds on one period: values and bounds are sorted together, and each bound becomes an interval of ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import placed_everywhere, running
from ..session import checkpointed

KEYS = ("metric_key", "report_period")
BEFORE_EQUALS, VALUE, BEHIND_EQUALS = 0, 1, 2


class RankDirectory:
    """Values ranked per (metric, period), largest first, then by code; and requests as intervals of those ranks.

    ``requests`` are rows with metric_key, report_period, operator (>, >=, <, <=) and bound; ``facts`` rows with
    metric_key, report_period, stock_code and metric_value.  A request never meets the companies of its period: its interval
    follows from the number of values sorted before its bound, and a list is read by rank, so the work
    is that of one sort and of the rows listed.  Null values and requests without bound meet nothing.
    """

    def __init__(self, requests: DataFrame, facts: DataFrame):
        c = F.col
        self.asked = requests
        bounds = requests.select(*KEYS, "operator", "bound").filter("bound is not null and metric_key is not null and report_period is not null").distinct()
        values = facts.filter("metric_value is not null").join(bounds.select(*KEYS).distinct(), list(KEYS), "left_semi")
        side = F.when(c("operator").isin(">", "<="), BEFORE_EQUALS).otherwise(BEHIND_EQUALS)
        row = F.struct(*[f for f in facts.columns if f not in KEYS])
        events = values.select(*KEYS, c("metric_value").alias("_by"), F.lit(VALUE).alias("_side"), c("stock_code").alias("_code"), row.alias("_row_of"), F.lit(None).cast("string").alias("operator")) \
            .unionByName(bounds.select(*KEYS, c("bound").alias("_by"), side.alias("_side"), "operator"), allowMissingColumns=True)
        placed = placed_everywhere(events, [*KEYS, c("_by").desc(), "_side", "_code"])
        counted = running(placed, list(KEYS), ["_row"], c("_pid"), {"_above": ("sum", (c("_side") == VALUE).cast("bigint"))})
        told = checkpointed(counted.select(*KEYS, "_by", "_side", "operator", "_row_of", F.coalesce("_above", F.lit(0)).alias("_above")))
        self.values = told.filter(c("_side") == VALUE).select(*KEYS, (c("_above") + 1).alias("_rank"), "_row_of")
        totals = self.values.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_total"))
        above = c("operator").isin(">", ">=")
        self.intervals = told.filter(c("_side") != VALUE).join(totals, list(KEYS), "left").select(
            *KEYS, "operator", c("_by").alias("bound"), F.when(above, 1).otherwise(c("_above") + 1).cast("bigint").alias("_first"),
            F.when(above, c("_above")).otherwise(F.coalesce("_total", F.lit(0))).cast("bigint").alias("_last"))

    def counts(self) -> DataFrame:
        """The requests with ``n_met``, the number of companies that meet the bound."""
        met = self.intervals.select(*KEYS, "operator", "bound", F.greatest(F.col("_last") - F.col("_first") + 1, F.lit(0)).alias("n_met"))
        return self.asked.join(met, [*KEYS, "operator", "bound"], "left").fillna(0, ["n_met"])

    def listed(self, limit: int | None = None) -> DataFrame:
        """The companies that meet each request and their position in its list; all, or the first ``limit``."""
        c = F.col
        last = c("_last") if limit is None else F.least(c("_last"), c("_first") + limit - 1)
        spans = self.asked.join(self.intervals, [*KEYS, "operator", "bound"]).withColumn("_end", last).filter("_end >= _first")
        ranks = spans.withColumn("_rank", F.explode(F.sequence("_first", "_end"))).withColumn("position", (c("_rank") - c("_first") + 1).cast("int"))
        return ranks.join(self.values, [*KEYS, "_rank"]).select(*self.asked.columns, "_row_of.*", "position")
