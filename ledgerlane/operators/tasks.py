"""Steps of a payload that read what earlier steps answered: company sets, and extremes over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import numbers as N
from ..functions.periods import previous_period

ASK = ("route", "metric_key", "at", "top_k")


def point_at_sets(steps: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``set`` (the ranking whose companies a step is about, and their number) and the route ``set_extreme``.

    A ranking step that found companies leaves them to the steps behind it; a step that asks for an extreme
    of a metric (``over_set``) takes the last set left, if it has more than one company, and leaves it as it is.  A step points
    at the ranking instead of carrying its companies.  The fold runs over the steps of one payload cell.
    """
    sizes = sets.groupBy(*ASK).agg(F.count(F.lit(1)).alias("n"))
    known = steps.join(sizes, list(ASK), "left")
    none = F.lit(None).cast("struct<route:string,metric_key:string,at:string,top_k:int,n:bigint>")
    own = F.when(F.col("n") > 0, F.struct(*ASK, "n"))
    whole = ~F.col("route").isin("ranking_growth")  # which keeps to its own companies
    item = F.struct("step", (F.col("over_set") & whole).alias("takes"), own.alias("leaves"))
    told = known.groupBy("row_key").agg(F.array_sort(F.collect_list(item)).alias("s"))

    def follow(acc, x):
        takes = x["takes"] & (F.coalesce(acc["set"]["n"], F.lit(0)) > 1)
        after = F.when(takes, acc["set"]).otherwise(F.coalesce(x["leaves"], acc["set"]))
        return F.struct(after.alias("set"), F.concat(acc["out"], F.array(F.struct(x["step"].alias("step"), F.when(takes, acc["set"]).alias("set")))).alias("out"))

    start = F.struct(none.alias("set"), F.array().cast("array<struct<step:int,set:struct<route:string,metric_key:string,at:string,top_k:int,n:bigint>>>").alias("out"))
    pointed = told.select("row_key", F.explode(F.aggregate("s", start, follow)["out"]).alias("p")).select("row_key", "p.step", "p.set")
    out = steps.join(pointed.hint("merge"), ["row_key", "step"], "left")
    return out.withColumn("route", F.when(F.col("set").isNotNull(), "set_extreme").otherwise(F.col("route")))


def grown(rows: DataFrame, values: DataFrame) -> DataFrame:
    """``rows`` (metric_key, at, stock_code, metric_value) with yoy and its status against the same companies a year before."""
    before = values.groupBy("metric_key", F.col("report_period").alias("_year_ago"), "stock_code").agg(F.max("metric_value").alias("_before"))
    out = rows.withColumn("_year_ago", previous_period(F.col("at"))).join(before.hint("merge"), ["metric_key", "_year_ago", "stock_code"], "left")
    yoy, status = N.display_growth(F.lit(None).cast("double"), F.col("metric_value"), F.col("_before"), F.col("at"))
    return out.withColumns({"yoy": yoy, "yoy_status": status}).drop("_year_ago", "_before")


def growing_tops(tops: DataFrame, values: DataFrame, shown) -> DataFrame:
    """metric_key, at, top_k, _n, _l (a line per company), _best (of the largest growth, then the higher place)."""
    c = F.col
    rows = grown(tops.filter("metric_value is not null"), values)
    growth = F.when(c("yoy").isNotNull(), F.concat(N.two_decimals(c("yoy")), F.lit("%"))).otherwise(
        F.when(c("yoy_status") == "not_applicable", fv.GROWTH_NOT_APPLICABLE).otherwise(fv.GROWTH_NOT_KNOWN))
    line = F.concat_ws("", c("position").cast("string"), F.lit(". "), "stock_abbr", F.lit("："), shown(c("metric_value"), c("metric_key")), F.lit("，同比"), growth)
    best = F.max(F.when(c("yoy").isNotNull(), F.struct(c("yoy").alias("yoy"), (-c("position")).alias("place"), "stock_abbr")))
    return rows.groupBy("metric_key", "at", "top_k").agg(
        F.count(F.lit(1)).cast("int").alias("_n"), best.alias("_best"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("_l"))  # at most top_k


def set_extremes(asked: DataFrame, sets: DataFrame, values: DataFrame) -> DataFrame:
    """set, metric_key, at, by_growth, least, _x (stock_code, stock_abbr, score), _codes: the company of a set with the extreme value or growth.

    Equal scores go to the lesser code.  Each distinct request is answered once.
    """
    c = F.col
    requests = asked.select("set", "metric_key", "at", "by_growth", "least").distinct().withColumn("_r", F.monotonically_increasing_id())
    requests = requests.select("*", c("set.route").alias("_route"), c("set.metric_key").alias("_metric"), c("set.at").alias("_at"), c("set.top_k").alias("_k"))
    members = sets.select(c("route").alias("_route"), c("metric_key").alias("_metric"), c("at").alias("_at"), c("top_k").alias("_k"), "stock_code").distinct()
    now = values.groupBy("metric_key", c("report_period").alias("at"), "stock_code").agg(F.max("metric_value").alias("metric_value"), F.max("stock_abbr").alias("stock_abbr"))
    rows = requests.join(members, ["_route", "_metric", "_at", "_k"]).join(now.hint("merge"), ["metric_key", "at", "stock_code"], "left")
    scored = grown(rows, values).withColumn("score", F.when(c("by_growth"), c("yoy")).otherwise(c("metric_value")))
    key = ["set", "metric_key", "at", "by_growth", "least"]
    rank = F.when(c("least"), -c("score")).otherwise(c("score"))
    # the lesser code of equal scores: the least of (negated score, code)
    best = F.min(F.when(c("score").isNotNull(), F.struct((-rank).alias("by"), "stock_code", "stock_abbr", "score")))
    return scored.groupBy(*key).agg(best.alias("_x"), F.array_sort(F.collect_set("stock_code")).alias("_codes"))  # at most top_k codes
