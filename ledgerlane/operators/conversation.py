"""Slots carried from turn to turn of a conversation: company, metric, period, company set.

A turn decides from the slots before it whether it continues the conversation, so this is a
true fold.  It is still run in parallel, and no conversation, however long, meets in one task:

* turns are cut into segments of at most ``FAN``; a segment is folded from each of the twelve
  possible patterns of filled slots, with placeholders for the values.  The result says what
  the segment does to any state: it is a summary that composes;
* summaries are composed ``FAN`` at a time, level by level, which yields the state each segment
  starts from; the segments are then folded once more, independently, from real states.

The metric slot never empties (a reset falls back on the last metric), so it is a prefix
maximum and no part of the patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import questions as Q
from ..functions.text import compact_text, contains_any, let, normalize_text
from ..lexicon import DEFAULT, Lexicon
from ..scale import running

FAN = 1000
# c company; sk/sv company set (0 none, 1 one company, 2 a ranking result); p period; l last period
STATE = "struct<c:string,sk:int,sv:string,py:string,px:string,ly:string,lx:string>"
OUT = "struct<turn:bigint,follow_up:boolean,stock_code:string,metric_key:string,report_period:string,set_kind:int,set_value:string>"


def turn_signals(turns: DataFrame, question: str = "question", lex: Lexicon = DEFAULT, company: str = "stock_code",
                 follow_starts=fv.FOLLOW_UP_STARTS, follow_ends=fv.FOLLOW_UP_ENDINGS) -> DataFrame:
    """What one turn says by itself.  ``company`` holds the code found in its text, or NULL."""
    q = normalize_text(F.col(question))
    t = compact_text(q)
    none = F.lit(False)
    starts, ends = none, none
    for w in follow_starts:
        starts = starts | t.startswith(w)
    for w in follow_ends:
        ends = ends | t.endswith(w)
    metric = Q.detect_metric(q, lex)
    year = F.regexp_extract(t, "(20[0-9]{2})年", 1)
    suffix = F.lit("FY")
    for code, _, words in reversed(fv.QUESTION_PERIODS):
        suffix = F.when(contains_any(t, words), code).otherwise(suffix)
    signals = F.struct(
        F.col(company).alias("company"),
        metric["metric_key"].alias("metric"),
        Q.detect_company_field(q, lex).isNotNull().alias("field"),
        contains_any(t, lex.attribution).alias("attribution"),
        contains_any(t, lex.research).alias("research"),
        contains_any(t, lex.industry).alias("industry"),
        Q.detect_top_k(q).isNotNull().alias("top_k"),
        (contains_any(t, lex.chart) | contains_any(t, lex.trend)).alias("trend"),
        contains_any(t, lex.latest).alias("latest"),
        (contains_any(t, lex.follow_up) | contains_any(t, lex.company_set)).alias("hint"),
        ((F.length(t) <= 8) & ends).alias("short"),
        starts.alias("starts"),
        F.when(year != "", year).alias("year"),
        suffix.alias("suffix"),
    )
    return turns.withColumn("signals", signals)


def _continues(s: Column, t: Column) -> Column:
    """Whether the turn builds on the slots before it."""
    g = t["signals"]
    company, metric = g["company"].isNotNull(), g["metric"].isNotNull()
    had_metric, had_company, had_period = t["metric_before"].isNotNull(), s["c"].isNotNull(), s["py"].isNotNull()
    dated = g["year"].isNotNull()
    return (
        F.when(~(had_company | had_metric | had_period), False)
        .when(g["industry"] & ~company & ~metric & ~g["field"], False)
        .when(g["research"] & ~company, False)
        .when(g["hint"], True)
        .when(g["field"] & ~company, had_company)
        .when(g["attribution"] & ~company, g["starts"])
        .when(metric & ~company & had_company & (g["short"] | dated), True)
        .when(dated & (had_metric | metric) & (g["short"] | ~metric), True)
        .when(company & ~metric & had_metric & (dated | g["attribution"] | g["short"]), True)
        .when(~company & ~metric & ~g["top_k"] & ~g["trend"] & ~g["latest"] & g["short"], True)
        .otherwise(False)
    )


def _resolve(s: Column, t: Column, on: Column) -> dict[str, Column]:
    """Slots after a turn; only tests which slots are filled and copies values."""
    g = t["signals"]
    from_set = F.when(g["hint"] & (s["sk"] == 1), s["sv"])
    company = F.coalesce(g["company"], from_set, F.when(on, s["c"]))
    year = F.coalesce(g["year"], F.when(on, s["py"]))
    use_last = year.isNull() & on
    py = F.when(use_last, s["ly"]).otherwise(year)
    px = F.when(use_last, s["lx"]).otherwise(F.when(year.isNotNull(), g["suffix"]))
    ranked = g["top_k"] & (t["metric_now"].isNotNull())
    sk = F.when(company.isNotNull(), 1).when(ranked, 2).otherwise(s["sk"])
    sv = F.when(company.isNotNull(), company).when(ranked, t["turn"].cast("string")).otherwise(s["sv"])
    return {
        "on": on, "c": company, "sk": sk, "sv": sv, "py": py, "px": px,
        "ly": F.coalesce(py, s["ly"]), "lx": F.coalesce(px, s["lx"]),
    }


def _state(r: dict) -> Column:
    return F.struct(*[r[k].alias(k) for k in ("c", "sk", "sv", "py", "px", "ly", "lx")]).cast(STATE)


def _step(s: Column, t: Column) -> Column:
    return let(_continues(s, t), lambda on: _state(_resolve(s, t, on)))


def _literal_state(c=None, sk=0, sv=None, p=None, last=None) -> Column:
    values = (c, sk, sv, p and f"@{p}y", p and f"@{p}x", last and f"@{last}y", last and f"@{last}x")
    names = ("c", "sk", "sv", "py", "px", "ly", "lx")
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)]).cast(STATE)


# every reachable pattern: (company, set) x (period, last period)
PATTERNS = [
    dict(company, **period)
    for company in ({}, {"sk": 1, "sv": "@s"}, {"sk": 2, "sv": "@s"}, {"c": "@c", "sk": 1, "sv": "@s"})
    for period in ({}, {"last": "l"}, {"p": "p", "last": "l"})
]


def _pattern_of(s: Column) -> Column:
    slot = F.when(s["c"].isNotNull(), 3).otherwise(F.coalesce(s["sk"], F.lit(0)))
    period = F.when(s["py"].isNotNull(), 2).when(s["ly"].isNotNull(), 1).otherwise(0)
    return slot * 3 + period


def _apply(s: Column, summary: Column) -> Column:
    """State after a segment: the outcome for this pattern, placeholders filled in."""
    out = F.get(summary, _pattern_of(s))

    def fill(v):
        return (
            F.when(v == "@c", s["c"]).when(v == "@s", s["sv"])
            .when(v == "@py", s["py"]).when(v == "@px", s["px"])
            .when(v == "@ly", s["ly"]).when(v == "@lx", s["lx"])
            .otherwise(v)
        )

    parts = {k: fill(out[k]) for k in ("c", "sv", "py", "px", "ly", "lx")}
    parts["sk"] = out["sk"]
    return _state(parts)


def _summary(items: Column, step) -> Column:
    starts = F.array(*[_literal_state(**p) for p in PATTERNS])
    return F.transform(starts, lambda s: F.aggregate(items, s, step))


def _starts(units: DataFrame, key: str, fan: int) -> DataFrame:
    """key, idx, start: the state each unit begins with, for units (key, idx, summary)."""
    top = units.agg(F.max("idx")).first()[0]  # one number
    grouped = units.groupBy(key, F.floor(F.col("idx") / fan).alias("parent")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "summary"))).alias("u")  # at most ``fan``
    )
    if top is None or top < fan:
        grouped = grouped.withColumn("start", _literal_state())
    else:
        parents = grouped.select(key, F.col("parent").alias("idx"), _summary(F.col("u"), lambda s, x: _apply(s, x["summary"])).alias("summary"))
        grouped = grouped.join(_starts(parents, key, fan).withColumnRenamed("idx", "parent"), [key, "parent"])
    pair = f"struct<s:{STATE},out:array<struct<idx:bigint,start:{STATE}>>>"
    empty = F.array().cast(f"array<struct<idx:bigint,start:{STATE}>>")

    def walk(acc, x):
        seen = F.array(F.struct(x["idx"].cast("bigint").alias("idx"), acc["s"].alias("start")))
        return F.struct(_apply(acc["s"], x["summary"]).alias("s"), F.concat(acc["out"], seen).alias("out")).cast(pair)

    walked = F.aggregate("u", F.struct(F.col("start").alias("s"), empty.alias("out")).cast(pair), walk)
    return grouped.select(key, F.inline(walked["out"]))


def carry_slots(turns: DataFrame, key: str = "conv_id", fan: int = FAN) -> DataFrame:
    """Slots in force at each turn.  ``turns``: key, turn (dense from 0) and ``signals``.

    Output: key, turn, follow_up, stock_code, metric_key, report_period, set_kind, set_value.
    """
    seen = F.when(F.col("signals.metric").isNotNull(), F.struct("turn", F.col("signals.metric").alias("metric")))
    rows = running(
        turns.select(key, F.col("turn").cast("bigint").alias("turn"), "signals"), [key], ["turn"],
        F.floor(F.col("turn") / 1_000_000), {"_m": ("max", seen)},
    )
    rows = rows.select(
        key, F.floor(F.col("turn") / fan).alias("idx"),
        F.struct(
            "turn", "signals", F.col("_m.metric").alias("metric_before"),
            F.coalesce("signals.metric", "_m.metric").alias("metric_now"),
        ).alias("t"),
    )
    segments = rows.groupBy(key, "idx").agg(F.array_sort(F.collect_list("t"), _by_turn).alias("ts"))  # at most ``fan``
    if (rows.agg(F.max("idx")).first()[0] or 0) == 0:
        segments = segments.withColumn("start", _literal_state())
    else:
        units = segments.select(key, "idx", _summary(F.col("ts"), _step).alias("summary"))
        segments = segments.join(_starts(units, key, fan), [key, "idx"])
    pair = f"struct<s:{STATE},out:array<{OUT}>>"
    empty = F.array().cast(f"array<{OUT}>")

    def after(acc, t, on):
        r = _resolve(acc["s"], t, on)
        row = F.struct(
            t["turn"].alias("turn"), r["on"].alias("follow_up"), r["c"].alias("stock_code"),
            t["metric_now"].alias("metric_key"), F.concat(r["py"], r["px"]).alias("report_period"),
            acc["s"]["sk"].alias("set_kind"), acc["s"]["sv"].alias("set_value"),
        ).cast(OUT)
        return F.struct(_state(r).alias("s"), F.concat(acc["out"], F.array(row)).alias("out")).cast(pair)

    walk = lambda acc, t: let(_continues(acc["s"], t), lambda on: after(acc, t, on))
    walked = F.aggregate("ts", F.struct(F.col("start").alias("s"), empty.alias("out")).cast(pair), walk)
    return segments.select(key, F.inline(walked["out"]))


def _by_turn(a: Column, b: Column) -> Column:
    return F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(0)
