"""Statement fields out of report text, as one batch job.

The label rules are literal patterns compiled once per job.  A document becomes an array of
(rule, number tokens), the array is exploded, and the row layout is read once over the tokens.
Documents: file_path, title, text, stock_code, stock_abbr, report_period, report_date, doc_seq
(dense order of documents) and readable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import numbers as N
from ..functions.periods import allowed_periods
from ..functions.text import compact_text, contains_any, let, quote, split_glued_numbers
from ..session import checkpointed
from .resolution import cumulative

NUMBER = r"(不适用|-?[0-9,]+(?:\.[0-9]+)?%?)"
THOUSANDS = "^-?[0-9][0-9,]*$"  # such a token is a number whatever its commas
STEPS = 10  # candidates of one document keep this order: main rows, quarter series, statement


def spaced(label: str) -> str:
    """Pattern for a label whose characters may be split by blanks."""
    return r"\s*".join(quote(ch) for ch in label)


def any_label(labels) -> str:
    return "(?:" + "|".join(spaced(x) for x in labels) + ")"


def has_label(text: Column, labels) -> Column:
    return text.rlike("(?sU)" + any_label(labels))


def section_after(text: Column, anchors) -> Column:
    """Text from the first anchor on; the whole text when no anchor occurs."""
    found = F.regexp_extract(text, "(?sU)" + any_label(anchors) + ".*", 0)
    return F.when(found == "", text).otherwise(found)


def snippet_after(text: Column, labels, window: int, stops=()) -> Column:
    """Characters after the first label, cut at the first stop label."""
    cut = F.regexp_extract(text, f"(?sU){any_label(labels)}(.{{0,{window}}})", 1)
    if not stops:
        return cut
    # a lookahead inside (?U) keeps Unicode blanks; the lazy group ends at the leftmost stop
    return F.regexp_extract(cut, rf"(?sU)^(.*?)(?={any_label(stops)}|\z)", 1)


def _glue(tokens: Column) -> Column:
    """``merge_broken`` for tokens some of which may be a prefix: what a pair is judged by is read off each token once."""
    def facts(t):
        last = F.element_at(F.split(t, ","), -1)
        return F.struct(
            t.alias("t"), t.rlike(THOUSANDS).alias("prefix"), (t.contains(",") & (F.length(last) < 3)).alias("short"),
            (t.contains(".") & ~t.endswith("%") & N.plain_number(t).isNotNull()).alias("rest"),
            t.rlike("^[+-]*,").alias("comma"), t.rlike("^[+-]*[0-9]").alias("digit"),
        )

    none = F.lit(None).cast("struct<t:string,prefix:boolean,short:boolean,rest:boolean,comma:boolean,digit:boolean>")
    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("held"))

    def step(acc, x):
        held = acc["held"]
        glue = F.coalesce(held["prefix"] & x["rest"] & (x["comma"] | (x["digit"] & held["short"])), F.lit(False))
        done = (
            F.when(glue, F.concat(acc["done"], F.array(F.concat(held["t"], x["t"]))))
            .when(held["t"].isNotNull(), F.concat(acc["done"], F.array(held["t"])))
            .otherwise(acc["done"])
        )
        return F.struct(done.alias("done"), F.when(~glue, x).alias("held"))

    end = lambda acc: F.when(acc["held"]["t"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["held"]["t"])))
    return F.aggregate(F.transform(tokens, facts), start, step, end)


def merge_broken(tokens: Column) -> Column:
    """Join a thousands prefix with the decimal rest that a line break split off."""
    has_prefix = lambda ts: F.coalesce(F.exists(ts, lambda t: t.rlike(THOUSANDS)), F.lit(False))
    return let(tokens, lambda ts: F.when(has_prefix(ts), _glue(ts)).otherwise(F.array_compact(ts)))


def number_tokens(snippet: Column, limit: int = 8) -> Column:
    found = F.regexp_extract_all(split_glued_numbers(snippet), F.lit(NUMBER), F.lit(1))
    return F.slice(merge_broken(found), 1, limit)


def _reading(tokens: Column) -> Column:
    """Tokens with their value, and whether they can stand for a growth figure."""
    def one(t):
        plain = F.translate(t, ",", "").rlike(r"^-?[0-9]+(\.[0-9]+)?$") & ~t.rlike("^20[0-9]{2}$")
        grows = lambda v: (t == fv.NOT_APPLICABLE) | t.endswith("%") | ((F.abs(v) <= 1000) & plain)
        return let(N.plain_number(t), lambda v: F.struct(
            v.alias("v"), F.coalesce(grows(v), F.lit(False)).alias("g"), t.endswith("%").alias("p")))

    return F.transform(tokens, one)


def _at(i: int, name: str) -> Column:
    return F.get("_r", i)[name]


def _row(**values) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in values.items()])


def read_annual(df: DataFrame, tokens: str, name: str = "row") -> DataFrame:
    """Adds struct(current, previous, previous2, yoy): the three-year layouts of an annual row."""
    rows = df.withColumn("_r", _reading(F.col(tokens)))
    n, null = F.size("_r"), F.lit(None).cast("double")
    v, g = (lambda i: _at(i, "v")), (lambda i: _at(i, "g"))
    num = lambda *idx: reduce(lambda a, b: a & b, [v(i).isNotNull() for i in idx])
    # first run of number, number, growth, number
    places = F.when(n >= 4, F.sequence(F.lit(0), n - 4)).otherwise(F.array().cast("array<int>"))
    runs = F.filter(places, lambda i: (
        F.get("_r", i)["v"].isNotNull() & F.get("_r", i + 1)["v"].isNotNull()
        & F.get("_r", i + 2)["g"] & F.get("_r", i + 3)["v"].isNotNull()
    ))
    rows = rows.withColumn("_q", F.get(runs, 0))
    q = lambda k: F.get("_r", F.col("_q") + k)["v"]
    raw = (
        F.when((n >= 6) & num(0, 1, 2, 4, 5) & g(3), _row(current=v(0), previous=v(2), previous2=v(5), yoy=v(3)))
        .when(F.col("_q").isNotNull(), _row(current=q(0), previous=q(1), previous2=q(3), yoy=q(2)))
        .when((n >= 4) & _at(2, "p"), _row(current=v(0), previous=v(1), previous2=v(3), yoy=v(2)))
        .when(n >= 6, _row(current=v(0), previous=v(2), previous2=v(5), yoy=v(3)))
        .when(n >= 4, _row(current=v(0), previous=v(1), previous2=v(3), yoy=v(2)))
        .when(n >= 3, _row(current=v(0), previous=v(1), previous2=null, yoy=v(2)))
        .when(n >= 2, _row(current=v(0), previous=v(1), previous2=null, yoy=null))
        .otherwise(_row(current=null, previous=null, previous2=null, yoy=null))
    )
    rows = rows.withColumn("_raw", raw)
    r = F.col("_raw")
    yoy = F.when(n >= 3, N.annual_growth(r["current"], r["previous"], r["yoy"]))
    out = _row(current=r["current"], previous=r["previous"], previous2=r["previous2"], yoy=yoy)
    return rows.withColumn(name, out).drop("_r", "_q", "_raw")


def read_periodic(df: DataFrame, tokens: str, name: str = "row") -> DataFrame:
    """Adds struct(current, current_yoy, ytd, ytd_yoy): the layouts of an interim row."""
    rows = df.withColumn("_r", _reading(merge_broken(F.col(tokens))))
    n, null = F.size("_r"), F.lit(None).cast("double")
    v, g = (lambda i: _at(i, "v")), (lambda i: _at(i, "g"))
    num = lambda *idx: reduce(lambda a, b: a & b, [v(i).isNotNull() for i in idx])
    both = lambda a, b: _row(current=a, current_yoy=b, ytd=a, ytd_yoy=b)
    near = lambda i: F.abs(v(i)) > F.abs(v(0)) * 0.2
    four = _row(current=v(0), current_yoy=v(1), ytd=v(2), ytd_yoy=v(3))
    out = (
        F.when((n >= 8) & num(0, 1, 2, 4, 5, 6) & g(3) & g(7), _row(current=v(0), current_yoy=v(3), ytd=v(4), ytd_yoy=v(7)))
        .when((n >= 4) & num(0, 1, 2) & g(3) & (v(0) != 0) & near(1) & near(2), both(v(0), v(3)))
        .when((n >= 4) & num(0, 2) & g(1) & g(3), four)
        .when((n >= 4) & num(0, 1, 2, 3) & (F.abs(v(2)) > F.abs(v(0)) * 1.05), four)
        .when((n >= 3) & num(0, 1) & g(2), both(v(0), v(2)))
        .when((n >= 2) & num(0) & g(1), both(v(0), v(1)))
        .when((n >= 1) & num(0), both(v(0), null))
        .otherwise(both(null, null))
    )
    return rows.withColumn(name, out).drop("_r")


def quarter_values(tokens: Column) -> Column:
    """Plain numbers in their order: no percentages, no years."""
    kept = F.filter(tokens, lambda t: ~t.endswith("%") & ~t.rlike("^20[0-9]{2}$"))
    return F.array_compact(F.transform(kept, N.plain_number))


def period_pick(period: Column, row: Column, what: str) -> Column:
    """Third and fourth quarter reports give year-to-date first, others the period itself."""
    now, ytd = (row["current"], row["ytd"]) if what == "value" else (row["current_yoy"], row["ytd_yoy"])
    return F.when(period.rlike("(Q3|Q4)$"), F.coalesce(ytd, now)).otherwise(F.coalesce(now, ytd))


def document_priority(title: Column, text: Column) -> Column:
    probe = compact_text(F.concat(F.coalesce(title, F.lit("")), F.substring(text, 1, 400)))
    bonus = lambda p, words, n: F.when(contains_any(p, words), n).otherwise(0)
    return let(probe, lambda p: bonus(p, fv.REPORT_TITLE_WORDS, 10) + bonus(p, fv.SUMMARY_WORDS, -5) + bonus(p, fv.REVISED_WORDS, 2))


DOC = ["stock_code", "stock_abbr", "report_period", "report_date", "file_path", "doc_seq", "doc_priority"]


def _rule_rows(docs: DataFrame, section: str, rules) -> DataFrame:
    """One row per document and rule: ``rule`` number and ``tokens``."""
    items = [
        F.struct(F.lit(i).alias("rule"), snippet_after(F.col(section), labels, window, fv.ROW_STOP_LABELS).alias("snippet"))
        for i, (labels, window) in enumerate(rules)
    ]
    rows = docs.select(*DOC, F.inline(F.array(*items))).filter(F.col("snippet") != "")
    return rows.withColumn("tokens", number_tokens(F.col("snippet"))).drop("snippet")


def _targets(rules) -> Column:
    """rule number -> array of (table, value field, growth field, unit)."""
    return F.array(*[
        F.array(*[
            F.struct(F.lit(t).alias("table_name"), F.lit(f).alias("field"), F.lit(g).cast("string").alias("growth_field"), F.lit(unit).alias("unit"))
            for t, f, g in targets
        ])
        for unit, targets in rules
    ])


def _as_candidates(rows: DataFrame, bonus: int, step: int, mode: str, excerpt: str) -> DataFrame:
    """rows: DOC, targets, value, yoy -> candidate rows for values and growth figures."""
    t = rows.select(*DOC, "value", "yoy", F.explode("targets").alias("t"))
    money = F.when(F.col("t.unit") == "money", N.money_to_10k(F.col("value"))).otherwise(F.col("value"))
    cell = lambda f, v: F.struct(f.alias("field_name"), v.alias("value"))
    out = t.select(*DOC, F.col("t.table_name").alias("table_name"), F.explode(F.array(
        cell(F.col("t.field"), money), cell(F.col("t.growth_field"), F.col("yoy"))
    )).alias("c"))
    return out.filter(F.col("c.field_name").isNotNull() & F.col("c.value").isNotNull()).select(
        "table_name", "stock_code", "stock_abbr", "report_period", "report_date", "c.field_name", "c.value",
        (F.col("doc_priority") + bonus).alias("priority"),
        (F.col("doc_seq") * STEPS + step).alias("seq"),
        F.lit(mode).alias("mode"), F.col("file_path").alias("source_file"), F.lit(excerpt).alias("source_excerpt"),
    )


def annual_candidates(docs: DataFrame, rules=fv.ANNUAL_RULES, anchors=fv.ANNUAL_ANCHORS) -> DataFrame:
    d = docs.filter(F.col("report_period").endswith("FY")).withColumn("_section", section_after(F.col("text"), anchors))
    rows = read_annual(_rule_rows(d, "_section", [(r[0], r[1]) for r in rules]), "tokens")
    r = F.col("row")
    rows = rows.select(
        *DOC, F.get(_targets([(r_[2], r_[3]) for r_ in rules]), F.col("rule")).alias("targets"),
        r["current"].alias("value"), F.coalesce(r["yoy"], N.growth(r["current"], r["previous"])).alias("yoy"),
    )
    return _as_candidates(rows, 20, 0, "last", fv.ANNUAL_EXCERPT)


def periodic_candidates(docs: DataFrame, rules=fv.PERIODIC_RULES, anchors=fv.PERIODIC_ANCHORS) -> DataFrame:
    d = docs.filter(~F.col("report_period").endswith("FY")).withColumn("_section", section_after(F.col("text"), anchors))
    rows = _rule_rows(d, "_section", [(r[0], r[1]) for r in rules])
    rows = read_annual(read_periodic(rows, "tokens", "interim"), "tokens", "annual")
    layouts = F.array(*[F.lit(r[3]) for r in rules])
    interim = F.get(layouts, F.col("rule")) == "periodic"
    p = F.col("report_period")
    rows = rows.select(
        *DOC, F.get(_targets([(r[2], r[4]) for r in rules]), F.col("rule")).alias("targets"),
        F.when(interim, period_pick(p, F.col("interim"), "value")).otherwise(F.col("annual.current")).alias("value"),
        F.when(interim, period_pick(p, F.col("interim"), "growth")).alias("yoy"),
    )
    return _as_candidates(rows, 30, 0, "last", fv.PERIODIC_EXCERPT)


def profit_candidates(docs: DataFrame, anchors=fv.PROFIT_ANCHORS, labels=fv.PROFIT_LABELS, stops=fv.PROFIT_STOP_LABELS) -> DataFrame:
    """Total profit from the income statement itself; only documents that have one."""
    d = docs.filter(has_label(F.col("text"), anchors))
    tokens = number_tokens(snippet_after(section_after(F.col("text"), anchors), labels, 240, stops), 6)
    # no filter on the numbers, which the optimizer would read twice: a document without any gives no candidate
    d = d.withColumn("_v", F.array_compact(F.transform(tokens, N.plain_number)))
    now, before = F.get("_v", 0), F.get("_v", 1)
    target = _targets([("money", (("income_sheet", "total_profit", "total_profit_yoy_growth"),))])
    rows = d.select(*DOC, F.get(target, 0).alias("targets"), now.alias("value"), N.growth(N.money_to_10k(now), N.money_to_10k(before)).alias("yoy"))
    return _as_candidates(rows, 40, 2, "last", fv.PROFIT_EXCERPT)


def quarter_series(docs: DataFrame, rules=fv.QUARTER_RULES, anchors=fv.QUARTER_ANCHORS) -> DataFrame:
    """Year-to-date series out of the quarter table of an annual report."""
    d = docs.filter(F.col("report_period").endswith("FY") & has_label(F.col("text"), anchors))
    section = section_after(F.col("text"), anchors)
    items = [
        F.struct(
            F.lit(table).alias("table_name"), F.lit(field).alias("field_name"), F.lit(excerpt).alias("source_excerpt"),
            snippet_after(section, labels, 420, fv.ROW_STOP_LABELS).alias("snippet"),
        )
        for labels, table, field, excerpt in rules
    ]
    rows = d.select(*DOC, F.inline(F.array(*items))).filter(F.col("snippet") != "")
    rows = rows.withColumn("tokens", number_tokens(F.col("snippet"), 12))
    rows = rows.withColumn("_v", quarter_values(merge_broken(F.col("tokens"))))
    year = F.substring("report_period", 1, 4)
    points = F.array(*[
        F.struct(F.concat(year, F.lit(p)).alias("report_period"), N.money_to_10k(v).alias("value"))
        for p, v in zip(("Q1", "HY", "Q3", "FY"), cumulative([F.get("_v", i) for i in range(4)]))
    ])
    out = rows.withColumn("year", year).withColumn("points", F.filter(points, lambda x: x["value"].isNotNull()))
    return out.select(
        "table_name", "stock_code", "stock_abbr", "report_date", "field_name", "year", F.col("doc_seq").alias("doc"),
        # 20 below the annual rows of the document, never below zero
        F.greatest(F.lit(0), F.col("doc_priority")).alias("priority"),
        (F.col("doc_seq") * STEPS + 1).alias("seq"), F.lit("reasonable").alias("mode"),
        F.col("file_path").alias("source_file"), "source_excerpt",
        # an inner explode puts a filter on ``points`` below the tokens, with a copy of their reading for each use
        F.explode_outer("points").alias("p"),
    ).filter(F.col("p").isNotNull()).select("*", "p.report_period", "p.value").drop("p")


def extract(docs: DataFrame) -> DataFrame:
    """All candidates of a document table, with quarter series that contradict the annual
    figure held when they arrive left out."""
    from .resolution import usable, veto_series

    d = docs.filter(
        F.col("readable") & (F.coalesce("stock_code", F.lit("")) != "") & (F.coalesce("report_period", F.lit("")) != "")
    ).withColumn("doc_priority", document_priority(F.col("title"), F.col("text")))
    # candidates are small next to the texts and read several times: parse each text once
    main = checkpointed(usable(annual_candidates(d).unionByName(periodic_candidates(d))))
    series = veto_series(checkpointed(quarter_series(d)), main).drop("year", "doc")
    return main.unionByName(checkpointed(usable(profit_candidates(d).unionByName(series))))


def within_allowed_periods(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows whose period some report of the company may fill."""
    allowed = docs.filter((F.col("stock_code") != "") & (F.col("report_period") != "")).select(
        "stock_code", F.explode(allowed_periods(F.col("report_period"))).alias("report_period")
    ).distinct()
    return rows.join(allowed, ["stock_code", "report_period"], "left_semi")


def with_metric_values(sheet: DataFrame, metrics) -> DataFrame:
    return sheet.filter(F.coalesce(*[F.col(m) for m in metrics]).isNotNull())


def raw_numbers(text: Column) -> Column:
    """All number tokens of a text, as printed."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
