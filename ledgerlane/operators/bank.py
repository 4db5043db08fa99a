"""Question bank: loading, matching to ids, template expansion and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.questions import payload_questions
from ..functions.text import normalize_text
from .chunking import fill_template


def normalized_questions(payload: Column) -> Column:
    return F.filter(F.transform(payload_questions(payload), normalize_text), lambda q: q != "")


def display_text(payload: Column) -> Column:
    q = normalized_questions(payload)
    return F.when(F.size(q) > 0, F.array_join(F.slice(q, 1, 2), " / ")).otherwise(normalize_text(payload))


def load_bank(rows: DataFrame, order=("source_file", "row_seq")) -> DataFrame:
    """First record of each (id, type, payload); ``order`` says which file and row come first."""
    keys = ["question_id", "question_type", "question_payload"]
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("f"))
    return first.select(*keys, *[F.col(f"f.{c}").alias(c) for c in rest])


def match_question_ids(payloads: DataFrame, bank: DataFrame) -> DataFrame:
    """Bank id of a payload: same question list (smallest id), else the current id if it holds
    the question, else the only bank entry that holds it.

    ``payloads``: payload and current_id.  Each distinct payload is looked up once; both lookups
    are equi-joins on a side with one row per key.
    """
    asked = payloads.select("payload").distinct().withColumn("_q", normalized_questions(F.col("payload")))
    known = bank.filter((F.col("question_id") != "") & (F.col("question_payload") != "")).select(
        "question_id", normalized_questions(F.col("question_payload")).alias("_q")
    )
    exact = known.groupBy(F.to_json("_q").alias("_list")).agg(F.min("question_id").alias("_exact"))
    parts = known.select("question_id", F.explode(F.array_distinct("_q")).alias("_one")).distinct()
    single = parts.groupBy("_one").agg(F.min("question_id").alias("_only"), F.countDistinct("question_id").alias("_n"))
    found = (
        asked.withColumn("_list", F.to_json("_q"))
        .withColumn("_one", F.when(F.size("_q") == 1, F.get("_q", 0)))
        .join(exact, "_list", "left").join(single, "_one", "left")
        .select("payload", F.when(F.size("_q") > 0, F.col("_exact")).alias("_exact"), "_one", "_only", "_n")
    )
    out = payloads.join(found, "payload", "left")
    holds = parts.select(F.col("question_id").alias("current_id"), "_one", F.lit(True).alias("_holds"))
    out = out.join(holds, ["current_id", "_one"], "left")
    matched = F.coalesce(
        "_exact", F.when(F.col("_holds"), F.col("current_id")), F.when(F.col("_n") == 1, F.col("_only"))
    )
    return out.select(*payloads.columns, matched.alias("question_id"))


def expand_templates(companies: DataFrame, years: DataFrame, metric_keys: DataFrame, templates=fv.QUESTION_TEMPLATES,
                     labels=None, default_year: str = "2024", json_lists: bool = True) -> DataFrame:
    """All template questions for each company, with its latest year and the metrics it has.

    ``years``: stock_code, latest_year.  ``metric_keys``: stock_code, keys (array).  The template
    list is a short constant, so it is inlined per company instead of joined.
    """
    labels = labels or fv.TEMPLATE_LABELS

    def metric_label(options):
        out = F.lit(labels[options[0]])
        for key in reversed(options):
            out = F.when(F.array_contains("keys", key), F.lit(labels[key])).otherwise(out)
        return out

    c = companies.join(years, "stock_code", "left").join(metric_keys, "stock_code", "left").select(
        "stock_code",
        F.coalesce(F.nullif("stock_abbr", F.lit("")), F.col("company_name")).alias("company"),
        F.coalesce(F.col("latest_year").cast("string"), F.lit(default_year)).alias("year"),
        F.coalesce("keys", F.array().cast("array<string>")).alias("keys"),
    )
    c = c.withColumns({slot: metric_label(options) for slot, options in fv.TEMPLATE_METRICS.items()})
    slots = ["company", "year", *fv.TEMPLATE_METRICS]
    counts: dict[str, int] = {}
    rows = []
    for declared, title, questions in templates:
        counts[declared] = counts.get(declared, 0) + 1
        place = fv.QUESTION_LABELS.index(declared) + 1 if declared in fv.QUESTION_LABELS else 9
        texts = [normalize_text(fill_template(q, slots)) for q in questions]
        payload = texts[0] if len(texts) == 1 or not json_lists else F.to_json(F.array(*[F.struct(t.alias("Q")) for t in texts]))
        rows.append(F.struct(
            F.lit(f"SYS{place}{counts[declared]:03d}").alias("question_id"), F.lit(declared).alias("question_type"),
            F.lit(title).alias("title"), payload.alias("question_payload"),
        ))
    return c.select("stock_code", F.inline(F.array(*rows)))


def assemble_bank(system: DataFrame, official: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """System, official and custom questions with their scope; official ones once per (id, payload)."""
    cols = ["question_id", "question_type", "question_payload"]
    clean = official.select(*[normalize_text(F.col(c)).alias(c) for c in cols]).filter(F.col("question_payload") != "")
    once = clean.groupBy("question_id", "question_payload").agg(F.min("question_type").alias("question_type"))
    parts = [(fv.SCOPES[0], system.select(*cols)), (fv.SCOPES[1], once.select(*cols))]
    if custom is not None:
        parts.append((fv.SCOPES[2], custom.select(*cols).filter(F.trim("question_payload") != "")))
    tagged = [df.withColumn("scope", F.lit(s)).withColumn("scope_order", F.lit(i)) for i, (s, df) in enumerate(parts)]
    return reduce(DataFrame.unionByName, tagged).withColumn("display", display_text(F.col("question_payload")))


def sample_questions(bank: DataFrame, k: int = 8) -> DataFrame:
    """First k distinct displays, system questions first."""
    rows = bank.filter((F.col("display") != "") & (F.col("scope_order") < 2))
    first = rows.groupBy("display").agg(F.min(F.struct("scope_order", "question_id")).alias("first"))
    top = first.orderBy("first", "display").limit(k)
    return top.select(F.row_number().over(Window.orderBy("first", "display")).alias("position"), "display")  # k rows


def company_years(facts: DataFrame) -> DataFrame:
    year = F.regexp_extract("report_period", "(20[0-9]{2})", 1).try_cast("int")
    return facts.groupBy("stock_code").agg(F.max(year).alias("latest_year"))


def company_metric_keys(facts: DataFrame) -> DataFrame:
    """Metric keys per company; a set bounded by the catalog."""
    return facts.groupBy("stock_code").agg(F.array_sort(F.collect_set("metric_key")).alias("keys"))
