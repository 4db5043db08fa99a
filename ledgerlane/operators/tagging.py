"""Tags for a whole table of questions; every tag is a column, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import questions as Q
from ..functions.periods import question_period
from ..functions.text import compact_text, contains_any, normalize_text
from ..lexicon import DEFAULT, Lexicon
from ..session import checkpointed


def has(array: Column, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.array_contains(array, n)
    return out


def tag_questions(df: DataFrame, question: str = "question", lex: Lexicon = DEFAULT) -> DataFrame:
    """Adds canonical text, slots, flags, intents, fragments, mode, pipeline and subtasks."""
    c = F.col
    out = df.withColumn("canonical", Q.canonical_question(c(question), lex)).withColumn("compact", compact_text(c("canonical")))
    # intents and fragments read the text as rewritten once more: an added phrase can call for another
    out = out.withColumn("_again", Q.canonical_question(c("canonical"), lex))
    t, plain = c("compact"), compact_text(c(question))
    out = out.withColumns({
        "metric": Q.detect_metric(normalize_text(c(question)), lex),
        "company_field": Q.detect_company_field(normalize_text(c(question)), lex),
        "period": question_period(c(question)),
        "top_k": Q.detect_top_k(c("canonical")),
        "intents": Q.intents(c("_again"), lex),
        "fragments": Q.fragments(c("_again"), lex),
        "wants_chart": contains_any(t, lex.chart),
        "wants_trend": Q.trend_requested(t, lex),
        "wants_attribution": contains_any(t, lex.attribution),
        "wants_research": contains_any(t, lex.research),
        "wants_latest": contains_any(t, lex.latest),
        "industry_query": contains_any(t, lex.industry),
        "product_query": contains_any(t, lex.industry) & contains_any(t, lex.product),
        "listing_compare": Q.listing_compare(t, lex),
        "threshold_then_extreme": Q.threshold_then_extreme(t, lex),
        "product_list": _all_groups(plain, lex.product_groups),
    })
    out = out.withColumn("cross_company", c("top_k").isNotNull() | contains_any(plain, lex.cross_company))
    out = out.withColumn("pipeline", _pipeline()).withColumn("subtasks", _subtasks(lex))
    return out.withColumn(
        "multi_intent", (F.size("subtasks") > 1) | (F.size("intents") > 1) | (F.size("fragments") > 1)
    ).drop("_again")


def _all_groups(t: Column, groups) -> Column:
    out = F.lit(True)
    for g in groups:
        out = out & contains_any(t, g)
    return out


def _pipeline() -> Column:
    i = F.col("intents")
    return (
        F.when(has(i, "ranking", "yoy", "maxmin"), "ranking_yoy_max_pipeline")
        .when(has(i, "trend", "attribution"), "trend_then_attribution")
        .when(F.size("fragments") > 1, "fragment_split")
        .when(F.col("threshold_then_extreme"), "threshold_then_extreme")
        .when(F.col("listing_compare"), "list_then_compare")
        .otherwise("single_intent")
    )


def _subtasks(lex: Lexicon) -> Column:
    whole = F.col("canonical")
    step = lambda intent, q: F.struct(intent.alias("intent"), q.alias("question"))
    named = lambda *names: F.array(*[step(F.lit(n), whole) for n in names])

    def part(f):
        i, t = Q.intents(Q.canonical_question(f, lex), lex), compact_text(f)
        intent = (
            F.when(has(i, "attribution") & contains_any(t, lex.attribution), "attribution")
            .when(has(i, "trend") & (F.col("wants_chart") | Q.trend_requested(t, lex)), "trend")
            .otherwise(F.coalesce(F.get(i, 0), F.lit("single_value")))
        )
        return step(intent, f)

    first = F.coalesce(F.get("intents", 0), F.when(F.col("metric").isNotNull(), "single_value").otherwise("retrieval"))
    p = F.col("pipeline")
    return (
        F.when(p == "ranking_yoy_max_pipeline", named("ranking", "yoy", "maxmin"))
        .when(p == "trend_then_attribution", named("trend", "attribution"))
        .when(p == "fragment_split", F.transform("fragments", part))
        .when(p == "threshold_then_extreme", named("ranking", "maxmin"))
        .when(p == "list_then_compare", named("ranking", "yoy"))
        .otherwise(F.array(step(first, whole)))
    )


def query_mode(has_company: Column) -> Column:
    """How a tagged question (with its company known or not) is answered."""
    c = F.col
    return (
        F.when(c("company_field").isNotNull(), "company_profile")
        .when(c("wants_research"), "research")
        .when(c("industry_query"), "industry_lookup")
        .when(c("wants_attribution"), "attribution")
        .when(c("top_k").isNotNull() | c("listing_compare") | c("threshold_then_extreme"), "ranking")
        .when(c("wants_trend"), "trend")
        .when(has_company | c("metric").isNotNull(), "structured")
        .otherwise("retrieval")
    )


def clarification(has_company: Column, n_periods: Column) -> Column:
    """What a question still lacks: company, metric or period; NULL when it can be answered.

    Expects tagged columns, ``query_mode`` and the number of periods known for the company.
    """
    c = F.col
    metric, mode = c("metric").isNotNull(), c("query_mode")
    open_world = c("industry_query") | c("wants_research")
    return (
        F.when(
            ~has_company & metric & ~c("cross_company") & ~open_world
            & (mode.isin("attribution", "trend") | ~c("wants_latest")),
            "missing_company",
        )
        .when(~has_company & c("wants_attribution") & ~c("industry_query"), "missing_company")
        .when(has_company & ~metric & c("company_field").isNull() & (mode == "structured") & ~open_world, "missing_metric")
        .when(
            has_company & metric & (mode == "structured") & c("period").isNull() & ~c("wants_trend")
            & c("top_k").isNull() & ~c("wants_latest") & (F.coalesce(n_periods, F.lit(0)) > 1),
            "missing_period",
        )
    )


def question_labels(df: DataFrame, payload: str = "payload", declared: Column | None = None,
                    manual: Column | None = None, lex: Lexicon = DEFAULT) -> DataFrame:
    """Adds ``labels`` (controlled, fixed order) and ``primary_label`` for a payload column."""
    asked = F.filter(F.transform(Q.payload_questions(F.col(payload)), normalize_text), lambda q: q != "")
    out = df.withColumn("_asked", asked)
    text = F.when(F.size("_asked") > 0, F.array_join("_asked", " ")).otherwise(normalize_text(F.col(payload)))
    out = tag_questions(out.withColumn("_text", normalize_text(text)), "_text", lex)
    t = F.col("_text")
    multi = (F.size("_asked") > 1) | F.col("multi_intent")
    validation, cause = contains_any(t, lex.label_validation), contains_any(t, lex.label_cause)
    opinion, fusion = contains_any(t, lex.label_open), contains_any(t, lex.label_fusion)
    analysis = (
        contains_any(t, lex.label_analysis) | F.lower(t).rlike(r"(?U)top\s*\d+") | t.rlike(fv.LABEL_TREND_YEARS)
        | (F.size(F.array_intersect("intents", F.array(*[F.lit(i) for i in fv.INTENTS if i != "single_value"]))) > 0)
        | validation | cause | opinion | fusion
    )
    vague = ~analysis & ~t.rlike("20[0-9]{2}") & contains_any(t, lex.label_ambiguous)
    fused = fusion | ((multi | contains_any(t, fv.LABEL_SOURCE_WORDS)) & (cause | opinion))
    flags = dict(zip(fv.QUESTION_LABELS, (~analysis, analysis, multi, vague, cause, opinion, fused, validation)))
    given = F.array(declared if declared is not None else F.lit(None).cast("string"))
    if manual is not None:
        given = F.concat(given, F.coalesce(manual, F.array().cast("array<string>")))
    given = F.transform(given, normalize_text)
    labels = F.array_compact(F.array(*[F.when(on | F.array_contains(given, name), F.lit(name)) for name, on in flags.items()]))
    out = out.withColumn("ambiguous", vague).withColumn("labels", labels)
    named = normalize_text(declared) if declared is not None else F.lit("")
    known = F.array(*[F.lit(x) for x in fv.QUESTION_LABELS])
    first = F.get(F.array_intersect(F.array(*[F.lit(x) for x in fv.PRIMARY_LABELS]), F.col("labels")), 0)
    primary = F.when(F.array_contains(known, named), named).otherwise(F.coalesce(first, F.lit(fv.QUESTION_LABELS[0])))
    return out.withColumn("primary_label", primary).drop("_asked", "_text")


def label_counts(tagged: DataFrame, labels: str = "labels") -> DataFrame:
    """Questions per label, in the fixed label order."""
    order = F.array(*[F.lit(x) for x in fv.QUESTION_LABELS])
    # a written table keeps the filters of the explode from being evaluated through all tag columns
    rows = checkpointed(tagged.select(labels))
    return (
        rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.array_contains(order, F.col("label")))
        .orderBy(F.array_position(order, F.col("label")))
    )
