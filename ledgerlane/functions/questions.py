"""Columns read off a question text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..lexicon import DEFAULT, Lexicon
from ..operators.matching import longest_in_list
from .text import compact_text, contains_any, let, normalize_text, quote, text_or_empty


def payload_questions(raw: Column) -> Column:
    """Questions of a payload: a JSON array of {"Q": ...} or strings, else the text itself.

    Elements of other shapes are dropped; text that is not valid JSON is one question.
    """
    text = F.regexp_replace(text_or_empty(raw), r"(?U)^\s+|\s+$", "")
    parsed = F.try_parse_json(text)
    items = F.try_variant_get(parsed, "$", "array<variant>")
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    def one(v):
        kind = F.schema_of_variant(v)
        asked = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(
            kind.startswith("OBJECT"), F.try_variant_get(v, "$.Q", "string")
        )
        return strip(asked)

    from_json = F.filter(F.transform(items, one), lambda q: q.isNotNull())
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(text.startswith("[") & items.isNotNull(), from_json)
        .otherwise(F.array(text))
    )


def detect_metric(question: Column, lex: Lexicon = DEFAULT) -> Column:
    """struct(table_name, metric_key, metric_label) of the longest metric alias contained."""
    hit = longest_in_list(question, lex.metric_aliases)
    return F.when(hit.isNotNull(), F.struct(
        hit["_1"].alias("table_name"), hit["_2"].alias("metric_key"), hit["_3"].alias("metric_label")
    ))


def detect_company_field(question: Column, lex: Lexicon = DEFAULT) -> Column:
    hit = longest_in_list(question, lex.company_fields)
    return F.when(hit.isNotNull(), F.struct(hit["_1"].alias("field_name"), hit["_2"].alias("field_label")))


def detect_top_k(question: Column) -> Column:
    t = F.lower(question)
    found = [F.regexp_extract(t, p, 1) for p in (r"(?U)top\s*([0-9]+)", r"(?U)前\s*([0-9]+)")]
    return F.coalesce(*[F.when(x != "", x.try_cast("int")) for x in found])


def canonical_question(question: Column, lex: Lexicon = DEFAULT) -> Column:
    """Normalised text with set phrases unified and known intents spelled out at the end.

    No added phrase contains another, so each is decided on the text before any is added.
    """
    def unify(text, rules):
        if not rules:
            return text
        phrase, unless, instead = rules[0]
        swap = lambda t: F.when(
            t.contains(phrase) & ~t.contains(unless), F.replace(t, F.lit(phrase), F.lit(instead))
        ).otherwise(t)
        return unify(let(text, swap), rules[1:])

    def extend(text, compact):
        added = [F.when(~text.contains(extra) & compact.rlike(pattern), F.lit(extra)) for pattern, extra in lex.rewrites]
        return normalize_text(F.concat_ws(" ", text, *added))

    return let(normalize_text(question), lambda text: let(
        unify(text, fv.SET_PHRASES), lambda unified: let(F.lower(compact_text(text)), lambda c: extend(unified, c))
    ))


def trend_requested(compact: Column, lex: Lexicon = DEFAULT) -> Column:
    return contains_any(compact, lex.chart) | contains_any(compact, lex.trend) | compact.rlike(lex.trend_years)


def fragments(canonical: Column, lex: Lexicon = DEFAULT) -> Column:
    """The question cut into askable parts, in order and without repeats."""
    none = F.array().cast("array<string>")
    kept = lambda arr: F.filter(F.transform(arr, normalize_text), lambda p: p != "")
    # a match can always start with its line: without the anchor a text that has none is scanned again from every character
    draw = "(?m)^(.+?(?:" + "|".join(fv.DRAW_WORDS) + "))(?:" + "|".join(fv.THEN_WORDS) + ")(.+)"
    connectors = sorted(lex.connectors, key=lambda w: -len(w))
    cause = "|".join(quote(w) for w in lex.attribution) or "(?!)"

    def by_connector(part, words):
        """Pieces around the longest connector that leaves at least two."""
        if not words:
            return F.array(part)
        rest = by_connector(part, words[1:])
        return let(
            F.when(part.contains(words[0]), kept(F.split(part, quote(words[0])))).otherwise(none),
            lambda pieces: F.when(F.size(pieces) >= 2, pieces).otherwise(rest),
        )

    def cut(part):
        # drawing and explaining: only the matched span is kept
        drawn = kept(F.array(F.regexp_extract(part, draw, 1), F.regexp_extract(part, draw, 2)))
        lead = normalize_text(F.regexp_extract(part, f"^(?!(?:{cause}))(.+?)(?:{cause})", 1))
        both = let(compact_text(part), lambda t: trend_requested(t, lex) & contains_any(t, lex.attribution))
        plain = by_connector(part, connectors)
        explained = let(lead, lambda x: F.when(both & (x != ""), F.array(x, part)).otherwise(plain))
        return let(drawn, lambda x: F.when(F.size(x) > 1, x).otherwise(explained))

    parts = F.flatten(F.transform(kept(F.split(canonical, "[，？。]")), cut))
    return let(parts, lambda p: (
        F.when(canonical == "", none).when(F.size(p) == 0, F.array(canonical)).otherwise(F.array_distinct(p))
    ))


def listing_compare(compact: Column, lex: Lexicon = DEFAULT) -> Column:
    return (contains_any(compact, lex.listing) | contains_any(compact, lex.company_set)) & (
        contains_any(compact, lex.compare) | contains_any(compact, lex.yoy)
    )


def threshold_then_extreme(compact: Column, lex: Lexicon = DEFAULT) -> Column:
    return contains_any(compact, lex.threshold) & contains_any(compact, lex.maximum + lex.minimum)


def intents(canonical: Column, lex: Lexicon = DEFAULT) -> Column:
    """Intents in fixed order, for a canonical question."""
    def found(text, t):
        extreme = contains_any(t, lex.maximum + lex.minimum)
        yoy = contains_any(t, lex.yoy)
        compare, bounded = listing_compare(t, lex), threshold_then_extreme(t, lex)
        flags = {
            "ranking": detect_top_k(text).isNotNull() | contains_any(t, lex.ranking) | compare | bounded
            | (contains_any(t, lex.listing) & (yoy | extreme)),
            "yoy": yoy | contains_any(t, lex.max_growth) | compare,
            "maxmin": extreme | contains_any(t, lex.max_growth) | bounded,
            "trend": trend_requested(t, lex),
            "attribution": contains_any(t, lex.attribution),
        }
        some = F.array_compact(F.array(*[F.when(flags[i], F.lit(i)) for i in fv.INTENTS if i in flags]))
        single = F.when(detect_metric(text, lex).isNotNull(), F.array(F.lit("single_value"))).otherwise(F.array().cast("array<string>"))
        return let(some, lambda x: F.when(F.size(x) > 0, x).otherwise(single))

    return let(canonical, lambda text: let(compact_text(text), lambda t: found(text, t)))


def chart_type(c: Column) -> Column:
    t = F.lower(normalize_text(c))
    return (
        F.when(t.contains("line") | t.contains("折线"), fv.LINE_CHART)
        .when(t.contains("bar") | t.contains("柱状"), fv.BAR_CHART)
        .otherwise("")
    )


def chart_cell(types: Column) -> Column:
    """First known chart kind of an array, or the word for none."""
    known = F.filter(F.transform(types, chart_type), lambda x: x != "")
    return F.coalesce(F.get(known, 0), F.lit(fv.NO_CHART))
