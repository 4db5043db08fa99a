"""Text columns: whitespace, character classes, tokens, sentences and chunks.

All functions take and return Columns built from Spark's own functions.
Java's ``\\s`` is ASCII-only, so Unicode whitespace is asked for with ``(?U)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv

SPACE = r"(?U)[\s\x{1c}-\x{1f}]"
CJK = r"\x{4e00}-\x{9fff}"
GOOD_CHARS = rf"[!-~{CJK}\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}]"
QUOTED = set("\\^$.|?*+()[]{}-&#~")


def quote(word: str) -> str:
    """Escape a literal for a Java regular expression."""
    return "".join("\\" + ch if ch in QUOTED else ch for ch in word)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), SPACE + "+", " "))


def compact_text(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), SPACE + "+", "")


def contains_any(c: Column, words) -> Column:
    words = [w for w in words if w]
    if not words:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def count_contained(c: Column, words) -> Column:
    return reduce(lambda a, b: a + b, [c.contains(w).cast("int") for w in words], F.lit(0))


def bad_text_ratio(c: Column) -> Column:
    """Share of visible characters outside printable ASCII, CJK and full-width forms; 1 when empty."""
    def share(visible):
        bad = F.length(F.regexp_replace(visible, GOOD_CHARS, ""))
        return F.when(visible == "", F.lit(1.0)).otherwise(bad / F.length(visible))

    return let(compact_text(c), share)


def has_encoding_issue(c: Column, limit: float = 0.12) -> Column:
    visible = compact_text(c)
    return (F.length(visible) > 0) & (bad_text_ratio(c) > limit)


def is_noisy(c: Column, limit: float = 0.25) -> Column:
    return (F.length(compact_text(c)) == 0) | (bad_text_ratio(c) > limit)


def cjk_ratio(c: Column) -> Column:
    def share(visible):
        n = F.length(visible)
        other = F.length(F.regexp_replace(visible, rf"[{CJK}]", ""))
        return F.when(n == 0, F.lit(0.0)).otherwise((n - other) / n)

    return let(compact_text(c), share)


def clip_clean(c: Column, limit: int = 180) -> Column:
    spaced = F.translate(normalize_text(c), fv.MOJIBAKE, " " * len(fv.MOJIBAKE))
    return F.substring(normalize_text(spaced), 1, limit)


def reference_snippet(c: Column, limit: int = 120) -> Column:
    """Clipped snippet, or NULL when too short, too damaged or only digits."""
    def keep(cleaned):
        n = F.length(cleaned)
        digits = n - F.length(F.regexp_replace(cleaned, r"(?U)\d", ""))
        only_digits = (digits / F.greatest(n, F.lit(1)) > 0.55) & ~cleaned.rlike(f"[{CJK}]")
        return F.when((n >= 12) & (bad_text_ratio(cleaned) <= 0.08) & ~only_digits, cleaned)

    return let(clip_clean(c, limit), keep)


def is_clean_sentence(c: Column) -> Column:
    def clean(s):
        slashes = F.length(s) - F.length(F.replace(s, F.lit("\\"), F.lit("")))
        readable = s.rlike(r"\p{L}") | (cjk_ratio(s) >= 0.08)
        return (F.length(s) >= 8) & (slashes < 3) & readable & (bad_text_ratio(s) <= 0.10)

    return let(clip_clean(c, 400), clean)


def collapse_spaced(c: Column) -> Column:
    """Drop blanks that split CJK runs, letters and numbers.

    Each blank run has fixed neighbours, so one pass over all rules is a fixed point.
    """
    return F.regexp_replace(c, "(?U)" + "|".join(fv.SPACED_PATTERNS), "")


def _space_at(c: Column, spots) -> Column:
    # An inserted blank can only complete a year rule (it looks for a non-digit after the
    # year), and the blank that completes it is put in by a year rule: three rounds settle.
    for _ in range(3):
        for spot in spots:
            c = F.regexp_replace(c, spot, " ")
    return c


def split_glued_numbers(c: Column) -> Column:
    """Blank between table numbers printed without a gap (signs allowed)."""
    return _space_at(c, fv.GLUED_NUMBER_PATTERNS)


def stabilize_numbers(c: Column) -> Column:
    """The document-level form: also after a percent sign and before a year."""
    return _space_at(c, fv.NUMBER_BOUNDARY_PATTERNS)


def clean_extracted(c: Column) -> Column:
    c = F.translate(text_or_empty(c), "\x00" + fv.MOJIBAKE, " " * (1 + len(fv.MOJIBAKE)))
    c = F.regexp_replace(c, r"[\p{C}\p{Zl}\p{Zp}&&[^\n\t]]|[\p{Zs}&&[^ ]]", " ")
    c = stabilize_numbers(collapse_spaced(c))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n(?U)\s+", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """CJK runs with their bigrams, and lower-cased ASCII words."""
    parts = F.regexp_extract_all(text_or_empty(c), F.lit(rf"([{CJK}]+|[A-Za-z0-9_.%-]+)"), F.lit(1))

    def expand(p):
        bigrams = F.transform(
            F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(p, i, F.lit(2))
        )
        return (
            F.when(~p.rlike(f"^[{CJK}]"), F.array(F.lower(p)))
            .when(F.length(p) > 1, F.concat(F.array(p), bigrams))
            .otherwise(F.array(p))
        )

    return F.flatten(F.transform(parts, expand))


def token_overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """Query tokens, counted with repeats, that occur in the text."""
    return F.size(F.filter(query_tokens, lambda t: F.array_contains(text_tokens, t)))


def token_levels(query_tokens: Column) -> Column:
    """Level k holds the tokens that occur at least k times: counting repeats then needs only
    hashed set intersections, one per level."""
    counted = F.transform(
        F.array_distinct(query_tokens),
        lambda t: F.struct(t.alias("t"), F.size(F.filter(query_tokens, lambda x: x == t)).alias("n")),
    )
    most = F.coalesce(F.array_max(F.transform(counted, lambda c: c["n"])), F.lit(0))
    level = lambda k: F.transform(F.filter(counted, lambda c: c["n"] >= k), lambda c: c["t"])
    return F.when(most > 0, F.transform(F.sequence(F.lit(1), most), level)).otherwise(F.array().cast("array<array<string>>"))


def level_overlap(levels: Column, text_tokens: Column) -> Column:
    """``token_overlap`` from ``token_levels``."""
    return F.aggregate(levels, F.lit(0), lambda acc, tokens_: acc + F.size(F.array_intersect(tokens_, text_tokens)))


def score_text(query: Column, text: Column, query_tokens=None, text_tokens=None) -> Column:
    q = query_tokens if query_tokens is not None else tokens(query)
    bonus = F.when(normalize_text(text).contains(normalize_text(query)), 2.0).otherwise(0.0)
    # the text is cut into tokens once, not once for each token of the query
    return let(text_tokens if text_tokens is not None else tokens(text), lambda t: F.when(
        (F.size(q) == 0) | (F.size(t) == 0), 0.0).otherwise(token_overlap(q, t) + bonus))


def split_sentences(c: Column) -> Column:
    parts = F.split(text_or_empty(c), "(?<=[。！？；!?;\n])")
    return F.filter(F.transform(parts, normalize_text), lambda s: s != "")


def chunk_starts(n: Column, size: int = 500, overlap: int = 80) -> Column:
    step = size - overlap
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    return F.sequence(F.lit(0), last * step, F.lit(step))


def chunks(c: Column, size: int = 500, overlap: int = 80) -> Column:
    """Overlapping chunks of normalised text; empty array for blank text.  ``c`` is used twice:
    pass an already normalised column."""
    n = F.length(c)
    cut = F.transform(chunk_starts(n, size, overlap), lambda s: F.substring(c, s + 1, F.lit(size)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(cut)
