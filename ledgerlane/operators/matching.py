"""Finding which of many names occur inside texts, without pairing every text with every name.

Each name is keyed by the n-gram of it that is rarest among the names, texts are exploded into their
distinct n-grams, the two meet in an equi-join, and the few pairs left are checked with ``contains``.  A
bounded number of names is sent to the texts, which then are not shuffled; for more, n-grams that no name
can have are left out by hash before the shuffle, and names that many texts share are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.codes import normalize_code
from ..functions.text import let, normalize_text, quote
from ..session import checkpointed

GRAM = 4


def grams(c: Column, size: int) -> Column:
    """Distinct overlapping n-grams of a text, found in one pass by a zero-width match."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def every_gram(c: Column, sizes, spaced: bool = True) -> Column:
    """``grams`` of several sizes in one pass: shorter ones are beginnings of the longest.  Without ``spaced``, those without white space only."""
    shortest, longest = min(sizes), max(sizes)
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=({'.' if spaced else '[^ ]'}{{{shortest},{longest}}}))"), F.lit(1)))

    def of(g, size):
        cut = g if size == longest else F.transform(g, lambda x: F.substring(x, 1, size))
        long = F.filter(cut, lambda x: F.length(x) == size)
        return long if size == longest else F.array_distinct(long)

    return let(found, lambda g: F.concat(*[of(g, size) for size in sizes])) if len(sizes) > 1 else found


def anchored(names: DataFrame, name: str, size: int = GRAM) -> DataFrame:
    """Distinct names with ``_anchor``, their rarest n-gram among the names."""
    distinct = names.select(name).filter(F.length(name) > 0).distinct()
    short = distinct.filter(F.length(name) <= size).withColumn("_anchor", F.col(name))
    exploded = distinct.filter(F.length(name) > size).select(name, F.explode(grams(F.col(name), size)).alias("_anchor"))
    used = exploded.groupBy("_anchor").count()
    rare = (
        exploded.join(used, "_anchor")
        .groupBy(name)
        .agg(F.min_by("_anchor", F.struct("count", "_anchor")).alias("_anchor"))
    )
    return short.unionByName(rare)


SALTS = 8  # parts of the texts that share an n-gram
BUCKETS = 1 << 18  # hash values that tell which n-grams of the texts can matter
FEW_NAMES, FEW_CHARS = 50_000, 2_000_000  # names up to here are sent to the texts
READ_NAMES, READ_CHARS = 2_000, 40_000  # names up to here are read off a text by one pattern


def one_pattern(names) -> str:
    """Pattern that finds, at every place of a text, the longest of the names that starts there."""
    def after(ends):
        by = {}
        for e in ends:
            if e:
                by.setdefault(e[0], []).append(e[1:])
        parts = [quote(ch) + after(rest) for ch, rest in sorted(by.items())]
        if not parts:
            return ""
        return parts[0] if len(parts) == 1 and "" not in ends else "(?:" + "|".join(parts) + ")" + ("?" if "" in ends else "")

    firsts = "".join(quote(ch) for ch in sorted({n[0] for n in names}))
    return f"(?=[{firsts}])(?=({after(names)}))"


def _read_off(texts: DataFrame, id_cols, text: str, names: list, name: str, strict: Column, holds: Column) -> DataFrame:
    """Names that start at one place of a text are prefixes of the longest that does."""
    known = texts.sparkSession.createDataFrame([(n,) for n in names], f"`{name}` string")
    shortest = min(map(len, names))
    hits = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(one_pattern(names)), F.lit(1)))
    begins = F.transform(hits, lambda h: F.transform(F.sequence(F.lit(shortest), F.length(h)), lambda k: F.substring(h, F.lit(1), k)))
    met = texts.select(*id_cols, text, F.explode(F.array_distinct(F.flatten(begins))).alias(name)).join(F.broadcast(known), name)
    return met.filter(~strict | holds).select(*id_cols, name)


def _sized(keys: DataFrame, name: str) -> tuple[list[int], bool, list | None, bool]:
    """Lengths of the anchors, at most one for each n-gram length; whether the names are few; themselves if very few; whether one has a blank."""
    got = keys.agg(
        F.collect_set(F.length("_anchor")).alias("sizes"), F.count(F.lit(1)).alias("n"), F.max(F.length(name)).alias("longest"),
        F.coalesce(F.sum(F.length(name)), F.lit(0)).alias("chars"), F.count_if(F.contains(F.col(name), F.lit(" "))).alias("spaced")).first()
    few = got["n"] <= FEW_NAMES and got["chars"] <= FEW_CHARS
    read = 0 < got["n"] <= READ_NAMES and got["chars"] <= READ_CHARS and got["longest"] <= 200
    return sorted(got["sizes"]), few, sorted(r[0] for r in keys.select(name).collect()) if read else None, got["spaced"] > 0


def _meet(texts: DataFrame, id_cols, text: str, keys: DataFrame, name: str, sized, strict: Column, holds: Column) -> DataFrame:
    sizes, few, read, spaced = sized
    if read:
        return _read_off(texts, id_cols, text, read, name, strict, holds)
    every = every_gram(F.col(text), sizes, spaced)
    check = (F.length(name) > F.length("_anchor")) | strict
    right = F.contains(F.col(text), F.col(name)) & (~strict | holds)
    if few:  # the texts stay where they are read
        met = texts.select(*id_cols, text, F.explode(every).alias("_anchor")).join(F.broadcast(keys), "_anchor")
        return met.filter(~check | right).select(*id_cols, name)
    # one row a hash value, so bounded: most n-grams of a text end here, before the shuffle
    bucket = lambda: F.pmod(F.xxhash64("_anchor"), F.lit(BUCKETS)).alias("_bucket")
    used = keys.select(bucket()).distinct()
    salt = F.pmod(F.xxhash64(*id_cols), F.lit(SALTS)).cast("int")
    salted = keys.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    spread = texts.select(*id_cols, salt.alias("_salt"), F.explode(every).alias("_anchor"))
    spread = spread.select("*", bucket()).join(F.broadcast(used), "_bucket", "left_semi").drop("_bucket")
    pairs = spread.join(salted.hint("merge"), ["_anchor", "_salt"]).select(*id_cols, name, check.alias("_check"))
    sure = pairs.filter(~F.col("_check")).drop("_check")
    # only texts with a candidate are fetched again; they are merged, since a small file can hold large texts
    maybe = pairs.filter("_check").join(texts.select(*id_cols, text).hint("merge"), list(id_cols)).filter(right)
    return sure.unionByName(maybe.select(*id_cols, name))


def contains_match(texts: DataFrame, id_cols, text: str, names: DataFrame, name: str, size: int = GRAM) -> DataFrame:
    """(id_cols, name) for every name contained in the text of a row.  Ids must be unique and not null."""
    keys = checkpointed(anchored(names, name, size))
    sized = _sized(keys, name)
    if not sized[0]:
        return texts.select(*id_cols, F.lit("").alias(name)).limit(0)
    return _meet(texts, id_cols, text, keys, name, sized, F.lit(False), F.lit(True))


gram_match = contains_match


def company_names(companies: DataFrame) -> DataFrame:
    """alias, stock_code, tier 1: abbreviation, full name and six-digit code.

    The code without its leading zeros is not an alias: '1' occurs in every year.
    """
    alias = F.explode(F.array("stock_abbr", "company_name", normalize_code(F.col("stock_code"))))
    rows = companies.select("stock_code", alias.alias("alias")).withColumn("alias", F.trim("alias")).filter(F.col("alias") != "")
    return rows.groupBy("alias").agg(F.max("stock_code").alias("stock_code")).withColumn("tier", F.lit(1))


def fragment_names(companies: DataFrame, generic=fv.GENERIC_FRAGMENTS, legal=fv.LEGAL_FORMS,
                   blockers=fv.FRAGMENT_BLOCKERS, shortest: int = 2, longest: int = 5) -> DataFrame:
    """fragment, stock_code: prefixes and suffixes of names that point at one company only."""
    source = F.explode(F.array(normalize_text(F.col("stock_abbr")), normalize_text(F.col("company_name"))))
    names = companies.select("stock_code", source.alias("n")).filter(F.length("n") >= 2)
    if legal:
        names = names.withColumn("n", F.regexp_replace("n", "(" + "|".join(legal) + ")$", ""))
    sizes = F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length("n")))
    ends = F.flatten(F.transform(sizes, lambda k: F.array(F.substring("n", F.lit(1), k), F.substring("n", F.length("n") - k + 1, k))))
    pieces = names.filter(F.length("n") >= shortest).select("stock_code", F.explode(ends).alias("fragment"))
    pieces = pieces.filter(~F.col("fragment").isin(*generic)) if generic else pieces
    for word in blockers:
        pieces = pieces.filter(~F.col("fragment").contains(word))
    return (
        pieces.groupBy("fragment")
        .agg(F.min("stock_code").alias("stock_code"), F.max("stock_code").alias("_other"))
        .filter(F.col("stock_code") == F.col("_other"))
        .drop("_other")
    )


def alias_table(companies: DataFrame, **fragment_options) -> DataFrame:
    """All names that identify a company; fragments (tier 2) only count when no name matches."""
    pieces = fragment_names(companies, **fragment_options).withColumnRenamed("fragment", "alias").withColumn("tier", F.lit(2))
    return company_names(companies).unionByName(pieces.select("alias", "stock_code", "tier"))


def best_company(texts: DataFrame, id_cols, text: str, aliases: DataFrame) -> DataFrame:
    """(id_cols, stock_code, alias): the longest alias contained, names before fragments.

    Few aliases go to the texts.  For many, each distinct text is matched once, since questions repeat, under a hash: texts are
    no keys.  A six-digit code counts only when no digit touches it.
    """
    keys = checkpointed(anchored(aliases, "alias"))
    sized = _sized(keys, "alias")
    few = sized[1]
    claim = F.struct(-F.col("tier"), F.length("alias"), "alias", "stock_code")
    if not sized[0]:
        return texts.select(*id_cols, F.lit("").alias("stock_code"), F.lit("").alias("alias")).limit(0)
    hashed = texts.withColumn("_key", F.md5(text))
    rows, ids = (texts, list(id_cols)) if few else (hashed.select("_key", text).dropDuplicates(["_key"]), ["_key"])
    alone = F.regexp_like(F.col(text), F.concat(F.lit("(^|[^0-9])"), F.col("alias"), F.lit("($|[^0-9])")))
    found = _meet(rows, ids, text, keys, "alias", sized, F.col("alias").rlike("^[0-9]+$"), alone)
    best = found.join(F.broadcast(aliases) if few else aliases.hint("merge"), "alias").groupBy(*ids).agg(F.max(claim).alias("b"))
    best = best if few else hashed.select(*id_cols, "_key").join(best.hint("merge"), "_key")
    return best.select(*id_cols, F.col("b.stock_code").alias("stock_code"), F.col("b.alias").alias("alias"))


def company_tags(texts: DataFrame, id_cols, text: str, companies: DataFrame) -> DataFrame:
    """Every company whose abbreviation, else full name, occurs in the text."""
    names = companies.select(
        "stock_code", F.posexplode(F.array(normalize_text(F.col("stock_abbr")), normalize_text(F.col("company_name")))).alias("place", "alias")
    ).filter(F.col("alias") != "")
    found = contains_match(texts, id_cols, text, names, "alias").join(names.hint("merge"), "alias")
    one = found.groupBy(*id_cols, "stock_code").agg(F.min_by("alias", "place").alias("alias"))
    return one.groupBy(*id_cols).agg(F.array_sort(F.collect_set("alias")).alias("company_tags"))


def longest_in_list(c: Column, entries) -> Column:
    """The entry (alias, *fields) whose alias is the longest contained in the text, for a
    fixed short list; first listed wins ties.  NULL when none occurs."""
    ranked = sorted(enumerate(entries), key=lambda e: (-len(e[1][0]), e[0]))
    width = max((len(e) for e in entries), default=4) - 1
    out = F.lit(None).cast("struct<" + ",".join(f"_{i + 1}:string" for i in range(width)) + ">")
    for _, (alias, *fields) in reversed(ranked):
        hit = F.struct(*[F.lit(f).alias(f"_{i + 1}") for i, f in enumerate(fields)])
        out = F.when(c.contains(alias), hit).otherwise(out)
    return out


