"""Language identification by interpolated Kneser-Ney character models.

Counts of character n-grams come from all training texts, by Spark aggregation.  A model holds, per order, the
n-grams' 64-bit hashes in a sorted array and each language's smoothed log probability beside them; a text's
score per language is its length-normalised cross-entropy.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_bucket, schema_of, slices, stored, texts

ORDER = 4
DISCOUNT = 0.75
MAX_GRAMS = 1 << 18  # of an order over all languages in a model; a language over its share loses its rarest, which bounds the broadcast
MAX_LANGUAGES = 64
UNKNOWN = "und"
MULTIPLIER = 0x9E3779B97F4A7C15


def prepared(text: str) -> str:
    """What a model reads: lower case, every run of characters that are no letters as one space, framed by spaces."""
    import regex

    return " " + regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()).strip() + " "


def gram_hashes(codes, n: int):
    """Hash of the n-gram that ends at each of ``codes[n - 1:]``; depends on the n characters alone."""
    import numpy as np

    h = np.full(len(codes) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ codes[i:len(codes) - n + 1 + i]) * np.uint64(MULTIPLIER)
        h ^= h >> np.uint64(31)
    return h


def codes_of(strings: list[str]):
    import numpy as np

    return np.frombuffer("".join(strings).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def count_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram (its characters), n: highest-order counts over whole texts, summed per batch before the shuffle."""
    def counted(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            strings = [prepared(t) for t in batch.column("text").to_pylist()]
            out = {"lang": [], "gram": [], "n": []}
            for lang in sorted(set(langs.tolist())):
                # texts apart by enough spaces that no gram holds letters of two
                joined = (" " * (order - 2)).join(s for s, of in zip(strings, langs) if of == lang)
                codes = codes_of([joined])
                if len(codes) < order:
                    continue
                hashes = gram_hashes(codes, order)
                _, first, n = np.unique(hashes, return_index=True, return_counts=True)
                out["lang"].extend([lang] * len(n))
                out["gram"].extend(joined[i:i + order] for i in first.tolist())
                out["n"].extend(n.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out["lang"], pa.string()), pa.array(out["gram"], pa.string()), pa.array(out["n"], pa.int64())], names=list(out))

    return rows.mapInArrow(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build_model(grams: list[tuple[str, str, int]], order: int = ORDER, discount: float = DISCOUNT) -> dict:
    """Model of (lang, gram, count) of the highest order; lower orders use continuation counts."""
    from collections import Counter

    orders = {order: Counter()}
    for lang, gram, n in grams:
        orders[order][lang, gram] += n
    for k in range(order - 1, 0, -1):  # in how many contexts a shorter gram continues
        orders[k] = Counter((lang, gram[1:]) for lang, gram in orders[k + 1])
    tables = {}
    for k, counts in orders.items():
        total: Counter = Counter()
        for (lang, gram), n in counts.items():
            total[lang, gram[:-1]] += n
        tables[k] = [(lang, gram, n, total[lang, gram[:-1]]) for (lang, gram), n in counts.items()]
    return model_of(tables, len({gram for _, gram in orders[1]}), discount)


def model_of(tables: dict[int, list[tuple[str, str, int, int]]], characters: int, discount: float = DISCOUNT) -> dict:
    """The interpolated model from (lang, gram, count, count of its context over all grams) per order.

    A context leaves to the shorter grams what its grams here do not take, so probabilities sum to one whether or
    not all its grams are here.
    """
    import math
    from collections import defaultdict

    import numpy as np

    langs = sorted({row[0] for rows in tables.values() for row in rows})
    column = {lang: i for i, lang in enumerate(langs)}
    order = max(tables)
    model = {"langs": langs, "order": order, "unseen": math.log(max(characters, 1) + 1), "orders": []}
    base = np.full(len(langs), 1 / (max(characters, 1) + 1))
    values, left = [], []  # per order: probability of a gram, share a context leaves
    for k in range(1, order + 1):
        taken: dict = defaultdict(lambda: np.zeros(len(langs)))
        rest: dict = defaultdict(lambda: np.ones(len(langs)))
        for lang, gram, n, total in tables[k]:
            i = column[lang]
            taken[gram][i] = max(n - discount, 0) / total
            rest[gram[:-1]][i] -= max(n - discount, 0) / total
        left.append(rest)

        def below(gram):
            if not gram:
                return base
            found = values[len(gram) - 1].get(gram)
            if found is None:
                found = below(gram[1:])
                return found * left[len(gram) - 1][gram[:-1]] if gram[:-1] in left[len(gram) - 1] else found
            return found

        values.append({gram: p + rest[gram[:-1]] * below(gram[1:]) for gram, p in taken.items()})
        keys, contexts = list(values[-1]), sorted(rest)
        p = np.array([values[-1][g] for g in keys]).reshape(len(keys), len(langs))
        weight = np.array([rest[c] for c in contexts]).reshape(len(contexts), len(langs))
        model["orders"].append((*_sorted_table(keys, np.log(p), k), *_sorted_table(contexts, np.log(weight), k - 1)))
    return model


def _sorted_table(keys: list[str], values, n: int):
    import numpy as np

    if n == 0 or not keys:
        return np.zeros(0, np.uint64), values.astype(np.float32)
    hashes = gram_hashes(codes_of(keys), n)[::n]
    at = np.argsort(hashes)
    return hashes[at], values[at].astype(np.float32)


def position(table, hashes):
    """Index of each hash in a sorted hash array, or -1."""
    import numpy as np

    if not len(table):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at, -1)


def log_probabilities(model: dict, codes):
    """Log probability, per language, of each character from the (order - 1)-th on, given those before it."""
    import numpy as np

    order = model["order"]
    keys, values, _, _ = model["orders"][-1]
    at = position(keys, gram_hashes(codes, order))
    out = values[at]
    missing = np.flatnonzero(at < 0)  # few
    out[missing] = _back_off(model, np.stack([codes[missing + i] for i in range(order)], axis=1), order)
    return out


def _row_hashes(matrix):
    import numpy as np

    n = matrix.shape[1]
    h = np.full(len(matrix), n, np.uint64)
    for i in range(n):
        h = (h ^ matrix[:, i]) * np.uint64(MULTIPLIER)
        h ^= h >> np.uint64(31)
    return h


def _back_off(model: dict, grams, order: int):
    """Log probabilities of n-grams (a row each) that the tables of ``order`` lack: what their context leaves for
    unseen characters, times the shorter n-gram's."""
    import numpy as np

    if order == 1 or not len(grams):
        left = model["orders"][0][3].reshape(-1, len(model["langs"]))[:1]  # of the empty context
        return np.repeat(left - np.float32(model["unseen"]), len(grams), axis=0)
    _, _, contexts, weights = model["orders"][order - 1]
    keys, values, _, _ = model["orders"][order - 2]
    at = position(keys, _row_hashes(grams[:, 1:]))
    below = values[at]
    missing = np.flatnonzero(at < 0)
    below[missing] = _back_off(model, grams[missing, 1:], order - 1)
    where = position(contexts, _row_hashes(grams[:, :-1]))
    return below + np.where((where >= 0)[:, None], weights[where], 0.0)


def entropies(model: dict, strings: list[str]):
    """Cross-entropy (nats a character) of prepared strings, a row per string and a column per language."""
    import numpy as np

    order = model["order"]
    padded = [" " * (order - 2) + s for s in strings]
    codes = codes_of(padded)
    edges = np.concatenate([[0], np.cumsum([len(s) for s in padded])])
    if len(codes) < order:
        return np.full((len(strings), len(model["langs"])), model["unseen"])
    p = log_probabilities(model, codes)
    sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0, dtype=np.float64)])
    first = np.minimum(edges[:-1], len(p))  # n-grams inside one string: from its first character to order - 1 before its end
    last = np.maximum(np.minimum(edges[1:] - order + 1, len(p)), first)
    return -(sums[last] - sums[first]) / np.maximum(last - first, 1)[:, None]


def fit(df: DataFrame, order: int = ORDER, max_grams: int = MAX_GRAMS, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Model of all rows with text and language.

    Counts, continuation counts and context counts of every order cover all texts.  Of each order the model holds at
    most ``max_grams`` n-grams, which bounds the broadcast: languages with more than an even share of them lose their own
    rarest, others none.  Where that loses any, ``exact`` holds all of them as addends (see ``_exact``), which ``identify``
    and ``rejection_limits`` then use.  No rows give a model without languages.
    """
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    grams, tables, whole, cut = stored(count_grams(rows, order)), {}, {}, False
    for k in range(order, 0, -1):
        if k < order:  # in how many contexts a shorter gram continues
            grams = stored(grams.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n")))
        context = F.expr(f"substring(gram, 1, {k - 1})")
        total = grams.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"))
        kept = _most_frequent(grams, max_grams)
        cut = cut or kept is not grams
        whole[k] = grams.withColumn("context", context).join(total, ["lang", "context"])
        found = kept.withColumn("context", context).join(total, ["lang", "context"]).select("lang", "gram", "n", "total").toPandas()
        tables[k] = list(zip(*(found[c].tolist() for c in ("lang", "gram", "n", "total"))))
    characters = grams.select("gram").distinct().count()
    model = model_of(tables, characters)
    return {**model, "exact": _exact(whole, model["langs"], characters, max_grams)} if cut else model


CONTEXT = 0x5851F42D4C957F2D  # tells the hash of a context from that of an n-gram


def _exact(tables: dict[int, DataFrame], langs: list[str], characters: int, most: int, discount: float = DISCOUNT) -> dict:
    """The whole model as addends of hashes, for any number of n-grams.

    The log probability of a character is a sum over the orders: what the context leaves to shorter n-grams, and for an n-gram
    of the model what its probability differs by from that.  So each addend is looked up by itself: the most
    frequent ones, at most ``most``, in a sorted table (``hashes``, ``values``) that is broadcast, all others in the stored table
    ``rest`` (hash, v0, v1, ...), which the places of a text that the first lacks are joined to.
    """
    unseen = -math.log(max(characters, 1) + 1)
    parts, shorter, base = [], None, {}
    for k in sorted(tables):
        g = tables[k].withColumn("taken", F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total"))
        left = stored(g.groupBy("lang", "context").agg((1 - F.sum("taken")).alias("left"), F.sum("n").alias("times")))
        met = g.join(left.drop("times"), ["lang", "context"])
        if shorter is None:
            met = met.withColumn("below", F.lit(math.exp(unseen)))
            base = {r["lang"]: math.log(r["left"]) for r in left.collect()}  # a row per language
        else:
            met = met.withColumn("suffix", F.expr("substring(gram, 2)")).join(shorter, ["lang", "suffix"])
            parts.append(left.select("lang", F.col("context").alias("key"), F.lit(True).alias("is_context"), F.col("times").alias("n"), F.log("left").alias("value")))
        p = F.col("taken") + F.col("left") * F.col("below")
        found = stored(met.select("lang", "gram", "n", p.alias("p"), (F.log(p) - F.log(F.col("left") * F.col("below"))).alias("value")))
        parts.append(found.select("lang", F.col("gram").alias("key"), F.lit(False).alias("is_context"), "n", "value"))
        shorter = found.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
    own = lambda lang: F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("value"))), F.lit(0.0))
    columns = [f"v{i}" for i in range(len(langs))]
    every = reduce(DataFrame.union, parts).groupBy("key", "is_context").agg(F.sum("n").alias("n"), *[own(lang).alias(c) for lang, c in zip(langs, columns)])

    def hashed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys, kind = batch.column("key").to_pylist(), batch.column("is_context").to_numpy(zero_copy_only=False)
            size, out = np.array([len(key) for key in keys]), np.zeros(len(keys), np.uint64)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                out[at] = gram_hashes(codes_of([keys[i] for i in at.tolist()]), n)[::n]
            out[kind] ^= np.uint64(CONTEXT)
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))] + [batch.column(c) for c in ("n", *columns)], names=["hash", "n", *columns])

    table = stored(every.mapInArrow(hashed, "hash long, n long, " + ", ".join(f"{c} double" for c in columns)))
    down = Window.orderBy(F.desc("n"))  # a row per count
    least = table.groupBy("n").agg(F.count(F.lit(1)).alias("size")).withColumn("upto", F.sum("size").over(down)).filter(F.col("upto") <= most).agg(F.min("n")).first()[0]
    core = table.filter(F.col("n") >= least).toPandas() if least is not None else table.limit(0).toPandas()
    hashes = core["hash"].to_numpy().astype(np.int64).view(np.uint64)
    at = np.argsort(hashes)
    return {"hashes": hashes[at], "values": core[columns].to_numpy(np.float64)[at], "constant": np.array([base.get(lang, 0.0) + unseen for lang in langs]),
            "rest": table if least is None else table.filter(F.col("n") < least)}


def _addends(codes, order: int):
    """Hashes of all addends of each character from the (order - 1)-th on: a row each, a column per n-gram and context."""
    size = len(codes) - order + 1
    columns = [gram_hashes(codes, k)[order - k:] for k in range(1, order + 1)]
    columns += [gram_hashes(codes, k)[order - k - 1:][:size] ^ np.uint64(CONTEXT) for k in range(1, order)]
    return np.stack(columns, axis=1)


def _exact_entropies(rows: DataFrame, model: dict) -> DataFrame:
    """``rows`` with ``entropies`` (an array over the model's languages), ``known`` (has a letter) and ``places`` (characters
    judged) instead of ``text``, by all n-grams of the model."""
    langs, order = model["langs"], model["order"]
    names = [c for c in rows.columns if c != "text"]
    shared = rows.sparkSession.sparkContext.broadcast({k: model["exact"][k] for k in ("hashes", "values", "constant")})

    def looked_up(batches):
        import pyarrow as pa

        m = shared.value
        for batch in slices(batches, limit=1 << 18):
            strings = [prepared(t) for t in batch.column("text").to_pylist()]
            sums, places, missed, times = [], [], [], []
            for s in strings:
                wanted, n = np.unique(_addends(codes_of([" " * (order - 2) + s]), order).ravel(), return_counts=True)
                at = position(m["hashes"], wanted)
                here = at >= 0
                places.append(len(s) - 1)
                sums.append(m["constant"] * places[-1] + n[here] @ m["values"][at[here]])
                missed.append(wanted[~here].view(np.int64))
                times.append(n[~here])
            known = [any(map(str.isalpha, s)) for s in strings]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(known), pa.array(places, pa.int64()), pa.array(sums, pa.list_(pa.float64())),
                                                    pa.array(missed, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                names=[*names, "known", "places", "sums", "missed", "times"])

    schema = schema_of(rows, names, "known boolean, places long, sums array<double>, missed array<long>, times array<long>")
    found = stored(rows.mapInArrow(looked_up, schema).withColumn("_row", F.monotonically_increasing_id()))
    open_ = found.select("_row", F.explode(F.arrays_zip("missed", "times")).alias("m")).select("_row", F.col("m.missed").alias("hash"), F.col("m.times").alias("times"))
    columns = [f"v{i}" for i in range(len(langs))]
    more = open_.join(model["exact"]["rest"], "hash").groupBy("_row").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in columns])
    e = F.array(*[-(F.get("sums", F.lit(i)) + F.coalesce(c, F.lit(0.0))) / F.col("places") for i, c in enumerate(columns)])
    return found.join(more, "_row", "left").select(*names, "known", "places", e.alias("entropies"))


SHARES = 1 << 20


def _most_frequent(grams: DataFrame, most: int) -> DataFrame:
    """At most about ``most`` rows: each language's most frequent n-grams, within its share; of equal counts a part by hash."""
    sizes = {r["lang"]: r["count"] for r in grams.groupBy("lang").count().collect()}  # a row per language
    if sum(sizes.values()) <= most:
        return grams
    share, room, quota = sorted(sizes, key=lambda lang: (sizes[lang], lang)), most, {}
    for i, lang in enumerate(share):  # what small languages do not need goes to the others
        quota[lang] = max(1, min(sizes[lang], room // (len(share) - i)))
        room -= quota[lang]
    limits = grams.sparkSession.createDataFrame(list(quota.items()), "lang string, quota long")
    levels = grams.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("size"))
    above = Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)  # over distinct counts, not n-grams
    part = levels.withColumn("before", F.coalesce(F.sum("size").over(above), F.lit(0))).join(F.broadcast(limits), "lang").filter("before < quota") \
        .select("lang", "n", F.least(F.lit(1.0), (F.col("quota") - F.col("before")) / F.col("size")).alias("part"))
    return grams.join(part, ["lang", "n"]).filter((F.pmod(F.xxhash64("gram"), F.lit(SHARES)) < F.ceil(F.col("part") * SHARES)) | (F.col("part") == 1)).select("lang", "gram", "n")


def identify(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """doc_id, lang_pred, score, entropy of every row, and the columns in ``keep``.

    ``lang_pred`` is the language of lowest cross-entropy (the first by name of several), ``und`` for null texts,
    texts without a letter, or a model without languages.  ``score`` is the posterior of that language from
    the entropies of the text's first to last character, tempered to the length of a short sentence, 0 for ``und``; entropy is null there.
    Repeated rows and null ids are kept; other columns are ignored.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    rows = texts(df, id_col, text_col, *[F.col(c).alias(n) for c, n in zip(keep, names)])
    shown = [F.col(n).alias(c) for c, n in zip(keep, names)]
    if "exact" in model:
        e, known = F.col("entropies"), F.col("known")
        odds = F.aggregate(F.transform("entropies", lambda x: F.exp(-TEMPER * (x - F.array_min("entropies")))), F.lit(0.0), lambda a, x: a + x)
        best = F.get(F.array(*[F.lit(lang) for lang in model["langs"]]), F.array_position(e, F.array_min(e)).cast("int") - 1)
        return _exact_entropies(rows, model).select(
            "doc_id", *shown, F.when(known, best).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, 1 / odds).otherwise(0.0).alias("score"),
            F.when(known, F.array_min(e)).alias("entropy"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by max_grams

    def scored(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        for batch in slices(batches, limit=1 << 20):
            strings = [prepared(t) for t in batch.column("text").to_pylist()]
            known = np.array([any(map(str.isalpha, s)) and bool(m["langs"]) for s in strings])  # marks alone are no letters
            if m["langs"]:
                e = entropies(m, strings)
                best = e.argmin(axis=1)
                odds = np.exp(-TEMPER * (e - e.min(axis=1, keepdims=True)))
                score = 1 / odds.sum(axis=1)
                lang = [m["langs"][b] if k else UNKNOWN for b, k in zip(best, known)]
                least = e.min(axis=1)
            else:
                lang, score, least = [UNKNOWN] * len(strings), np.zeros(len(strings)), np.zeros(len(strings))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", *names)]
                + [pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(least.astype(np.float64), mask=~known)],
                names=["doc_id", *names, "lang_pred", "score", "entropy"])

    out = rows.mapInArrow(scored, schema_of(rows, ("doc_id", *names), "lang_pred string, score double, entropy double"))
    return out.select("doc_id", *shown, "lang_pred", "score", "entropy")


TEMPER = 20.0  # characters' worth of evidence in a score

HELD_OUT, BUCKETS = 0, 5  # rows of this remainder are never learnt from
CALIBRATED, PARTS = 0, 10  # of the training rows, the part that rejection limits come from
TAIL = 6.0  # spreads of a character's information beyond which a text is rejected, less the longer it is
MARGIN = 0.8  # nats above the usual entropy that always pass: mixed texts of a language do


def training_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return df.filter(crc_bucket(id_col, BUCKETS) != HELD_OUT)


def counting_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Training rows for the counts of a model whose limits come from ``calibration_rows``."""
    return training_rows(df, id_col).filter(F.floor(crc_bucket(id_col, BUCKETS * PARTS) / BUCKETS) != CALIBRATED)


def calibration_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return training_rows(df, id_col).filter(F.floor(crc_bucket(id_col, BUCKETS * PARTS) / BUCKETS) == CALIBRATED)


def characters(text: Column) -> Column:
    """Length of a text as models read it."""
    return F.length(F.trim(F.regexp_replace(text, r"[^\p{L}\p{M}]+", " "))) + 2


def rejection_limits(df: DataFrame, model: dict, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, centre, spread: entropy of a language's labelled texts under its own model, and the spread of a character's.

    ``df`` are labelled rows that the model's counts do not come from.  A text of n characters is rejected over
    ``centre + MARGIN + TAIL * spread / sqrt(n)``; the spread runs from the median to the 84th percentile.
    One row per language of the model that has such rows.
    """
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isin(model["langs"]) & F.col("text").isNotNull())
    if "exact" in model:
        mine = F.get("entropies", F.array_position(F.array(*[F.lit(lang) for lang in model["langs"]]), F.col("lang")).cast("int") - 1)
        judged = _exact_entropies(rows, model).select("lang", (F.col("places") + 1).alias("n"), F.when(F.col("places") > 1, mine).alias("entropy"))
        return _limits(judged)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def own(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        for batch in slices(batches, limit=1 << 20):
            strings = [prepared(t) for t in batch.column("text").to_pylist()]
            e = entropies(m, strings)[np.arange(len(strings)), [m["langs"].index(lang) for lang in batch.column("lang").to_pylist()]]
            known = np.array([bool(s.strip()) for s in strings])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([len(s) for s in strings], pa.int64()), pa.array(e.astype(np.float64), mask=~known)],
                                             names=["lang", "n", "entropy"])

    return _limits(rows.mapInArrow(own, "lang string, n long, entropy double"))


def _limits(judged: DataFrame) -> DataFrame:
    found = stored(judged.filter("entropy is not null"))
    centre = found.groupBy("lang").agg(F.percentile_approx("entropy", 0.5, 1000).alias("centre"))
    gap = found.join(F.broadcast(centre), "lang").groupBy("lang", "centre").agg(
        F.percentile_approx((F.col("entropy") - F.col("centre")) * F.sqrt("n"), 0.84, 1000).alias("spread"))
    return gap.select("lang", "centre", F.greatest("spread", F.lit(0.0)).alias("spread"))


def explained(entropy: Column, text: Column) -> Column:
    """Whether a text passes the limits joined to it; languages without calibration rows reject nothing."""
    most = F.col("centre") + MARGIN + TAIL * F.col("spread") / F.sqrt(characters(text))
    return F.coalesce(entropy <= most, F.lit(True))
