"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_start, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words, in the mix
MOST = 2  # copies of a document
BLOCK = 64  # fractional documents folded together
WORD = r"[^\x20\x09-\x0D]+"
SOURCE = ("number", "source", "source_size", "target")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds number, weight and target to ``sizes`` (source, source_size; a row per source).

    Sources are numbered by code point, null last, and take the weights in turn.  ``share`` of all sizes is
    dealt by weight; a target stops at ``most`` times its source's size and the excess goes to the others
    by weight, until none is above.  Sources are filled in the order of size to weight, and the level of the water
    is the highest met on the way.  No source gives no row; sources without words get 0.
    """
    numbered = running_start(sizes.withColumn("_one", F.lit(1)).withColumn("_last", F.col("source").isNull()),
                             ["_last", "source"], "_one", "number").drop("_one", "_last")
    turn = F.array(*[F.lit(w) for w in weights])
    weighed = numbered.withColumn("weight", F.get(turn, (F.col("number") % len(weights)).cast("int")))
    order = ["_ratio", "number"]
    filled = running_start(weighed.withColumn("_ratio", F.col("source_size") / F.col("weight")), order, "source_size", "_size_before")
    filled = stored(running_start(filled, order, "weight", "_weight_before"))
    total = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rise = (F.lit(share) * F.lit(total["size"]) - most * F.col("_size_before")) / (F.lit(total["weight"]) - F.col("_weight_before"))
    level = filled.agg(F.max(rise)).first()[0]
    return filled.withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.lit(level).cast("double") * F.col("weight"))) \
        .drop("_ratio", "_size_before", "_weight_before")


def _chance(*keys: Column) -> Column:
    """Uniform in [0, 1) and the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def pivotal(block: Column, level: int) -> Column:
    """Folds an array of units (weigh, key, p, unit) into (held, done): all but one have p 0 or 1 afterwards.

    Two units trade words: what one gains the other gives, until one of them is whole.  The direction is drawn
    so that the expected p of both stays, and the words taken in sum stay exactly.
    """
    def step(acc: Column, j: Column) -> Column:
        i = acc["held"]
        up, down = (1 - i["p"]) * i["weigh"], i["p"] * i["weigh"]
        other_up, other_down = (1 - j["p"]) * j["weigh"], j["p"] * j["weigh"]
        gain, loss = F.least(up, other_down), F.least(down, other_up)
        rises = _chance(F.lit(level), i["key"], j["key"]) * (gain + loss) < loss
        first = F.when(rises, up <= other_down).otherwise(down <= other_up)  # the held unit becomes whole
        shift = F.when(rises, gain).otherwise(-loss)

        def part(value: Column) -> Column:
            return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))

        def unit(of: Column, p: Column) -> Column:
            return F.struct(of["weigh"].alias("weigh"), of["key"].alias("key"), p.alias("p"), of["unit"].alias("unit"))

        whole = F.when(first, unit(i, rises.cast("double"))).otherwise(unit(j, (~rises).cast("double")))
        held = F.when(first, unit(j, part(j["p"] - shift / j["weigh"]))).otherwise(unit(i, part(i["p"] + shift / i["weigh"])))
        return F.struct(held.alias("held"), F.concat(acc["done"], F.array(whole)).alias("done"))

    start = F.struct(F.get(block, F.lit(0)).alias("held"), F.slice(block, 1, 0).alias("done"))
    return F.aggregate(F.slice(block, F.lit(2), F.size(block)), start, step)


def settle(folded: Column) -> Column:
    """Units of a fold with p 0 or 1 each: the one left over goes to its nearer side, and what that misses in words is made
    good by others, heaviest first, each turned over only where the miss becomes smaller by it."""
    held = folded["held"]

    def unit(of: Column, p: Column) -> Column:
        return F.struct(of["weigh"].alias("weigh"), of["key"].alias("key"), p.alias("p"), of["unit"].alias("unit"))

    def step(acc: Column, x: Column) -> Column:
        turned = acc["miss"] + (1 - 2 * x["p"]) * x["weigh"]
        better = F.abs(turned) < F.abs(acc["miss"])
        return F.struct(F.when(better, turned).otherwise(acc["miss"]).alias("miss"),
                        F.concat(acc["units"], F.array(unit(x, F.when(better, 1 - x["p"]).otherwise(x["p"])))).alias("units"))

    near = F.round(held["p"])
    start = F.struct(((near - held["p"]) * held["weigh"]).alias("miss"), F.array(unit(held, near)).alias("units"))
    heaviest = F.array_sort(folded["done"], lambda a, b: F.when(a["weigh"] > b["weigh"], -1).when(a["weigh"] < b["weigh"], 1)
                            .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.aggregate(heaviest, start, step)["units"]


def _blocks(units: DataFrame, *keys: str) -> DataFrame:
    """Units of a block in one array, heaviest first."""
    heaviest = F.sort_array(F.collect_list(F.struct((-F.col("u.weigh")).alias("first"), "u")))
    return units.groupBy(*SOURCE, *keys).agg(F.transform(heaviest, lambda x: x["u"]).alias("block"))


def mix(df: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (copies times size).

    A document's size is its number of words, its wanted copies are its source's target over its source's
    size.  The whole part is taken; the fractions are rounded by a reduction tree: documents meet in blocks of about
    ``block`` by hash, one unit a block stays fractional and goes up.  One block a source waits for the root, where
    the heaviest are folded first, so that the unit left over tends to be a light one.  It is rounded to the nearer side,
    and units of the root are turned over where that brings the source's words nearer to its target; what a source
    misses in the end is at most half its heaviest document, and mostly a few words.

    Draws are hashes of ids, sources and sizes: reruns agree, however rows are dealt.  Null and empty texts have
    size 0 and take 0; a null source is a source; repeated rows (same id, source and size) count as often as they
    come and are rounded together before they meet others; an empty table gives no row; other columns are ignored.
    """
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"))
    counted = stored(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))  # texts are read once
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    sources = stored(source_targets(sizes, weights, share, most))
    placed = counted.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    wanted = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    base = F.floor(wanted)
    extra = (wanted - base) * F.col("n")  # over all repeats of a row
    unit = F.struct("doc_id", "size", "n", base.alias("base"), F.floor(extra).alias("more"))
    u = F.struct(F.col("size").cast("double").alias("weigh"), F.xxhash64("doc_id", "source", "size").alias("key"),
                 (extra - F.floor(extra)).alias("p"), unit.alias("unit"))
    units = placed.select(*SOURCE, "units", u.alias("u"))
    open_ = (F.col("u.p") > 0) & (F.col("u.weigh") > 0)
    dealt = units.filter(open_).withColumn("dealt", F.pmod(F.xxhash64("u.key", F.lit(0)), F.ceil(F.col("units") / block)))
    done = [units.filter(~open_).select(*SOURCE, F.col("u.unit").alias("unit"), F.lit(0).alias("won"))]

    def close(folded: DataFrame) -> None:
        done.append(folded.select(*SOURCE, F.explode("f.done").alias("d")).select(*SOURCE, "d.unit", F.col("d.p").cast("int").alias("won")))

    waiting = dealt.filter("dealt = 0").select(*SOURCE, "u")
    rest, level = dealt.filter("dealt > 0").select(*SOURCE, "dealt", "u"), 0
    while True:
        folded = stored(_blocks(rest, "dealt").select(*SOURCE, pivotal(F.col("block"), level).alias("f")))
        close(folded)
        left = folded.select(*SOURCE, F.col("f.held").alias("u"))
        number = left.groupBy("number").agg(F.count(F.lit(1)).alias("left"))
        level += 1
        if (number.agg(F.max("left")).first()[0] or 0) <= block:
            break
        rest = left.join(number, "number").select(
            *SOURCE, "u", F.pmod(F.xxhash64("u.key", F.lit(level)), F.ceil(F.col("left") / block)).alias("dealt"))
    root = _blocks(waiting.unionByName(left)).select(*SOURCE, pivotal(F.col("block"), level).alias("f"))
    ended = stored(root.select(*SOURCE, F.explode(settle(F.col("f"))).alias("d")))
    done.append(ended.select(*SOURCE, "d.unit", F.col("d.p").cast("int").alias("won")))
    decided = done[0]
    for more in done[1:]:
        decided = decided.unionByName(more)
    each = decided.select(*SOURCE, "unit.*", "won", F.explode(F.sequence(F.lit(1).cast("long"), F.col("unit.n"))).alias("repeat"))
    copies = F.col("base") + (F.col("repeat") <= F.col("more") + F.col("won")).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
