"""URL rules behind a blocked Bloom filter; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY = 12
PROBES = 4  # bits a key sets in its block, a 64-bit word


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From behind the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: Column | int) -> Column:
    return F.pmod(F.xxhash64(key), blocks if isinstance(blocks, Column) else F.lit(blocks))


def _bits(key: Column) -> Column:
    """The bits of a key in its block, from a second hash."""
    h = F.xxhash64(F.lit("bits"), key)
    word = F.lit(0).cast("long")
    for i in range(PROBES):
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return word


def bloom_filter(keys: DataFrame, key: str, bits_a_key: int = BITS_A_KEY) -> tuple[DataFrame, int]:
    """(table of block and word, number of blocks) over distinct keys: a table, so any number of keys fits."""
    n = keys.count()
    blocks = max(1, -(-n * bits_a_key // 64))
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(F.bit_or(_bits(F.col(key))).alias("word")), blocks


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    ``rules`` has host, path, verdict; a rule fits its host and all subdomains if the path starts with its
    path, and the longest fitting rule (then the longer host, then the lesser verdict) decides, else ``default``.
    Every host suffix with every path prefix of a length some rule has is a candidate.  Candidates that the
    blocked Bloom filter of the rules rules out go; the rest meet the rules in an exact join.  Null urls, and
    urls without ://, have empty host and path and fit no rule, as does a rule whose host is null or empty.
    Repeated pages are kept; of repeated rules one counts; other columns are ignored.
    """
    listed = rules.select(lower_ascii(F.col("host")).alias("_h"), F.coalesce("path", F.lit("")).alias("_p"), F.col("verdict").alias("_v")) \
        .filter("_h <> ''").groupBy("_h", "_p").agg(F.min("_v").alias("_v")) \
        .select("_h", "_p", "_v", F.concat("_h", F.lit("\n"), "_p").alias("key"))
    words, blocks = bloom_filter(listed, "key")
    # one row: the distinct path lengths of the rules, at most as many as a path has characters
    lengths = listed.agg(F.array_sort(F.collect_set(F.char_length("_p"))).alias("_lengths"))

    url = F.col("_url")
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")) \
        .select("page_id", host_of(url).alias("host"), path_of(url).alias("path")) \
        .withColumn("_row", F.monotonically_increasing_id()).crossJoin(F.broadcast(lengths))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    usable = F.filter("_lengths", lambda n: n <= F.char_length("path"))
    candidates = F.flatten(F.transform(suffixes, lambda h: F.transform(usable, lambda n: F.concat(h, F.lit("\n"), F.substring("path", F.lit(1), n)))))
    # a null candidate keeps a page that fits no rule
    spread = parts.select("_row", "page_id", "host", "path", F.explode(F.concat(candidates, F.array(F.lit(None).cast("string")))).alias("key"))
    probed = spread.withColumn("block", _block(F.col("key"), blocks)).join(words, "block", "left")
    possible = probed.filter(F.col("key").isNull() | (F.col("word").bitwiseAND(_bits(F.col("key"))) == _bits(F.col("key"))))
    hits = possible.select("_row", "page_id", "host", "path", "key").join(listed, "key", "left")
    best = F.min(F.when(F.col("_h").isNotNull(), F.struct(
        (-F.char_length("_h") - F.char_length("_p")).alias("size"), (-F.char_length("_h")).alias("host_size"), F.col("_v").alias("verdict"), F.concat("_h", "_p").alias("rule"))))
    return hits.groupBy("_row", "page_id", "host", "path").agg(best.alias("best")).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
