"""Benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_of, slices, stored, texts

WINDOW = 10
PATTERN_BYTES = 24 << 20  # of patterns searched for in one pass; more patterns take more passes


def word_bytes(text: str) -> list[bytes]:
    """A-Z lower-cased; words are runs of digits, letters a-z and non-ASCII characters."""
    word = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    fold = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in word else 0x20 for b in range(256))
    return text.encode("utf-8", "replace").translate(fold).split()


class Search:
    """Patterns, each a space-framed row of words, found in a space-framed row of words.

    Patterns of similar length share a shift table: a block of a text that ends no nearer than k bytes before
    the end of a pattern's first m bytes lets the search skip k positions.  A block that may end them leads to the
    patterns with that suffix block, which are then compared directly.
    """

    def __init__(self, patterns: list[bytes]):
        self.classes = []
        by_size: dict = {}
        for i, p in enumerate(patterns):
            by_size.setdefault(len(p).bit_length(), []).append((p, i))
        for group in by_size.values():
            m = min(len(p) for p, _ in group)
            block = max(1, min(8, m // 2))
            far = m - block + 1
            shift: dict = {}
            buckets: dict = {}
            for p, i in group:
                for end in range(block, m + 1):
                    b = p[end - block:end]
                    if shift.get(b, far) > m - end:
                        shift[b] = m - end
                buckets.setdefault(p[m - block:m], []).append((p, i))
            self.classes.append((m, block, far, shift, buckets))

    def hits(self, text: bytes) -> list[tuple[int, int]]:
        """(position, pattern number) of every occurrence."""
        found, n = [], len(text)
        for m, block, far, shift, buckets in self.classes:
            at, get = m, shift.get
            while at <= n:
                b = text[at - block:at]
                skip = get(b, far)
                if skip:
                    at += skip
                    continue
                found.extend((at - m, i) for p, i in buckets[b] if text.startswith(p, at - m))
                at += 1
        return found


def windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """pattern (space-framed words), n_words, items: every distinct window and the items it stems from."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches):
        import pyarrow as pa

        for batch in slices(batches):
            items, patterns, sizes = [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = word_bytes(text)
                size = min(window, len(words))
                for p in {b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)} if words else ():
                    items.append(item)
                    patterns.append(b" " + p + b" ")
                    sizes.append(size)
            yield pa.RecordBatch.from_arrays([pa.array(items, batch.column("item_id").type), pa.array(patterns, pa.binary()), pa.array(sizes, pa.int32())],
                                             names=["item_id", "pattern", "size"])

    return rows.mapInArrow(cut, f"item_id {rows.schema['item_id'].dataType.simpleString()}, pattern binary, size int") \
        .groupBy("pattern", "size").agg(F.collect_set("item_id").alias("items"))


def find_benchmark(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   keep: tuple = (), pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as text), contaminated of every row, and the columns in ``keep``.

    A word is hit if it lies in an occurrence of ``window`` consecutive words of a benchmark item; an item of
    fewer words is one window, one without words none.  Null and empty texts have no words.  An item with a null
    id marks words but cannot be listed.  Repeated documents are kept; repeated items count once; an empty
    benchmark hits nothing; other columns are ignored.  Patterns are broadcast in blocks of at most
    ``pattern_bytes``; each block takes one pass over the documents.
    """
    spark = df.sparkSession
    patterns = stored(windows(benchmark, window))
    total = patterns.agg(F.sum(F.octet_length("pattern") + 16 * F.size("items"))).first()[0] or 0
    blocks = max(1, -(-total * 3 // (2 * pattern_bytes))) if total > pattern_bytes else 1
    names = [f"_k{i}" for i in range(len(keep))]
    rows = texts(df, id_col, text_col, *[F.col(c).alias(n) for c, n in zip(keep, names)]).withColumn("row", F.monotonically_increasing_id())
    schema = schema_of(rows, ("row", "doc_id", *names), "n_words long, spans array<struct<a:int,b:int>>, items array<string>")

    def one_pass(block: int) -> DataFrame:
        part = patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block) if blocks > 1 else patterns
        listed = part.select("pattern", "size", F.transform("items", lambda i: i.cast("string")).alias("items")).collect()  # bounded by pattern_bytes
        shared = spark.sparkContext.broadcast({"patterns": [(bytes(r.pattern), r["size"], r["items"]) for r in listed]})

        def search(batches):
            import pyarrow as pa

            known = shared.value
            if "search" not in known:
                known["search"] = Search([p for p, _, _ in known["patterns"]])
            for batch in slices(batches):
                n_words, spans, items = [], [], []
                for text in batch.column("text").to_pylist():
                    words = word_bytes(text)
                    framed = b" " + b" ".join(words) + b" "
                    covered, named, at, word = [], set(), 0, 0
                    for start, i in sorted(known["search"].hits(framed)):
                        word += framed.count(b" ", at, start)
                        at = start
                        _, size, of = known["patterns"][i]
                        if covered and word <= covered[-1][1]:
                            covered[-1][1] = max(covered[-1][1], word + size)
                        else:
                            covered.append([word, word + size])
                        named.update(of)
                    n_words.append(len(words))
                    spans.append([{"a": a, "b": b} for a, b in covered])
                    items.append(sorted(named))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("row", "doc_id", *names)]
                    + [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                    names=["row", "doc_id", *names, "n_words", "spans", "items"])

        return rows.mapInArrow(search, schema)

    found = one_pass(0)
    for block in range(1, blocks):
        found = found.union(one_pass(block))
    if blocks > 1:  # hits of several passes over a document: at most one row a pass
        found = found.groupBy("row", "doc_id", *names, "n_words").agg(
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        merge = F.aggregate(
            F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
            lambda acc, s: F.struct((acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], s["b"]).alias("to")),
            lambda acc: acc["n"].cast("long"))
    else:
        merge = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return found.select("doc_id", *[F.col(n).alias(c) for c, n in zip(keep, names)], "n_words", merge.alias("n_hit"), "items") \
        .withColumn("contaminated", F.col("n_hit") > 0)
