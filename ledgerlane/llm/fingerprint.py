"""Document fingerprints: threshold-scaled sketches of word shingles; DataFrame functions only.

A sketch keeps every shingle hash in the lowest fraction of the hash range, and always the least hash, so no text
with words has an empty sketch.  What is kept depends on the shingle alone: the sketch of two documents
together is the union of theirs (with its least hash), and shares of it estimate containment between
documents of very different length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_start, stored, texts

WORDS = 5
FRACTION = 0.25
BLANKS = r"[ \t-\r]+"


def sketch(text: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    """Sorted kept hashes of the ``words``-word shingles of a text; of fewer words the whole row of words; none for no words.

    A-Z are lower-cased; words are split at spaces and the control characters tab to carriage return.
    """
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = F.split(F.regexp_replace(lowered, f"^{BLANKS}|{BLANKS}$", ""), BLANKS)
    limit = int(fraction * (1 << 64)) - (1 << 63)

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]))
        few = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= words, many).otherwise(few)

    # one evaluation of words and hashes each: both are bound as the elements of one-element arrays
    bound = F.transform(F.transform(F.array(split), hashes), lambda h: F.array_sort(F.array_distinct(
        F.concat(F.filter(h, lambda x: x < F.lit(limit)), F.array(F.array_min(h))))))
    return F.when(F.length(F.regexp_replace(text, BLANKS, "")) == 0, F.array().cast("array<bigint>")).otherwise(F.get(bound, F.lit(0)))


def serialized(sketch_of: Column) -> Column:
    """The kept hashes as hexadecimal digits, 16 each, ascending."""
    return F.lower(F.array_join(F.transform(sketch_of, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other has too; 1 for two empty ones, 0 for one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least) \
        .otherwise((F.size(a) == F.size(b)).cast("double"))


def edited_fingerprints(df: DataFrame, words: int = WORDS, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, sketch, edited_text, edited_sketch, next_sketch of every row.

    The edited text has its last quarter of characters replaced by as many first ones (or all) of the next
    document, ascending by id (nulls first, equal ids by the text's hash); the last document takes the first.
    A single document is its own next one.  Null texts are empty; repeated rows follow each other; other
    columns are ignored.
    """
    base = texts(df, id_col, text_col)
    # not-null keys: the id (0 for null) and a hash of the text that also marks a null id
    rows = base.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("mark"))
    key = ["id", "mark"]
    # narrow rows in order; equal (id, text) rows are one node with a number of copies
    nodes = rows.groupBy("doc_id", *key).agg(F.max(F.char_length("text")).alias("n_chars"), F.count(F.lit(1)).alias("copies"), F.lit(1).alias("one"))
    numbered = stored(running_start(nodes, ["doc_id", "mark"], "one", "place"))
    n = max(numbered.count(), 1)
    before = numbered.select(F.pmod(F.col("place") + 1, F.lit(n)).alias("place"), F.col("id").alias("before_id"), F.col("mark").alias("before_mark"),
                             F.floor(F.col("n_chars") / 4).cast("int").alias("wanted"))
    links = stored(numbered.join(before, "place").select("doc_id", *key, "copies", "before_id", "before_mark", "wanted"))
    # each text moves once, in one exchange that both sides of the last join read (the id itself comes from the
    # narrow rows, so that both want the same columns); its head and sketch move once more, to the document before it
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = rows.select(*key, "text").repartition(parts, *key).dropDuplicates(key).join(links, key)
    own = moved.select(*key, "doc_id", "text", "copies", F.char_length("text").alias("n_chars"), sketch(F.col("text"), words, fraction).alias("sketch"))
    heads = moved.select(F.col("before_id").alias("id"), F.col("before_mark").alias("mark"), F.substring("text", F.lit(1), F.col("wanted")).alias("head"),
                         sketch(F.col("text"), words, fraction).alias("next_sketch"))
    last = F.col("copy") == F.col("copies")  # a copy that another copy follows has itself as next document
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    return own.join(heads, key).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "sketch",
        F.concat(F.substring("text", F.lit(1), F.col("n_chars") - quarter),
                 F.when(last, F.col("head")).otherwise(F.substring("text", F.lit(1), quarter))).alias("edited_text"),
        F.when(last, F.col("next_sketch")).otherwise(F.col("sketch")).alias("next_sketch"),
    ).withColumn("edited_sketch", sketch(F.col("edited_text"), words, fraction))
