"""Token counts by a compiled finite-state tokenizer."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import transducer
from .common import default_tokenizer, slices, texts

CHUNK = 262_144  # characters


def count_tokens(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every row, as the tokenizer counts it without added tokens.

    Special strings inside a text count as their one token.  A text longer than ``chunk`` characters is
    cut; the state maps of its chunks are computed in parallel and composed.  Null and empty texts have 0
    bytes and 0 tokens; repeated rows and null ids are kept; other columns are ignored.
    """
    spark = df.sparkSession
    spec = transducer.load(tokenizer or default_tokenizer())
    shared = spark.sparkContext.broadcast(spec)  # one tokenizer file
    added = spec["added"]

    rows = texts(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    pieces = F.array("text")
    if added:
        pattern = "|".join(re.escape(t) for t in added)
        has = F.lit(False)
        for t in added:
            has = has | F.col("text").contains(t)
        pieces = F.when(has, F.split("text", pattern, -1)).otherwise(pieces)
    cut = rows.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.posexplode(pieces).alias("piece", "text")).select(
        "row", "doc_id", "n_bytes", "piece",
        F.posexplode(F.when(F.char_length("text") <= chunk, F.array("text")).otherwise(
            F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)))).alias("part", "chunk"),
        (F.char_length("text") <= chunk).alias("whole"),
    )

    def machine():
        live = shared.value.get("live")
        if live is None:
            live = shared.value["live"] = transducer.Transducer(shared.value)
        return live

    def maps(batches):
        import pyarrow as pa

        t = machine()
        for batch in slices(batches, "chunk"):
            strings, whole = batch.column("chunk").to_pylist(), batch.column("whole").to_pylist()
            counts = iter(t.totals([s for s, w in zip(strings, whole) if w]))
            got = [(True, "", next(counts), "") if w else t.chunk_map(s) for s, w in zip(strings, whole)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "n_bytes", "piece", "part", "whole")),
                 pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.string()),
                 pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.string())],
                names=["row", "doc_id", "n_bytes", "piece", "part", "whole", "resolved", "head", "count", "tail"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    mapped = cut.mapInArrow(maps, f"row long, doc_id {id_type}, n_bytes long, piece int, part int, whole boolean, "
                                  "resolved boolean, head string, count long, tail string")
    # a row per text; only the maps of cut texts are gathered: short strings, as many as the text has chunks
    gathered = mapped.groupBy("row", "doc_id", "n_bytes").agg(
        F.sum("count").alias("count"),
        F.max("piece").alias("n_added"),
        F.array_sort(F.collect_list(F.when(~F.col("whole"), F.struct("piece", "part", "resolved", "head", "count", "tail")))).alias("maps"),
    )

    def composed(batches):
        import itertools

        import pyarrow as pa

        t = machine()
        for batch in batches:
            total = []
            for count, maps_of, n_added in zip(*(batch.column(c).to_pylist() for c in ("count", "maps", "n_added"))):
                if maps_of:
                    cut_pieces = itertools.groupby(maps_of, key=lambda m: m["piece"])
                    ordered = [[(m["resolved"], m["head"], m["count"], m["tail"]) for m in piece] for _, piece in cut_pieces]
                    count += sum(t.scan(piece) for piece in ordered) - sum(m["count"] for m in maps_of)
                total.append(count + n_added)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(total, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    return gathered.mapInArrow(composed, f"doc_id {id_type}, n_bytes long, n_tokens long")
