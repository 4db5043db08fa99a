"""Packing along a space-filling curve: documents alike lie near each other in the training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import default_tokenizer, running_start, slices, stored, texts
from .encoding import shared_encoder, vocabulary_size

LENGTH = 2048
DIMENSIONS, BITS = 4, 8  # of the curve


def hilbert_keys(points, bits: int):
    """Positions on the Hilbert curve of integer ``points`` (rows) with ``bits`` bits a coordinate."""
    import numpy as np

    x = points.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations, from the coarsest square
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def directions(ids, dimensions: int):
    """A pseudo-random direction (one of -1 and 1 in each dimension) per token id: the hashed vector, projected."""
    import numpy as np

    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.stack([((h >> np.uint64(63 - i)) & np.uint64(1)).astype(np.int8) * 2 - 1 for i in range(dimensions)])


def pack(df: DataFrame, tokenizer: str | None = None, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id",
         text_col: str = "text", dimensions: int = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, curve_key, sequence_id, offset.

    The documents' ids (each with ``end_id`` behind it) form one stream in curve order, cut every
    ``length`` ids: no sequence but the last has room left.  A document's curve position comes from its
    token counts, projected to ``dimensions`` pseudo-random directions and scaled by its length; ties are
    ordered by id, then by content.  Null and empty texts are the end id alone; repeated rows are packed
    as often as they come; an empty table gives no piece; other columns are ignored.
    """
    spark = df.sparkSession
    path = tokenizer or default_tokenizer()
    shared = spark.sparkContext.broadcast({"path": path})
    rows = texts(df, id_col, text_col)
    # ids move between steps in two bytes where the vocabulary allows it
    held_as = "<u2" if max(vocabulary_size(path), end_id + 1) <= 1 << 16 else "<u4"
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encoded(batches):
        import numpy as np
        import pyarrow as pa

        holder = shared.value
        encoder = shared_encoder(holder)
        if "table" not in holder:
            holder["table"] = directions(np.arange(1 << 17), dimensions)
        for batch in slices(batches):
            ids, edges = encoder.encode(batch.column("text").to_pylist())
            size = np.diff(edges)
            spread = []
            for signs in holder["table"]:
                sums = np.concatenate([[0], np.cumsum(signs[ids], dtype=np.int64)])
                spread.append((sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(size, 1))  # mean direction, in -1..1
            spread = np.stack(spread)
            cells = ((np.tanh(4 * spread) + 1) / 2 * ((1 << bits) - 1)).round().astype(np.int64)
            ids = np.insert(ids, edges[1:], end_id).astype(held_as)
            edges = edges + np.arange(len(edges))
            data = [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(edges), pa.int64()), pa.array(hilbert_keys(cells.T, bits)), pa.array(data, pa.binary())],
                names=["doc_id", "doc_tokens", "curve_key", "data"])

    tokens = stored(
        rows.mapInArrow(encoded, f"doc_id {kind}, doc_tokens long, curve_key long, data binary")
        .withColumn("row", F.monotonically_increasing_id()), compression="zstd")
    # order and cuts are found on narrow rows; the ids then meet their place by row
    placed = running_start(tokens.select("row", "doc_id", "doc_tokens", "curve_key"),
                           ["curve_key", "doc_id", "doc_tokens", "row"], "doc_tokens", "position")
    return tokens.select("row", "data").join(placed, "row").mapInArrow(
        lambda batches: _pieces(batches, length, held_as),
        f"doc_id {kind}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, curve_key long, sequence_id long, offset long")


def _pieces(batches, length: int, held_as: str):
    """Cuts each document at the sequence edges that fall inside it."""
    import zlib

    import numpy as np
    import pyarrow as pa

    names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "curve_key", "sequence_id", "offset"]
    for batch in batches:
        out = {n: [] for n in names}
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "position", "doc_tokens", "curve_key", "data"))
        for doc, position, size, key, data in zip(*columns):
            start, ids = 0, np.frombuffer(data, held_as).astype("<u4")
            while start < size:
                sequence, offset = divmod(position + start, length)
                n = min(length - offset, size - start)
                piece = ids[start:start + n]
                for name, value in zip(names, (doc, start, n, piece.view("<i4"), zlib.crc32(piece), size, key, sequence, offset)):
                    out[name].append(value)
                start += n
        arrays = [batch.column("doc_id").type, pa.int64(), pa.int64(), pa.list_(pa.int32()), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, arrays)], names=names)
