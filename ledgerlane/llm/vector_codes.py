"""Vectors as short codes: a codebook for each part of a vector, fitted by Lloyd rounds over active entries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
HIGHEST = 1 << 27  # of a component: squared distances of 64 of them stay below 2**63


def whole_numbers(vectors, lengths, dimensions: int, scale: int = SCALE):
    """Rows of floor(scale * x), from the components of vectors laid end to end; shorter vectors end in zeros."""
    import numpy as np

    values = np.clip(np.floor(np.asarray(vectors, np.float64) * scale), -HIGHEST, HIGHEST).astype(np.int32)
    if (lengths == dimensions).all():
        return values.reshape(-1, dimensions)
    out = np.zeros((len(lengths), dimensions), np.int32)
    out[np.arange(dimensions)[None, :] < lengths[:, None]] = values
    return out


def scan(x, book):
    """(index, squared distance) of the nearest entry of ``book`` to each row of ``x``; ties to the lower index."""
    import numpy as np

    gaps = x[:, None, :].astype(np.int64) - book[None, :, :]
    far = np.einsum("nkd,nkd->nk", gaps, gaps)
    nearest = far.argmin(axis=1)
    return nearest, far[np.arange(len(x)), nearest]


def rescan(x, book, moved, held, far):
    """As ``scan``, given the nearest entries ``held`` and exact distances ``far`` from before the ``moved`` entries moved.

    A row whose entry stayed compares the moved entries with its stored distance; the others see the whole book.
    """
    import numpy as np

    held, far = held.copy(), far.copy()
    active = np.flatnonzero(moved)
    lost = moved[held]
    if len(active):
        stay = np.flatnonzero(~lost)
        at, new = scan(x[stay], book[active])
        at = active[at]
        closer = (new < far[stay]) | ((new == far[stay]) & (at < held[stay]))
        held[stay[closer]], far[stay[closer]] = at[closer], new[closer]
        held[lost], far[lost] = scan(x[lost], book)
    return held, far


def updated(books, counts, sums):
    """Entries replaced by the floored mean of their parts; unused ones stay.  (new books, which entries moved)"""
    import numpy as np

    used = counts > 0
    means = np.where(used[..., None], sums // np.maximum(counts, 1)[..., None], books)
    return means, (means != books).any(axis=2)


def _assigned(rows: DataFrame, books, moved, dimensions: int, scale: int, last: bool) -> DataFrame:
    """One assignment: vec_id, label, data, codes, far, totals.

    A task ends with a row of ``totals`` alone: per part and entry the number of its parts and their sums.
    """
    shared = rows.sparkSession.sparkContext.broadcast((books, moved))  # entries x components numbers
    parts, entries, width = books.shape
    kinds = rows.schema
    first = "vector" in rows.columns

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        books, moved = shared.value
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)

        def binary(a):
            return pa.array([r.tobytes() for r in a], pa.binary())

        seen = False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            seen = True
            if first:
                lists = batch.column("vector")
                x = whole_numbers(lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), dimensions, scale)
                data = binary(x)
            else:
                data = batch.column("data")
                x = np.frombuffer(b"".join(data.to_pylist()), np.int32).reshape(n, -1)
                held = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                far = np.frombuffer(b"".join(batch.column("far").to_pylist()), np.int64).reshape(n, parts)
            codes, distances = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64)
            for p in range(parts):
                piece = x[:, p * width:(p + 1) * width]
                codes[:, p], distances[:, p] = scan(piece, books[p]) if first else rescan(piece, books[p], moved[p], held[:, p], far[:, p])
                if not last:
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(sums[p], codes[:, p], piece)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), data, binary(codes), binary(distances), pa.nulls(n, pa.list_(pa.int64()))],
                names=["vec_id", "label", "data", "codes", "far", "totals"])
        if seen and not last:
            flat = np.concatenate([counts[..., None], sums], axis=2).ravel()
            one = [pa.nulls(1, batch.column("vec_id").type), pa.nulls(1, batch.column("label").type), *[pa.nulls(1, pa.binary())] * 3]
            yield pa.RecordBatch.from_arrays([*one, pa.array([flat], pa.list_(pa.int64()))], names=["vec_id", "label", "data", "codes", "far", "totals"])

    from pyspark.sql import types as T

    out = T.StructType([T.StructField("vec_id", kinds["vec_id"].dataType), T.StructField("label", kinds["label"].dataType),
                        *[T.StructField(c, T.BinaryType()) for c in ("data", "codes", "far")],
                        T.StructField("totals", T.ArrayType(T.LongType()))])
    return stored(rows.mapInArrow(assign, out), compression="zstd")


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"):
    """(codes, books): a row per kept vector, vec_id, label, codes (array of entry numbers), error; and the entries.

    Rows whose vector is null or holds null or non-finite components are left out.  Components become
    floor(scale * x), held within 2**27; vectors are cut into ``parts`` equal parts (vectors shorter than the longest end in
    zeros, also where its length is no multiple of ``parts``).  Each part's codebook starts as that part of the
    ``entries`` rows of the smallest ids (nulls last, equal ids by vector; fewer rows give fewer entries).  A round
    assigns every part to its nearest entry (ties to the lower index) and replaces entries by the floored mean of
    their parts; after the last round parts are assigned again.  Rounds end early where no entry moves: later ones
    would change nothing.  ``entries`` is 256 at most.

    Rows carry their entries and exact distances from round to round, so that a round compares only
    entries that moved, but for parts whose own entry moved.  A task sums counts and parts per entry itself:
    only those sums, a few thousand numbers, meet.  Repeated rows count each; null labels and ids are kept; an
    empty table gives no row and no entry; other columns are ignored.
    """
    import numpy as np

    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above all
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")) \
        .filter(F.col("vector").isNotNull() & finite)
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        none = rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return none, np.zeros((parts, 0, 0), np.int64)
    dimensions = max(-(-longest // parts), 1) * parts
    seed = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()  # ``entries`` rows
    flat = [x for r in seed for x in r[0]]
    start = whole_numbers(flat, np.array([len(r[0]) for r in seed]), dimensions, scale).astype(np.int64)
    books = start.reshape(len(seed), parts, -1).transpose(1, 0, 2).copy()
    moved = np.ones(books.shape[:2], bool)
    state = _assigned(rows, books, moved, dimensions, scale, rounds == 0)
    for r in range(rounds):
        spot = F.posexplode("totals").alias("spot", "value")
        sums = state.filter("totals is not null").select(spot).groupBy("spot").agg(F.sum("value")).collect()
        totals = np.zeros(books.size + moved.size, np.int64)
        for at, value in sums:
            totals[at] = value
        totals = totals.reshape(*moved.shape, -1)
        books, moved = updated(books, totals[..., 0], totals[..., 1:])
        if not moved.any():
            break
        older, state = state, _assigned(state.filter("totals is null").drop("totals"), books, moved, dimensions, scale, r + 1 == rounds)
        discard(older)

    def summed(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, -1)
            far = np.frombuffer(b"".join(batch.column("far").to_pylist()), np.int64).reshape(n, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(far.sum(axis=1))],
                names=["vec_id", "label", "codes", "error"])

    from pyspark.sql import types as T

    out = T.StructType([state.schema["vec_id"], state.schema["label"], T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    return state.filter("totals is null").select("vec_id", "label", "codes", "far").mapInArrow(summed, out), books


def digest(books) -> str:
    """SHA-256 of all components as decimals, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_table(df: DataFrame, **settings) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (of all rows with this label, nulls together), codebooks_sha256."""
    codes, books = compress(df, **settings)
    codes = stored(codes)
    of_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    two = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return codes.join(of_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", two.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
