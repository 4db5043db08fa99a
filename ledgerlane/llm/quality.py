"""Quality scores: kernel ridge regression by random Fourier features of document statistics, then isotonic calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, schema_of, slices, stored, texts

FEATURES = 256  # random Fourier features
RIDGE = 1e-2  # per training row
WIDTH = 1.0  # kernel width in standard deviations of a statistic, times the root of their number
MAX_TRAIN = 200_000  # labelled rows learnt from; more are thinned out by a hash of the id
BINS = 1000  # of raw scores, for the calibration
HELD_OUT, BUCKETS = 1, 3  # rows of this remainder are never learnt from
CALIBRATION = 5  # one training row in so many calibrates, the others fit
SEED = 7
SYMBOLS = b"#$%&*+/<=>@\\^_`{}~[]"


def statistics(text: str) -> list[float]:
    """Measures of a whole text: lengths, variety, repetition and the make-up of its characters."""
    import zlib
    from collections import Counter

    import numpy as np

    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    n, size = max(len(words), 1), max(len(data), 1)
    seen = Counter(words)
    share = lambda chars: float(counts[list(chars)].sum()) / size
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    return [
        float(np.log1p(size)), float(np.log1p(len(words))), min(size / n, 50.0),
        len(seen) / n ** 0.8, max(seen.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        float(upper / max(upper + lower, 1)), share(SYMBOLS), share(b"!?"), share(b"|"),
        share(b"0123456789"), share(b".,;:"), share(b"\n"), float(counts[128:].sum()) / size,
        len(zlib.compress(data, 1)) / size,
    ]


N_STATISTICS = 15


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """doc_id, x (the statistics) of every row, and the columns in ``keep``."""
    names = [f"_k{i}" for i in range(len(keep))]
    rows = texts(df, id_col, text_col, *[F.col(c).alias(n) for c, n in zip(keep, names)])

    def measured(batches):
        import pyarrow as pa

        for batch in slices(batches):
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *names)), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", *names, "x"])

    out = rows.mapInArrow(measured, schema_of(rows, ("doc_id", *names), "x array<double>"))
    return out.select("doc_id", *[F.col(n).alias(c) for c, n in zip(keep, names)], "x")


def matrix(column):
    import numpy as np

    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def raw_scores(model: dict, x):
    return lifted(model, x) @ model["w"]


def lifted(model: dict, x):
    """Random Fourier features: inner products approximate a Gaussian kernel of the standardised statistics; and a constant."""
    import numpy as np

    z = np.cos(np.clip((x - model["mean"]) / model["spread"], -8, 8) @ model["frequencies"] + model["phases"])
    return np.hstack([z * np.sqrt(2 / z.shape[1]), np.ones((len(z), 1))])


def isotonic(weights: list[float], means: list[float]) -> list[float]:
    """Pool adjacent violators: the nondecreasing sequence closest to ``means`` by weighted squares."""
    pools: list = []
    for w, m in zip(weights, means):
        pools.append([w, m, 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            (w1, m1, n1), (w2, m2, n2) = pools[-2:]
            pools[-2:] = [[w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2]]
    return [m for _, m, n in pools for _ in range(n)]


def calibrated(model: dict, raw):
    """Scores in 0 to 1; a small part stays proportional to the raw score, so ties keep their order."""
    import numpy as np

    clipped = np.clip(raw, -0.5, 1.5)
    if not len(model["knots"]):
        return np.clip(raw, 0, 1)
    return np.clip(0.99 * np.interp(clipped, model["knots"], model["levels"]) + 0.005 * (clipped + 0.5), 0, 1)


def fit(measured: DataFrame, labels: DataFrame, features: int = FEATURES, max_train: int = MAX_TRAIN, id_col: str = "doc_id",
        label_col: str = "quality") -> dict | None:
    """Model from labelled training rows (None if there are none): at most about ``max_train`` of them.

    Sums over partitions give means and spreads, then the normal equations, then the calibration's bins; the
    driver sees only these sums.
    """
    import numpy as np

    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).filter("y is not null and doc_id is not null") \
        .filter(crc_bucket("doc_id", BUCKETS) != HELD_OUT).groupBy("doc_id").agg(F.avg("y").alias("y"))
    train = stored(measured.select("doc_id", "x").join(known, "doc_id"))
    n = train.count()
    if not n:
        return None
    if n > max_train:
        train = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_train / n))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(CALIBRATION))
    moments = train.agg(*[f(F.col("x")[i]).alias(f"{name}{i}") for i in range(N_STATISTICS) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng = np.random.default_rng(SEED)
    model = {
        "mean": np.array([moments[f"m{i}"] for i in range(N_STATISTICS)]),
        "spread": np.maximum(np.array([moments[f"s{i}"] for i in range(N_STATISTICS)]), 1e-6),
        "frequencies": rng.normal(size=(N_STATISTICS, features)) / (WIDTH * np.sqrt(N_STATISTICS) / 2),
        "phases": rng.uniform(0, 2 * np.pi, features),
    }
    shared = train.sparkSession.sparkContext.broadcast(model)
    size = features + 1

    def partial(batches):
        import pyarrow as pa

        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = lifted(shared.value, matrix(batch.column("x")))
                total += z.T @ np.column_stack([z, batch.column("y").to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def added(batches):
        import pyarrow as pa

        total = np.zeros((size, size + 1))
        for batch in batches:
            for data in batch.column("total").to_pylist():
                total += np.frombuffer(data).reshape(size, size + 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    fitting = train.filter(fold != 0)
    sums = fitting.mapInArrow(partial, "total binary").repartition(8).mapInArrow(added, "total binary").collect()  # 8 rows
    total = sum(np.frombuffer(r["total"]).reshape(size, size + 1) for r in sums)
    count = max(total[-1, size - 1], 1.0)
    model["w"] = np.linalg.solve(total[:, :size] + RIDGE * np.sqrt(count) * np.eye(size), total[:, size])
    shared = train.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                raw = np.clip(raw_scores(shared.value, matrix(batch.column("x"))), -0.5, 1.5)
                yield pa.RecordBatch.from_arrays([pa.array(((raw + 0.5) / 2 * (BINS - 1)).round().astype(np.int32)), batch.column("y")], names=["bin", "y"])

    bins = train.filter(fold == 0).select("x", "y").mapInArrow(scored, "bin int, y double").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()  # at most BINS rows
    model["knots"] = [b["bin"] / (BINS - 1) * 2 - 0.5 for b in bins]
    model["levels"] = isotonic([b["n"] for b in bins], [b["y"] for b in bins])
    return model


def score(measured: DataFrame, model: dict | None, keep: tuple = ()) -> DataFrame:
    """doc_id, score (0 to 1), predicted of every row of ``measure``; without a model every score is 0.5.

    Null and empty texts are scored by their statistics like any other; repeated rows and null ids are kept.
    """
    if model is None:
        out = measured.select("doc_id", *keep, F.lit(0.5).alias("score"))
    else:
        shared = measured.sparkSession.sparkContext.broadcast(model)
        rows = measured.select("doc_id", *keep, "x")

        def scored(batches):
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    s = calibrated(shared.value, raw_scores(shared.value, matrix(batch.column("x"))))
                    yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(s)], names=["doc_id", *keep, "score"])

        out = rows.mapInArrow(scored, schema_of(rows, rows.columns[:-1], "score double"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: tuple = ()) -> DataFrame:
    """doc_id, score, predicted of every row of ``df``, learnt from its labelled rows outside the held-out remainder.

    Repeated labels of an id are averaged; labels of other ids, null labels and null ids are not learnt from;
    no labels give score 0.5 to all; other columns are ignored.
    """
    measured = stored(measure(df, id_col, text_col, keep))
    return score(measured, fit(measured, labels, id_col=id_col, label_col=label_col), keep)
