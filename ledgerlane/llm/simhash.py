"""SimHash near-duplicates by covering locality-sensitive hashing.

Tables keep structured bit masks of a fingerprint.  Bit i has a code c(i), a nonzero vector of radius + 1
bits; table v (also such a vector) keeps the bits with odd <v, c(i)>.  The codes of any ``radius`` bits
leave some v orthogonal to all of them, so two fingerprints that differ in those bits only agree on all that
table v keeps: every pair within the radius meets in some table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, texts, whole_row
from .graph import components, forest_roots

RADIUS = 3
NEARLY_ALL = 54  # fixed bits from which a bucket is compared whole: at most 1024 fingerprints differ in the others
BUCKET = 1024  # members compared in one task; larger buckets are split by more masks, which loses no pair
SEED = 42


def covering_masks(radius: int, bits: tuple = tuple(range(64))) -> list[int]:
    """The masks of all tables over the given bit positions."""
    tables = (1 << radius + 1) - 1
    return [sum(1 << b for i, b in enumerate(bits) if ((i % tables + 1) & v).bit_count() & 1) for v in range(1, tables + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, split at spaces and the control characters tab to carriage return."""
    return text.encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes], n: int) -> list[bytes]:
    """n-word shingles, repeats included; of fewer words the whole sequence; none of no words."""
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]


def majority(hashes, edges):
    """A fingerprint per run ``edges[i]:edges[i+1]`` of 64-bit hashes: each bit set in over half of them; 0 for none."""
    import numpy as np

    out = np.zeros(len(edges) - 1, np.uint64)
    step = 1 << 16
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        votes = np.zeros(64, np.int64)
        for at in range(a, b, step):
            part = hashes[at:min(b, at + step)]
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * votes > b - a, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""
    rows = texts(df, id_col, text_col)

    def hashed(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in slices(batches):
            hashes, edges = [], [0]
            for text in batch.column("text").to_pylist():
                hashes.extend([digest(s, SEED) for s in shingles(words_of(text), shingle)])
                edges.append(len(hashes))
            fp = majority(np.array(hashes, np.uint64), edges)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def final(fixed):
    import numpy as np

    return np.bitwise_count(fixed.view(np.uint64)) >= NEARLY_ALL


def _runs(batches, limit: int):
    """Members of each bucket as (key, fixed, columns), from rows sorted by key.

    A bucket of over ``limit`` members comes in parts marked as such; memory holds one batch and one bucket part.
    """
    import numpy as np

    held, hot = None, None
    for batch in batches:
        data = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if held is not None:
            data = {n: np.concatenate([held[n], data[n]]) for n in data}
        key = data["key"]
        if not len(key):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        last = int(cuts[-1])
        hold = final(data["fixed"][last:last + 1])[0] or len(key) - last <= limit and not (hot is not None and key[last] == hot)
        if not hold:  # too large already: pass on what is here
            yield {n: c for n, c in data.items()}, np.append(cuts, len(key)), hot
            hot, held = int(key[last]), None
        else:
            yield {n: c[:last] for n, c in data.items()}, cuts, hot
            held, hot = {n: c[last:] for n, c in data.items()}, hot if last == 0 else None
    if held is not None and len(held["key"]):
        yield held, np.array([0, len(held["key"])]), hot


def _forest(size: int, close):
    """Edges of a spanning forest of the graph of close members."""
    import numpy as np

    unseen = np.arange(size)
    edges = []
    while len(unseen):
        stack, unseen = [int(unseen[0])], unseen[1:]
        while stack and len(unseen):
            i = stack.pop()
            near = close(i, unseen)
            found = unseen[near]
            edges.extend((i, int(j)) for j in found)
            stack.extend(found.tolist())
            unseen = unseen[~near]
    return edges


def link(table: DataFrame, most: int, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all close pairs that meet in a bucket.

    ``table`` has key (of the bucket), id, fp, fixed (the bits of fp that the key fixes) and the two halves lo, hi of
    the signature compared; close are two members with at most ``most`` differing signature bits.  Each bucket yields a
    spanning forest of its close pairs, at most one edge a member, never all pairs.  A bucket over ``bucket``
    members is dealt out again by covering masks over the bits it leaves free, as often as needed: each time
    about half of the free bits are fixed, and a bucket that has nearly all fixed is compared whole.
    """
    edges = None
    while True:
        found = stored(_linked(table, most, bucket))
        plain = found.filter("fixed is null").select("a", "b")
        edges = plain if edges is None else edges.union(plain)
        hot = found.filter("fixed is not null").select(F.col("a").alias("id"), "fp", "fixed", "lo", "hi")
        if hot.isEmpty():
            return edges
        table = _refined(hot, radius)


FIELDS = ("id", "fp", "fixed", "lo", "hi")


def _linked(table: DataFrame, most: int, bucket: int) -> DataFrame:
    def linked(batches):
        import numpy as np
        import pyarrow as pa

        for data, cuts, hot in _runs(batches, bucket):
            ids, lo, hi = data["id"], data["lo"].view(np.uint64), data["hi"].view(np.uint64)
            far = lambda i, j: np.bitwise_count(lo[i] ^ lo[j]).astype(np.int64) + np.bitwise_count(hi[i] ^ hi[j])
            size = np.diff(cuts)
            whole = (size <= bucket) | final(data["fixed"][cuts[:-1]])
            if hot is not None and len(cuts) > 1 and data["key"][cuts[0]] == hot:
                whole[0] = False
            twos = cuts[:-1][whole & (size == 2)]
            twos = twos[far(twos, twos + 1) <= most]
            a, b = [ids[twos]], [ids[twos + 1]]
            for at in np.flatnonzero(whole & (size > 2)):
                start = cuts[at]
                pairs = np.array(_forest(size[at], lambda i, rest, s=start: far(s + i, s + rest) <= most), np.int64).reshape(-1, 2)
                a.append(ids[start + pairs[:, 0]])
                b.append(ids[start + pairs[:, 1]])
            over = np.zeros(len(ids), bool)
            over[:cuts[-1]] = np.repeat(~whole, size)
            a, b = np.concatenate(a), np.concatenate(b)
            left = {n: data[n][over] for n in FIELDS}
            none = np.arange(len(a) + len(left["id"])) < len(a)
            blank = np.zeros(len(a), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a, left["id"]])), pa.array(np.concatenate([b, left["id"]]))]
                + [pa.array(np.concatenate([blank, left[n]]), mask=none) for n in FIELDS[1:]], names=["a", "b", *FIELDS[1:]])

    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.select("key", *FIELDS).repartition(n, "key").sortWithinPartitions("key", "id").mapInArrow(
        linked, "a long, b long, " + ", ".join(f"{n} long" for n in FIELDS[1:]))


def _refined(hot: DataFrame, radius: int) -> DataFrame:
    def dealt(batches):
        import numpy as np
        import pyarrow as pa

        known: dict = {}
        for batch in batches:
            data = {n: batch.column(n).to_numpy() for n in FIELDS}
            out: list = []
            for f in np.unique(data["fixed"]).tolist():
                if f not in known:
                    free = tuple(b for b in range(64) if not f >> b & 1)
                    known[f] = np.array([signed((f | m) & (1 << 64) - 1) for m in covering_masks(radius, free)], np.int64)
                mine = data["fixed"] == f
                rows = {n: np.repeat(data[n][mine], len(known[f])) for n in FIELDS}
                rows["fixed"] = np.tile(known[f], int(mine.sum()))
                out.append(rows)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[n] for o in out])) for n in FIELDS], names=list(FIELDS))

    # the masks are codes of the fixed bits: equal masks of one table differ in no key
    return hot.mapInArrow(dealt, ", ".join(f"{n} long" for n in FIELDS)).distinct() \
        .withColumn("key", F.xxhash64("fixed", F.col("fp").bitwiseAND(F.col("fixed"))))


def buckets(fp: Column, radius: int) -> Column:
    """Column: the buckets of a fingerprint as structs (key, fp, fixed)."""
    return F.array(*[
        F.struct(F.xxhash64(F.lit(0), F.lit(m), fp.bitwiseAND(F.lit(m))).alias("key"), fp.alias("fp"), F.lit(m).alias("fixed"))
        for m in map(signed, covering_masks(radius))])


def near_duplicates(df: DataFrame, shingle: int = 3, radius: int = RADIUS, bucket: int = BUCKET, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id of the component) of every row.

    Fingerprints link at ``radius`` or fewer differing bits.  Texts without words (null, empty, blank) have
    fingerprint 0 and link like any other; equal fingerprints are one node, so copies cost one row; repeated
    rows are kept; null ids never name a component that has another id; other columns are ignored.
    """
    docs = stored(fingerprints(df, shingle, id_col, text_col))
    nodes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    table = nodes.select(F.col("fp").alias("id"), F.col("fp").alias("lo"), F.lit(0).cast("long").alias("hi"), F.explode(buckets(F.col("fp"), radius)).alias("b")) \
        .select("id", "lo", "hi", "b.*")
    grouped = components(link(table, radius, radius, bucket))
    named = nodes.join(grouped.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    # written, so that the documents of a very frequent fingerprint meet it in a join that Spark can split
    owner = stored(named.select("fp", "component").join(least, "component").select("fp", "component_id"))
    return docs.join(owner, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SIMILAR = 0.8  # least Jaccard similarity of the shingle sets of near copies
BANDS, ROWS = 20, 4  # least hashes: a pair of similarity 0.8 agrees on a whole band but for 3 in 100,000
SET_ROOM = 1 << 23  # shingles of a block
LOOSE = 0.6  # share of agreeing least hashes below which a pair is not compared: 4 spreads under 0.8


def shingle_set(text: str, n: int):
    """Sorted distinct hashes of the n-word shingles."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(s) for s in shingles(words_of(text), n)], np.uint64))


def least_hashes(sets: list, count: int):
    """MinHash of sets (none empty): a row each, a column per hash function."""
    import numpy as np

    factors = np.random.default_rng(SEED).integers(0, 1 << 64, count, np.uint64, endpoint=False) | np.uint64(1)
    out = np.empty((len(sets), count), np.uint64)
    if sets:
        h = np.concatenate(sets)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        for t, f in enumerate(factors):
            m = h * f
            m ^= m >> np.uint64(32)
            out[:, t] = np.minimum.reduceat(m * factors[t - 1], at)
    return out


def _agreeing(batch_sigs, size: int):
    import numpy as np

    return np.frombuffer(b"".join(batch_sigs), np.uint8).reshape(-1, size)


def _groups(batches, names: tuple):
    """(columns) of each run of equal ``names`` in sorted rows; memory holds one run and one batch."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        n = table.num_rows
        if not n:
            continue
        new = np.zeros(n - 1, bool)
        for c in names:
            v = table.column(c).to_numpy()
            new |= v[1:] != v[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1]).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                yield table.slice(a, b - a)
        held = table.slice(cuts[-1])
    if held is not None and held.num_rows > 1:
        yield held


def _first_pairs(members: DataFrame, size: int, loose: float, bucket: int) -> DataFrame:
    """a, b: per node the best loose pair with a lesser node out of the spanning forests of its buckets, which are dealt in parts."""
    def linked(batches):
        import numpy as np
        import pyarrow as pa

        for group in _groups(batches, ("key", "part")):
            ids, sig = group.column("id").to_numpy(), _agreeing(group.column("sig").to_pylist(), size)
            pairs = np.array(_forest(len(ids), lambda i, rest: (sig[i] == sig[rest]).sum(1) >= loose * size), np.int64).reshape(-1, 2)
            if len(pairs):
                a, b = ids[pairs[:, 0]], ids[pairs[:, 1]]
                same = (sig[pairs[:, 0]] == sig[pairs[:, 1]]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(same.astype(np.int64))], names=["a", "b", "same"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.withColumn("part", F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("n") / bucket)))
    return dealt.select("key", "part", "id", "sig").repartition(n, "key", "part").sortWithinPartitions("key", "part", "id") \
        .mapInArrow(linked, "a long, b long, same long").groupBy("b").agg(F.min(F.struct(-F.col("same"), "a")).alias("k")).select("k.a", "b")


def similar(x, y, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``least``."""
    import numpy as np

    small, large = min(len(x), len(y)), max(len(x), len(y))
    if small < least * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (small + large - both)


def _met_before(keys, i: int, rest, key: int):
    """Which of ``rest`` share with ``i`` a bucket of a lesser key than ``key``."""
    import numpy as np

    mine = set(k for k in keys[i] if k < key)
    return np.array([any(k in mine for k in keys[j] if k < key) for j in rest], bool) if mine else np.zeros(len(rest), bool)


def _more_edges(members: DataFrame, labels: DataFrame, sets: DataFrame, size: int, loose: float, least: float, bucket: int) -> DataFrame:
    """a, b: pairs of components of ``labels`` that confirmed pairs join; both together give the components of all close pairs.

    Of a bucket, the members outside its most frequent component meet all members, in blocks of ``bucket`` by ``bucket``
    with their shingle sets.  A block confirms a pair only where no pair has joined its components before, and tells one
    edge for each join: at most one a member.  A pair is looked at in the least of its buckets alone.
    """
    def joined(batches):
        import numpy as np
        import pyarrow as pa

        for group in _groups(batches, ("key", "row", "column")):
            ids, root, few, minor = (group.column(c).to_numpy(zero_copy_only=False).copy() for c in ("id", "label", "few", "minor"))
            label = root.copy()
            key, keys = group.column("key")[0].as_py(), group.column("keys").to_pylist()
            sig = _agreeing(group.column("sig").to_pylist(), size)
            hashes = [np.frombuffer(h.as_buffer(), np.uint64) for h in group.column("hashes")]
            every, edges = np.flatnonzero(~few), []
            for i in np.flatnonzero(few):
                rest = every[root[every] != root[i]]
                rest = rest[~minor[rest] | (ids[i] < ids[rest])]
                same = (sig[i] == sig[rest]).sum(1)
                rest = rest[same >= loose * size][np.argsort(-same[same >= loose * size], kind="stable")]
                if not len(rest):
                    continue
                for j in rest[~_met_before(keys, i, rest, key)].tolist():
                    if root[j] != root[i] and similar(hashes[i], hashes[j], least):
                        edges.append((int(label[i]), int(label[j])))
                        root[root == root[j]] = root[i]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], names=["a", "b"])

    marked = stored(members.join(labels, members["id"] == labels["node"], "left").select("key", "id", "sig", "shingles", F.coalesce("component", "id").alias("label")))
    counts = marked.groupBy("key", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("shingles"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("of"))
    open_ = counts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.sum("of").alias("of"), F.max(F.struct("n", "label")).alias("most")) \
        .filter("most.n < n")
    wide = F.greatest(F.col("n") / bucket, F.col("shingles") / SET_ROOM, F.lit(1))  # blocks are bounded in bytes, too
    # buckets of the same members are one
    split = stored(open_.groupBy("n", "of", "shingles", "most").agg(F.min("key").alias("key")).select(
        "key", F.col("most.label").alias("main"), F.ceil(wide).cast("long").alias("columns"), F.ceil(wide * (1 - F.col("most.n") / F.col("n"))).cast("long").alias("rows")))
    some = stored(marked.join(split, "key").select("key", "id", "sig", "label", "main", "rows", "columns"))
    spots = some.groupBy("id").agg(F.collect_list("key").alias("keys"))  # at most one a band, and a component for each order of the shingles
    full = some.join(spots.join(sets, "id"), "id").withColumn("minor", F.col("label") != F.col("main"))
    spot = F.xxhash64("id", "key")
    every = full.withColumn("column", F.pmod(spot, "columns")).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("few", F.lit(False))
    few = full.filter("minor").withColumn("row", F.pmod(spot, "rows")).withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1))).withColumn("few", F.lit(True))
    fields = ("key", "row", "column", "id", "sig", "label", "few", "minor", "keys", "hashes")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(every.select(*fields).union(few.select(*fields)).repartition(n, "key", "row", "column").sortWithinPartitions("key", "row", "column")
                  .mapInArrow(joined, "a long, b long"))


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of at least ``least``."""
    def compared(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                good[i] = similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    one, two = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    return stored(pairs.join(one, "b").join(two, "a").select("a", "b", "x", "y").mapInArrow(compared, "a long, b long"))


def similar_groups(df: DataFrame, shingle: int = 5, least: float = SIMILAR, bands: int = BANDS, per_band: int = ROWS, loose: float = LOOSE,
                   bucket: int = 8 * BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (hash of the text), copies, group of every distinct (id, text): near copies by word shingles share a group.

    Near copies are texts whose sets of ``shingle``-word shingles have a Jaccard similarity of ``least`` or more, judged
    on the sets; groups are the connected components.  Candidates are in one component of ``near_duplicates``, or agree on one
    of ``bands`` bands of ``per_band`` least hashes each, and agree on a share ``loose`` of all.  A first pass confirms one pair a node; a second one looks at every pair that is
    not in one component by then and tells those that join two, so the groups do not depend on ``bucket``, the members one
    task compares; many texts a little less than ``least`` alike cost a comparison per pair, but no row.  Texts without words are one group.  Repeated rows count as copies; null ids are kept.
    """
    rows = texts(df, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    size = bands * per_band

    def hashed(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in slices(batches, limit=1 << 20):
            sets = [shingle_set(text, shingle) for text in batch.column("text").to_pylist()]
            ids = np.array([xxhash.xxh3_64_intdigest(s) for s in sets], np.uint64).view(np.int64)
            some = [i for i, s in enumerate(sets) if len(s)]
            mins = least_hashes([sets[i] for i in some], size)
            keys = np.zeros((len(some), bands), np.uint64)
            for r in range(per_band):
                keys = (keys ^ mins[:, r::per_band]) * np.uint64(0x9E3779B97F4A7C15)
                keys ^= keys >> np.uint64(29)
            keys = ((keys + np.arange(bands, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
            sigs = (mins & np.uint64(255)).astype(np.uint8)
            of, sig = [[]] * len(sets), [b""] * len(sets)
            for at, i in enumerate(some):
                of[i], sig[i] = keys[at], sigs[at].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(ids), pa.array(of, pa.list_(pa.int64())), pa.array(sig, pa.binary()),
                                              pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "mark", "id", "keys", "sig", "shingles"])

    def listed(batches):
        import pyarrow as pa

        for batch in slices(batches, limit=1 << 20):
            sets = [shingle_set(text, shingle).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "hashes"])

    docs = stored(rows.mapInArrow(hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mark long, id long, keys array<long>, sig binary, shingles long"))
    nodes = stored(docs.dropDuplicates(["id"]).select("id", "mark", "keys", "sig", "shingles"))
    # a component of fingerprints is one more bucket
    linked = near_duplicates(rows, id_col="mark") \
        .select(F.col("doc_id").alias("mark"), F.xxhash64(F.lit("component"), "component_id").alias("key")).distinct()
    worded = docs.filter(F.size("keys") > 0).select("id", "mark").distinct()
    table = nodes.select("id", F.explode("keys").alias("key")).union(worded.join(linked, "mark").select("id", "key").distinct())
    met = table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(table.join(met, "key").join(nodes.select("id", "sig", "shingles"), "id").select("key", "id", "sig", "shingles", "n"))
    first = _first_pairs(members, size, loose, bucket)
    wanted = members.select("id").distinct().join(nodes, "id").select("id", "mark")
    sets = stored(rows.join(wanted, "mark").select("id", "text").mapInArrow(listed, "id long, hashes binary").dropDuplicates(["id"]))
    sure = _confirmed(first, sets, least)
    labels = stored(forest_roots(sure))  # a node has one confirmed pair with a lesser one at most
    more = _more_edges(members, labels, sets, size, loose, least, min(bucket, BUCKET))
    counted = docs.groupBy("doc_id", "mark", "id").agg(F.count(F.lit(1)).alias("copies"))
    named = counted.join(labels, counted["id"] == labels["node"], "left").select("doc_id", "mark", "copies", F.coalesce("component", "id").alias("label"))
    if more.isEmpty():
        return named.withColumnRenamed("label", "group")
    joined = stored(components(more))  # over components, so a row for each that was joined
    return named.join(joined, named["label"] == joined["node"], "left").select(
        "doc_id", "mark", "copies", F.coalesce("component", "label").alias("group"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` without near copies: of each group the row with the least id (then text hash) stays, once.

    Null texts are empty texts; a null id comes after all others; of repeated rows one stays, and of rows with the same id and
    text but other columns any one; all columns are kept, whatever their names; an empty table stays empty.
    """
    groups = stored(similar_groups(df, id_col=id_col, text_col=text_col, **options))
    first = stored(groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "copies")).alias("k"))
                   .select("k.doc_id", "k.mark", "k.copies"))
    marked = df.select(whole_row(df).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_mark"))
    kept = marked.join(first, (marked["text_mark"] == first["mark"]) & marked["id"].eqNullSafe(first["doc_id"]))
    once = kept.filter("copies = 1").select("row.*")
    if first.filter("copies > 1").isEmpty():
        return once
    return once.union(kept.filter("copies > 1").dropDuplicates(["mark", "id"]).select("row.*"))
