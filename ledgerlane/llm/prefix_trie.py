"""Conversations as a prefix trie, counted on balanced parentheses, shard by shard.

A conversation's path is a row of bytes: 20 for each turn, the MD5 of its role and text and the size of its text.
Sorted paths are in the trie's depth-first order, so a run of them is a forest whose parentheses a task can write
down.  What the run's neighbours may share with it, the nodes on its first and its last path (its spines), goes up with
counts of what hangs on them; runs of spines merge in the same way until one is left.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

RECORD = 20  # bytes of a path for a turn
RUN_NODES = 1 << 18  # of a run, and of the last one
BLOCK = 64  # parentheses of a block with its least excess
RUN_PATHS = 8  # of a run at least: it leaves two
PIECE = 1 << 20  # characters of listed ids in a row
NO_ONE = hashlib.sha256(b"").hexdigest()
NEVER = (1 << 63) - 1  # above every conv_id

ITEM = T.StructType([
    T.StructField("path", T.BinaryType()), T.StructField("ends", T.ArrayType(T.StringType())),
    *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("n", "low", "leaves", "saved", "children")]])
NODE = T.StructType([
    *[T.StructField(c, T.LongType()) for c in ("conv_id", "depth", "parent_conv_id")],
    *[T.StructField(c, T.LongType()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    T.StructField("ends_sha256", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("parent_key", T.BinaryType())])
STEP = T.StructType([T.StructField("item", ITEM), T.StructField("node", NODE)])


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with the least excess of blocks, and of pairs of them up to the whole."""

    def __init__(self, bits):
        import numpy as np

        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int32) * 2 - 1, dtype=np.int32)
        self.opens = np.flatnonzero(bits)
        blocks = 1 << max(0, (len(bits) - 1) // BLOCK).bit_length()
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[:len(bits)] = self.excess
        self.padded = padded
        self.least = [padded.reshape(blocks, BLOCK).min(axis=1)]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(axis=1))
        pair = bits.astype(bool)
        pair[:-1] &= ~bits[1:].astype(bool)
        self.pairs = pair  # positions of "()"

    def _inside(self, position, goal, ends):
        """First place from ``position`` on, before the block's end ``ends``, whose excess is at most ``goal``; -1 for none."""
        import numpy as np

        found, open_ = np.full(len(position), -1, np.int64), np.arange(len(position))
        at = position.copy()
        while len(open_):
            open_ = open_[at[open_] < ends[open_]]
            hit = self.padded[at[open_]] <= goal[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
        return found

    def findclose(self, opens):
        """Positions where the parentheses opened at ``opens`` are closed."""
        import numpy as np

        goal = self.excess[opens] - 1
        found = self._inside(opens + 1, goal, (opens // BLOCK + 1) * BLOCK)
        far = np.flatnonzero(found < 0)
        if len(far):
            node, want = opens[far] // BLOCK, goal[far]
            level, down = np.zeros(len(far), np.int64), np.zeros(len(far), bool)
            for height in range(len(self.least)):  # up, until the pair's right half goes low enough
                here = np.flatnonzero(~down & (level == height))
                if not len(here):
                    continue
                right = node[here] ^ 1
                low = (node[here] % 2 == 0) & (self.least[height][np.minimum(right, len(self.least[height]) - 1)] <= want[here])
                node[here[low]] = right[low]
                down[here[low]] = True
                rest = here[~low]
                node[rest] //= 2
                level[rest] += 1
            for height in range(len(self.least) - 1, 0, -1):  # down, to the leftmost block that does
                here = np.flatnonzero(level == height)
                left = node[here] * 2
                node[here] = np.where(self.least[height - 1][left] <= want[here], left, left + 1)
                level[here] -= 1
            found[far] = self._inside(node * BLOCK, want, (node + 1) * BLOCK)
        return found


class Run:
    """Consecutive paths being gathered; ``close`` counts their trie."""

    def __init__(self):
        self.path, self.stack = b"", []
        self.bits, self.depth, self.parent, self.size, self.first = [], [], [], [], []
        self.weights: dict = {}
        self.nodes = self.paths = 0

    def add(self, path: bytes, item: dict) -> None:
        """The next path in order; the lists of ``item`` are of its last nodes."""
        same, before, length = 0, self.path, len(path)
        while same < min(len(before), length) and before[same:same + RECORD] == path[same:same + RECORD]:
            same += RECORD
        common = same // RECORD
        if self.stack:
            self.bits.append(bytes(len(self.stack) - 1 - common))
            del self.stack[common + 1:]
            first = common + 1
        else:
            first = 0
        deep = length // RECORD
        self.bits.append(b"\1" * (deep + 1 - first))
        for d in range(first, deep + 1):
            self.parent.append(self.stack[-1] if self.stack else -1)
            self.depth.append(d)
            self.size.append(int.from_bytes(path[d * RECORD - 4:d * RECORD], "big") if d else 0)
            self.stack.append(self.nodes)
            self.nodes += 1
        if not self.first:
            self.first, self.first_path = list(self.stack), path
        self.path = path
        self.paths += 1
        offset = deep + 1 - len(item["n"])
        for k, (n, low, leaves, saved, children, ends) in enumerate(zip(*(item[c] for c in ("n", "low", "leaves", "saved", "children", "ends")))):
            node = self.stack[offset + k]
            if node in self.weights:  # a spine in two pieces
                w = self.weights[node]
                n, low, leaves, saved, children, ends = n + w[0], min(low, w[1]), leaves + w[2], saved + w[3], children + w[4], ends or w[5]
            if n or leaves or saved or children or ends:
                self.weights[node] = (n, low, leaves, saved, children, ends)

    def close(self, last: bool, keyed: bool):
        """(rows of whole nodes, items of the spines); with ``last`` every node is whole.

        Whole nodes have a ``key`` if ``keyed``; a node under a spine has its ``parent_key`` in place of the parent's conv_id.
        """
        import numpy as np

        count = self.nodes
        bits = np.frombuffer(b"".join(self.bits) + bytes(len(self.stack)), np.uint8)
        depth, parent, size = (np.array(v, np.int64) for v in (self.depth, self.parent, self.size))
        n, low, leaves, saved, children = (np.zeros(count, np.int64) for _ in range(5))
        low[:] = NEVER
        ends = [None] * count
        for node, w in self.weights.items():
            n[node], low[node], leaves[node], saved[node], children[node], ends[node] = w
        text = Parentheses(bits)
        opens = text.opens
        close = text.findclose(opens)
        after = np.arange(count) + (close - opens + 1) // 2  # in preorder, the node behind the subtree

        def below(values):
            total = np.concatenate([[0], np.cumsum(values)])
            return total[after] - total[:-1]

        whole = np.ones(count, bool)
        if not last:
            whole[self.first] = False
            whole[self.stack] = False
        n_convs = below(n)
        first = smallest(low, after)
        kids = children + np.bincount(parent[1:], minlength=count) if count > 1 else children.copy()
        # leaf pairs by rank; a pair that has children in another run is none
        paired = text.pairs.copy()
        paired[opens[(children > 0) | ~whole]] = False
        rank = np.concatenate([[0], np.cumsum(paired)])
        n_leaves = rank[close + 1] - rank[opens] + below(leaves)
        own = np.where(whole, (n_convs - 1) * size, 0)
        n_saved = below(own) + below(saved)

        hung = whole & (parent >= 0) & ~whole[parent]
        wanted, hash_of, keys = set(parent[hung].tolist()), {}, {}
        for spine, path in ((self.first, self.first_path), (self.stack, self.path)) if wanted else ():
            state = hashlib.md5()
            for d, node in enumerate(spine):
                state.update(path[max(d - 1, 0) * RECORD:d * RECORD])
                if node in wanted:
                    hash_of[node] = state.digest()
        if keyed:
            at: list = []  # hash states of the nodes above, by depth
            for node, (d, record) in enumerate(zip(self.depth, self.records)):
                del at[d:]
                state = at[-1].copy() if at else hashlib.md5()
                state.update(record)
                at.append(state)
                if whole[node]:
                    keys[node] = state.digest()
        rows = []
        columns = [c.tolist() for c in (first, depth, n_convs, kids, n_leaves, n_saved)]
        for node in np.flatnonzero(whole).tolist():
            p = self.parent[node]
            rows.append({
                "conv_id": columns[0][node], "depth": columns[1][node], "parent_conv_id": columns[0][p] if p >= 0 and whole[p] else None,
                "n_convs": columns[2][node], "n_children": columns[3][node], "n_leaves": columns[4][node], "saved_tokens": columns[5][node],
                "ends_sha256": ends[node] or NO_ONE, "key": keys.get(node), "parent_key": hash_of.get(p)})
        if last:
            return rows, []
        # what hangs on the spines
        up = parent[hung]
        np.add.at(n, up, n_convs[hung])
        np.minimum.at(low, up, first[hung])
        np.add.at(leaves, up, n_leaves[hung])
        np.add.at(saved, up, n_saved[hung])
        np.add.at(children, up, 1)
        items, told = [], set()
        for spine, path in ((self.first, self.first_path), (self.stack, self.path)):
            if items and path == self.first_path:
                break
            new = [node not in told for node in spine]
            told.update(spine)

            def of(values, none=0):
                return [values[node] if fresh else none for node, fresh in zip(spine, new)]

            items.append({"path": path, "ends": of(ends, None), "n": of(n.tolist()), "low": of(low.tolist(), NEVER),
                          "leaves": of(leaves.tolist()), "saved": of(saved.tolist()), "children": of(children.tolist())})
        return rows, items


class KeyedRun(Run):
    """A run that keeps the nodes' path records, for their keys."""

    def __init__(self):
        super().__init__()
        self.records: list = []

    def add(self, path: bytes, item: dict) -> None:
        had = self.nodes
        super().add(path, item)
        for d in self.depth[had:]:
            self.records.append(path[max(d - 1, 0) * RECORD:d * RECORD])


def smallest(values, after):
    """Least of ``values`` from each place up to, not with, ``after``: by tables of powers of two."""
    import numpy as np

    table = [values]
    step = 1
    width = after - np.arange(len(values))
    out = values.copy()
    most = int(width.max()) if len(width) else 0
    level = np.frexp(width.astype(np.float64))[1] - 1  # floor(log2(width))
    k = 0
    while step <= most:
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[-1][here], table[-1][after[here] - step])
        if 2 * step <= most:
            wider = table[-1].copy()
            wider[:-step] = np.minimum(table[-1][:-step], table[-1][step:])
            table = [wider]
        step *= 2
        k += 1
    return out


def counted(items: DataFrame, last: bool, keyed: bool, run_nodes: int) -> DataFrame:
    """Runs of the sorted ``items`` of each partition: rows of (item, node), one of them null."""
    def steps(batches):
        import pyarrow as pa

        kind = KeyedRun if keyed else Run
        run = kind()

        def told():
            rows, spines = run.close(last, keyed)
            for a in range(0, len(rows), 10_000):
                yield [{"item": None, "node": r} for r in rows[a:a + 10_000]]
            if spines:
                yield [{"item": s, "node": None} for s in spines]

        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(STEP)
        for batch in batches:
            for item in batch.to_pylist():
                run.add(item["path"], item)
                if not last and run.nodes >= run_nodes and run.paths >= RUN_PATHS:
                    for part in told():
                        yield pa.RecordBatch.from_pylist(part, schema)
                    run = kind()
        if run.nodes:
            for part in told():
                yield pa.RecordBatch.from_pylist(part, schema)

    return stored(items.mapInArrow(steps, STEP))


def ends_hashes(members: DataFrame) -> DataFrame:
    """path_id, ends: SHA-256 of the conv_ids (decimal, ascending, comma-joined) of ``members`` (path_id, conv_id).

    Ids are listed in pieces by range-sorted partitions, so a path that very many conversations follow is listed by many
    tasks; only the pieces, a row for about a million characters, meet where the hash runs over them.
    """
    spark = members.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def listed(batches):
        import pyarrow as pa

        path, first, ids, size = None, None, [], 0
        out: dict = {"path_id": [], "first": [], "piece": []}

        def end():
            out["path_id"].append(path)
            out["first"].append(first)
            out["piece"].append(",".join(ids))

        for batch in batches:
            for p, c in zip(batch.column("path_id").to_pylist(), batch.column("conv_id").to_pylist()):
                if p != path or size > PIECE:
                    if ids:
                        end()
                    path, first, ids, size = p, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield pa.RecordBatch.from_pydict(out, schema)
            out = {k: [] for k in out}
        if ids:
            end()
            yield pa.RecordBatch.from_pydict(out, schema)

    def hashed(batches):
        import pyarrow as pa

        path, state = None, None
        for batch in batches:
            out: dict = {"path_id": [], "ends": []}
            for p, piece in zip(batch.column("path_id").to_pylist(), batch.column("piece").to_pylist()):
                if p != path:
                    if state:
                        out["path_id"].append(path)
                        out["ends"].append(state.hexdigest())
                    path, state = p, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield pa.RecordBatch.from_pydict(out, hashes)
        if state:
            yield pa.RecordBatch.from_pydict({"path_id": [path], "ends": [state.hexdigest()]}, hashes)

    import pyarrow as pa

    schema = pa.schema([("path_id", pa.binary()), ("first", pa.int64()), ("piece", pa.string())])
    hashes = pa.schema([("path_id", pa.binary()), ("ends", pa.string())])
    pieces = members.repartitionByRange(n, "path_id", "conv_id").sortWithinPartitions("path_id", "conv_id") \
        .mapInArrow(listed, "path_id binary, first long, piece string")
    return pieces.repartition(n, "path_id").sortWithinPartitions("path_id", "first").mapInArrow(hashed, "path_id binary, ends string")


def paths(df: DataFrame, take: Column, group: Column, most: int, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, path of every rebuilt conversation: the first ``take`` turns of conversation ``group``, then its own behind its first ``take``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    mark = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    record = F.concat(mark, F.lower(F.lpad(F.hex(F.octet_length(text)), 8, "0")))
    turns = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), record.alias("record")).filter("conv_id is not null")
    # a conversation and the one it borrows from meet in one exchange
    dealt = turns.withColumn("borrowed", group).repartition("borrowed")
    own = dealt.groupBy("borrowed", "conv_id").agg(F.unhex(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "record"))), lambda t: t["record"]), "")).alias("own"))
    from pyspark.sql import Window

    head = F.max(F.when(F.col("conv_id") == F.col("borrowed"), F.substring("own", 1, most * RECORD))).over(Window.partitionBy("borrowed"))
    whole = own.withColumn("head", F.coalesce(head, F.lit(b""))).withColumn("take", take)
    path = F.concat(F.substring("head", F.lit(1), F.col("take") * RECORD), F.substring("own", F.col("take") * RECORD + 1, F.length("own")))
    return whole.select("conv_id", path.alias("path"))


def prefix_trie(df: DataFrame, every: int = 5, modulus: int = 9, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", run_nodes: int = RUN_NODES) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are ordered by turn (null first; equal turns by the MD5 of role and text, repeated rows stay).  Conversation c
    takes the first h = crc32(c) % ``modulus`` turns of conversation c - c % ``every`` and goes on with its own
    after its first h.  Null roles and texts are empty; rows without conv_id belong to no conversation; a
    conversation may end without turns and is then a member of the root alone; an empty table gives no row;
    other columns are ignored.

    Texts are hashed where they are read and move no further.  Equal rebuilt conversations are counted before they are
    sorted; a beginning that very many share is spread over runs and its counts are merged from their spines.
    One conversation's path is one value, of 20 bytes a turn.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    take = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    group = F.col("conv_id") - F.col("conv_id") % every
    rebuilt = stored(paths(df, take, group, modulus - 1, conv_col, turn_col, role_col, text_col).withColumn("path_id", F.unhex(F.md5("path"))))
    ends = ends_hashes(rebuilt.select("path_id", "conv_id"))
    distinct = rebuilt.groupBy("path_id", "path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    zero = F.array(F.lit(0).cast("long"))
    items = distinct.join(ends, "path_id").select(
        "path", F.array("ends").alias("ends"), F.array("n").alias("n"), F.array("low").alias("low"),
        zero.alias("leaves"), zero.alias("saved"), zero.alias("children"))
    step = counted(items.repartitionByRange(n, "path").sortWithinPartitions("path"), False, False, run_nodes)
    whole = [step.filter("node is not null").select("node.*")]
    while True:
        items = step.filter("item is not null").select("item.*")
        size = items.agg(F.sum(F.length("path") / RECORD + 1).alias("nodes"), F.count(F.lit(1)).alias("items")).first()
        last = (size["nodes"] or 0) <= run_nodes or size["items"] <= 2 * RUN_PATHS
        parts = max(1, min(n, int((size["nodes"] or 0) // run_nodes), size["items"] // (2 * RUN_PATHS)))
        dealt = items.coalesce(1) if last else items.repartitionByRange(parts, "path")  # the last: the nodes of one run
        step = counted(dealt.sortWithinPartitions("path"), last, True, run_nodes)
        whole.append(step.filter("node is not null").select("node.*"))
        if last:
            break
    nodes = whole[0]
    for more in whole[1:]:
        nodes = nodes.unionByName(more)
    spines = whole[1]
    for more in whole[2:]:
        spines = spines.unionByName(more)
    out = [f.name for f in NODE if f.name not in ("key", "parent_key")]
    known = nodes.filter("parent_key is null").select(*out)
    parents = spines.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    hung = nodes.filter("parent_key is not null").join(parents, "parent_key").withColumn("parent_conv_id", F.col("_parent")).select(*out)
    return known.unionByName(hung)
