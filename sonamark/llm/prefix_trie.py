"""Prefix trie of conversations by time-forward processing.

1. Every turn becomes a digest of (role, text) and a length; texts go no further. Turns are numbered, and what identifies a prefix is summed up, over ranges of
   (conversation, order): each range is streamed, and what a conversation that goes on in the next range has come to is added. A conversation with a third
   of all turns lies in many ranges.
2. A prefix of d turns is named by d and four running sums of 32 bits each of a hash of (position, digest). An aggregate over these names makes the nodes: members,
   smallest member, and a weight, the turns that the members have from there on, which is at least the size of the subtree.
3. Nodes up to a weight of FIT are light. A light node whose parent is not is the root of a shard, its whole subtree, of FIT nodes at most. Heavy
   nodes are at most rows / FIT in a level. A heavy shard is a path: the connected nodes of one weight // FIT, for two children that both had their parent's would
   outweigh it. Heavy shards are at most rows / FIT * (1 + 1/2 + 1/3 + ...), some thousands whatever the input, as FIT grows with it.
4. In each task, the nodes of its shards are sorted externally (by Spark) in reverse level order, and a priority queue in the order of the targets brings
   every node the totals of its children: forward in time, and spilled to unnamed files when it gets long. First come the light shards; then the shard
   tree, in which heavy shards get the sums of what light roots and their own nodes bring; then the nodes of the heavy shards, with all that arrives from below.

Turns are ordered by their number (null first), turns of one number by their digests; repeated rows are turns of their own. A null role or text is empty, a
null conv_id names no conversation, so its rows are left out. Very long texts are only hashed and measured. An empty table has no conversations and gives no
rows. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, split_join, written

#: Least weight of a heavy node, and the share of all rows above which a node is heavy.
LEAST_FIT, SHARE = 1000, 1000
#: Messages that a queue holds in memory; ids of a chunk of a list of ends; names of heavy nodes up to which they are broadcast (some 20 MB).
MOST_MESSAGES, CHUNK, MOST_NAMES = 200_000, 4096, 500_000


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def in_order(rows: DataFrame, group: str, order: list[str], number: str, sums: list[str] | None = None) -> DataFrame:
    """rows with their number within the group (a long) in the given order, from 1, and running sums of long columns in their place; written. Rows lie in ranges of
    (group, order). What a group has come to in the ranges before is a number for each range, so the driver adds them up."""
    sums, spark = sums or [], rows.sparkSession
    n = partitions(rows)
    ranged = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_pid", F.spark_partition_id())
    columns = ranged.columns
    at, places = columns.index(group), [columns.index(s) for s in sums]

    def run(batches):
        last, carried = None, np.zeros(1 + len(sums), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(at).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            sizes = np.diff(np.append(starts, len(g)))
            values = np.stack([np.ones(len(g), np.int64), *(batch.column(k).to_numpy() for k in places)])
            total = np.cumsum(values, axis=1)
            before = total[:, starts] - values[:, starts]
            if last == g[0]:
                before[:, 0] -= carried
            own = total - np.repeat(before, sizes, axis=1)
            last, carried = g[-1], own[:, -1].copy()
            out = list(batch.columns)
            for k, place in enumerate(places):
                out[place] = pa.array(own[1 + k])
            yield pa.RecordBatch.from_arrays([*out, pa.array(own[0])], names=[*columns, number])

    arrow_rows(spark, 8192)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    local = written(ranged.mapInArrow(run, f"{kinds}, `{number}` long"), "ordered")
    running = [number, *sums]
    ends = local.groupBy("_pid").agg(F.min(group).alias("first"), F.max(F.struct(group, *running)).alias("last")).collect()
    current, reached, offsets = None, [], []
    for r in sorted(ends, key=lambda r: r["_pid"]):
        if r["first"] == current:
            offsets.append((r["_pid"], current, *reached))
        own = list(r["last"][1:])
        reached = [a + b for a, b in zip(reached, own)] if r["last"][0] == current else own
        current = r["last"][0]
    if offsets:
        names = [f"_{c}" for c in running]
        table = spark.createDataFrame(offsets, f"_pid int, `{group}` long, " + ", ".join(f"`{c}` long" for c in names))
        local = local.join(F.broadcast(table), ["_pid", group], "left").withColumns({c: F.col(c) + F.coalesce(c_, F.lit(0)) for c, c_ in zip(running, names)})
    return local.select(*(c for c in [*columns, number] if c != "_pid"))


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, i, digest, bytes): every turn with its place in its conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return in_order(rows, "conv", ["turn", "digest"], "i").select("conv", "i", "digest", "bytes")


def spliced(turns: DataFrame, every: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """(rows, convs) of conversations rebuilt so that they share prefixes: c begins with the first h turns of conversation c - c % every, then come its own turns
    after its first h; h is crc32(c as text) % modulus. rows (conv, d, digest, bytes, len), convs (conv, len)."""
    counts = turns.groupBy("conv").agg(F.max("i").alias("n"))
    heads = turns.where((F.col("i") < modulus) & (F.col("conv") % every == 0)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("i", "digest", "bytes"))).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % modulus).cast("int")
    x = counts.withColumns({"base": F.col("conv") - F.col("conv") % every, "h": h}).join(heads, "base", "left")
    x = x.withColumn("head", F.coalesce(F.expr("slice(head, 1, h)"), F.expr("array()").cast(heads.schema["head"].dataType)))
    convs = written(x.select("conv", "n", "h", "head", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("len")), "convs")
    first = convs.select("conv", "len", F.posexplode("head").alias("p", "x")).select("conv", (F.col("p") + 1).cast("long").alias("d"), "x.digest", "x.bytes", "len")
    moved = split_join(turns, convs.select("conv", "h", "len", (F.size("head") - F.col("h")).alias("shift")), "conv", "i", sizes=convs.select("conv", F.col("n").alias("_n")))
    own = moved.where("i > h").select("conv", (F.col("i") + F.col("shift")).alias("d"), "digest", "bytes", "len")
    return first.union(own), convs.select("conv", "len")


def name_of(d: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", d, *sums).cast("binary")))


ROOT = bytes.fromhex(hashlib.md5(b"0,0,0,0,0").hexdigest())


def prefixes(rows: DataFrame) -> DataFrame:
    """rows (conv, d, digest, bytes, len) -> (conv, d, key, parent, bytes, len): the names of each prefix and of the one a turn shorter; written."""
    piece = lambda salt: F.xxhash64(F.lit(salt), "d", "digest")
    halves = [half for s in (1, 2) for half in (piece(s).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(piece(s), 32))]
    own, sums = [f"p{k}" for k in range(4)], [f"s{k}" for k in range(4)]
    x = rows.select("conv", "d", "bytes", "len", *(p.alias(n) for p, n in zip(halves, own)))
    x = in_order(x.withColumns({s: F.col(p) for s, p in zip(sums, own)}), "conv", ["d"], "number", sums)
    names = x.select("conv", "d", name_of(F.col("d"), [F.col(s) for s in sums]).alias("key"), name_of(F.col("d") - 1, [F.col(s) - F.col(p) for s, p in zip(sums, own)]).alias("parent"), "bytes", "len")
    return written(names, "prefixes")


class Messages:
    """Totals on their way to nodes, the deepest target first. Above `most`, those held lie sorted in an unnamed file from then on."""

    FORM = struct.Struct(">q16sqqq")

    def __init__(self, most: int = MOST_MESSAGES):
        self.most, self.held, self.runs, self.spills = most, [], [], 0

    def push(self, depth: int, key: bytes, children: int, leaves: int, saved: int) -> None:
        heapq.heappush(self.held, (-depth, key, children, leaves, saved))
        if len(self.held) > self.most:
            file = tempfile.TemporaryFile()
            for x in sorted(self.held):
                file.write(self.FORM.pack(*x))
            file.seek(0)
            self.held, self.spills = [], self.spills + 1
            self._next(self._read(file), self.spills)

    def _read(self, file):
        with file:
            while part := file.read(self.FORM.size * 4096):
                yield from self.FORM.iter_unpack(part)

    def _next(self, run, number: int) -> None:
        if (first := next(run, None)) is not None:
            heapq.heappush(self.runs, (first, number, run))

    def take(self, depth: int, key: bytes) -> tuple[int, int, int]:
        """The sums of all messages for this node."""
        target, sums = (-depth, key), [0, 0, 0]
        while True:
            if self.held and self.held[0][:2] == target:
                x = heapq.heappop(self.held)
            elif self.runs and self.runs[0][0][:2] == target:
                x, number, run = heapq.heappop(self.runs)
                self._next(run, number)
            else:
                return tuple(sums)
            sums = [a + b for a, b in zip(sums, x[2:])]

    def __len__(self) -> int:
        return len(self.held) + len(self.runs)


TOTALS = "n_children long, n_leaves long, saved_tokens long"


def climbed(nodes: DataFrame, shard: str, most: int = MOST_MESSAGES) -> DataFrame:
    """nodes (key, depth, parent, parent_depth, own_saved, children, leaves, saved, and others) with the totals of their subtrees; children, leaves and saved are what arrives
    from other shards. Messages within a shard go through the queue; the root of a shard (key = shard) sends none. Its column `shard` deals the nodes out."""
    names = nodes.columns
    at = {c: names.index(c) for c in ("key", "depth", "parent", "parent_depth", "own_saved", "children", "leaves", "saved", shard)}

    def run(batches):
        queue = Messages(most)
        for batch in batches:
            out = []
            for key, depth, parent, up, own, c, v, s, root in zip(*(batch.column(k).to_pylist() for k in at.values())):
                children, leaves, saved = map(sum, zip(queue.take(depth, key), (c, v, s)))
                leaves, saved = leaves if children else 1, saved + own
                out.append((children, leaves, saved))
                if key != root:
                    queue.push(up, parent, 1, leaves, saved)
            totals = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, totals.T)], names=[*names, *(x.split()[0] for x in TOTALS.split(", "))])
        if len(queue):
            raise ValueError("totals for a node that is not there")

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    arrow_rows(nodes.sparkSession, 8192)
    return nodes.repartition(partitions(nodes), shard).sortWithinPartitions(F.desc("depth"), "key").mapInArrow(run, f"{kinds}, {TOTALS}")


def ends_of(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of ends (key, conv): the digest of the ids of each key, ascending, joined by commas. Ids are brought into chunks over ranges of (key, id), and the
    chunks of a key are streamed into its digest one after another; no list of them is held."""
    n = partitions(ends)
    ranged = ends.select("key", "conv").repartitionByRange(n, "key", "conv").sortWithinPartitions("key", "conv")

    def chunks(batches):
        for batch in batches:
            out, last = [], None
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == last and len(out[-1][2]) < CHUNK:
                    out[-1][2].append(str(conv))
                else:
                    out.append((key, conv, [str(conv)]))
                    last = key
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([",".join(x[2]) for x in out], pa.string())], names=["key", "first", "ids"])

    def digests(batches):
        last, digest = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key == last:
                    digest.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((last, digest.hexdigest()))
                last, digest = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["key", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    arrow_rows(ends.sparkSession, 8192)
    pieces = ranged.mapInArrow(chunks, "key binary, first long, ids string")
    return pieces.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends_sha256 string")





def arrived(messages: DataFrame) -> DataFrame:
    """(key, children, leaves, saved) of roots' rows, summed up by the node they hang on."""
    return messages.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def with_arrivals(nodes: DataFrame, *messages: DataFrame) -> DataFrame:
    """nodes with the sums of what arrives for them."""
    names = ["children", "leaves", "saved"]
    every = messages[0]
    for m in messages[1:]:
        every = every.unionByName(m)
    sums = every.groupBy("key").agg(*(F.sum(c).alias(c) for c in names))
    return nodes.drop(*names).join(sums, "key", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in names})


def subtree_totals(nodes: DataFrame, rows: DataFrame, fit: int, most: int) -> DataFrame:
    """nodes (key, parent, depth, conv_id, n_convs, bytes, weight) with n_children, n_leaves and saved_tokens; written. rows: prefixes()."""
    zero = F.lit(0).cast("long")
    nodes = nodes.withColumns({"parent_depth": F.col("depth") - 1, "own_saved": (F.col("n_convs") - 1) * F.col("bytes"), "children": zero, "leaves": zero, "saved": zero})
    is_heavy = (F.col("weight") > fit) | (F.col("depth") == 0)
    heavy = written(nodes.where(is_heavy).withColumn("q", F.when(F.col("depth") == 0, F.lit(-1).cast("long")).otherwise(F.floor(F.col("weight") / fit))), "heavy")
    rest = nodes.where(~is_heavy)

    # The shard of a light node: the first light prefix of the conversation that the node is named by. That of a heavy one: its first prefix of the same q.
    below = heavy.where("depth > 0").select("key", "q")
    firsts, some = rows.where("d = 1").select("conv", "key"), below.count()
    if some:

        def meeting(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
            return left.join(F.broadcast(right), key) if some <= MOST_NAMES else split_join(left, right, key, "conv")

        on_path = written(meeting(rows.select("conv", "d", "key"), below, "key"), "on_path")
        next_ones = meeting(rows.select("conv", "key", "parent"), below.select(F.col("key").alias("parent")), "parent").select("conv", "key")
        names = below.select("key")
        firsts = firsts.union(next_ones).join(F.broadcast(names) if some <= MOST_NAMES else names, "key", "left_anti")
        paths = on_path.groupBy(F.col("conv").alias("conv_id"), "q").agg(F.min(F.struct("d", "key")).alias("_s")).select("conv_id", "q", F.col("_s.key").alias("shard"))
        shards = heavy.where("depth > 0").join(paths, ["conv_id", "q"])
        heavy = written(shards.unionByName(heavy.where("depth = 0").withColumn("shard", F.col("key"))), "paths")
    else:
        heavy = heavy.withColumn("shard", F.col("key"))
    roots = written(firsts.select(F.col("conv").alias("conv_id"), F.col("key").alias("shard")), "roots")
    light = written(climbed(split_join(rest, roots, "conv_id", "key"), "shard", most), "light")
    heavy = written(with_arrivals(heavy, arrived(light.where("key = shard").select("parent", "n_leaves", "saved_tokens"))), "met")

    if some:  # across the roots of shards: the tree of heavy shards, some thousands of rows
        inner = heavy.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("c"))
        whole = heavy.join(inner, "key", "left").withColumn("ends", F.when(F.col("children") + F.coalesce("c", F.lit(0)) == 0, F.lit(1)).otherwise(F.lit(0)))
        sums = whole.groupBy("shard").agg(F.sum("children").alias("children"), F.sum(F.col("leaves") + F.col("ends")).alias("leaves"), F.sum("saved").alias("saved"), F.sum("own_saved").alias("own_saved"))
        tops = heavy.where("key = shard").select("key", "depth", F.col("parent").alias("hangs_on"))
        places = heavy.select(F.col("key").alias("hangs_on"), F.col("shard").alias("parent"))
        depths = tops.select(F.col("key").alias("parent"), F.col("depth").alias("parent_depth"))
        # A shard with leaves of its own must not count as one leaf, so the leaves that it has count as arrived from a child.
        tree = tops.join(sums.withColumnRenamed("shard", "key"), "key").join(places, "hangs_on", "left").join(depths, "parent", "left").withColumn("children", F.col("children") + (F.col("leaves") > 0).cast("long"))
        tree = tree.withColumns({"top": F.lit(ROOT), "parent": F.coalesce("parent", F.lit(b"")), "parent_depth": F.coalesce("parent_depth", F.lit(-1).cast("long"))})
        totals = written(climbed(tree, "top", most).select("key", "hangs_on", "n_leaves", "saved_tokens"), "across")
        from_shards = arrived(totals.where("hangs_on is not null").select(F.col("hangs_on").alias("parent"), "n_leaves", "saved_tokens"))
        heavy = with_arrivals(heavy, heavy.select("key", "children", "leaves", "saved"), from_shards)
    done = ["key", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return written(light.select(*done).union(climbed(heavy, "shard", most).select(*done)), "totals")


def trie(rows: DataFrame, convs: DataFrame, fit: int | None = None, most: int = MOST_MESSAGES) -> DataFrame:
    """One row per distinct prefix of conversations: rows (conv, d, digest, bytes, len) has their turns at positions 1 to len, convs (conv, len) all of them, those without
    turns too. Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    named = prefixes(rows)
    size = named.count()
    fit = fit or max(LEAST_FIT, size // SHARE)
    own = named.groupBy("key").agg(F.min("parent").alias("parent"), F.min("d").alias("depth"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.sum(F.col("len") - F.col("d") + 1).alias("weight"))
    top = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    top = top.select(F.lit(ROOT).alias("key"), F.lit(b"").alias("parent"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("bytes"), zero.alias("weight"))
    nodes = written(own.union(top), "nodes")
    totals = subtree_totals(nodes, named, fit, most)
    ends = named.where("d = len").select("key", "conv").union(convs.where("len = 0").select(F.lit(ROOT).alias("key"), "conv"))
    parents = totals.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = split_join(totals.where("depth > 0"), parents, "parent", "key").unionByName(totals.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = out.join(ends_of(ends), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, every: int = 5, modulus: int = 9, fit: int | None = None, most: int = MOST_MESSAGES) -> DataFrame:
    """trie() of conversations that are spliced() first."""
    return trie(*spliced(turns_of(conversations), every, modulus), fit, most)
