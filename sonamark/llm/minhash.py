"""Near-duplicate groups by b-bit MinHash.

1. One pass over the texts makes, for each document, its set of distinct word shingles (64-bit hashes), minima under PERMUTATIONS
   hashings, the low bits of the minima packed into longs, and a hash for each band of minima. Documents of equal sets
   are one node from here on, so thousands of copies cost one row.
2. Candidates: nodes that share a band. The members of a band's bucket are compared with its centre, the member that shares most
   and largest buckets, so m members give m - 1 pairs, and the buckets of one group choose the same centre. The sizes of the sets must allow
   the threshold, and the packed low bits give a similarity, corrected for chance collisions, by XOR and bit counts; pairs far below the
   threshold (by more than SLACK, 4.5 standard errors) go. The others are confirmed on the full sets, and confirmed links are joined into components.
3. Nodes whose buckets still hold several components are compared across components by their rarest shingles. Two sets that are near enough
   share one of the first shingles in the order of rarity (how many of these nodes have it, then the hash), and their places in the order bound how
   much they can share. Shingles are paired only where the sizes fall into two given classes, since the sizes decide how far the order must be read. A
   shingle that one component alone has makes no pair, and members of the component that most of a shingle's nodes belong to aren't paired among
   themselves; pairs are estimated and confirmed as in 2. Where more than FEW members of that component have the shingle, its other nodes are not paired with
   each of them either: a node and the component become one row, and the node's full set meets the members' full sets in cells of at most CELL
   shingles a side, which put out links only. This finds every link that the centres missed, whatever the size of a bucket.

With 32 bands of four, a pair of similarity 0.75 shares no band with probability 5e-6. Joins on a key that many rows may share (a group's centre, a
component, a common shingle) are salted for the keys that have more than 1/PIECES of the rows.

Nulls and texts without words have the empty set: n_shingles 0, linked with nothing, their own component. Fewer words than a
shingle make one shingle of all of them. Null ids take part in links but name no component unless a component has no other id. Repeated
rows are copies of one another. Empty tables give empty results; columns other than the two named are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_rows, discard, fresh, row_hash, split_join, words_of, written

WORDS, THRESHOLD = 5, 75
PERMUTATIONS, BANDS, BITS = 128, 32, 4
ROWS = PERMUTATIONS // BANDS
LONGS = PERMUTATIONS * BITS // 64
SLACK = 0.18
#: Sizes of sets are classed by powers of this.
CLASS = 1.05
#: Members of one component that a shingle may pair one by one; shingles on either side of a cell (a set alone may have more).
FEW, CELL = 32, 500_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit over 64."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


word_hashes = WordHashes()


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    n = len(words)
    if not n:
        return np.zeros(0, U)
    w = np.fromiter(map(word_hashes.__getitem__, words), U, n)
    size = min(n, size)
    h = np.full(n - size + 1, size, U)
    for k in range(size):
        h = mix(h * U(0x9E3779B97F4A7C15) + w[k : n - size + 1 + k])
    return np.unique(h)


@lru_cache(2)
def hashings(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(count).integers(0, 1 << 32, (2, count, 1), dtype=np.uint32)
    return draw[0] | np.uint32(1), draw[1]


def minima(hashes: np.ndarray, count: int = PERMUTATIONS) -> np.ndarray:
    a, b = hashings(count)
    low, out, step = (hashes >> U(32)).astype(np.uint32), np.full(count, 0xFFFFFFFF, np.uint32), max(64, (1 << 17) // count)
    for at in range(0, len(low), step):
        np.minimum(out, (low[at : at + step] * a + b).min(axis=1), out=out)
    return out


def packed(minimum: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum, in longs."""
    low = (minimum & np.uint32((1 << BITS) - 1)).astype(U).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(low.shape[1], dtype=U) * U(BITS)), axis=1).view(np.int64)


def band_hashes(minimum: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=U)
    for k in range(ROWS):
        h = mix(h * U(0x9E3779B97F4A7C15) + minimum.reshape(BANDS, ROWS)[:, k].astype(U))
    return h.view(np.int64)


def similarity(a: Column, b: Column) -> Column:
    """Estimate from packed low bits: the share of equal slots, corrected for slots that agree by chance."""
    slots = sum(1 << (BITS * i) for i in range(64 // BITS))
    slots = slots - (1 << 64) if slots >= 1 << 63 else slots
    differ = None
    for i in range(LONGS):
        x = a[i].bitwiseXOR(b[i])
        k = 1
        while k < BITS:  # any bit of a slot that differs, into its lowest
            x, k = x.bitwiseOR(F.shiftrightunsigned(x, k)), 2 * k
        x = F.bit_count(x.bitwiseAND(F.lit(slots)))
        differ = x if differ is None else differ + x
    chance = 2.0**-BITS
    return (1 - differ / PERMUTATIONS - chance) / (1 - chance)


def sketches(docs: DataFrame, id_col: str, text_col: str, row_cols: list[str] | None = None) -> DataFrame:
    """(uid, id, n_shingles, node, sig, bands, body, row_a, row_b): uid numbers the row, node names the set of shingles; body is the compressed words; row_a and
    row_b are passed on from row_cols, if these are given."""
    marks = [F.col(c) for c in row_cols] if row_cols else [F.lit(None).cast("long")] * 2
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(m.alias(n) for m, n in zip(marks, ("row_a", "row_b"))))

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            n, node, sig, bands, body = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                hashes = shingles(words)
                n.append(len(hashes))
                if not len(hashes):
                    for c in (node, sig, bands, body):
                        c.append(None)
                    continue
                low = minima(hashes)
                node.append(xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63))
                sig.append(packed(low))
                bands.append(band_hashes(low))
                body.append(squeeze.compress(b" ".join(words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64())), pa.array(body, pa.binary()), batch.column(3), batch.column(4)],
                names=["uid", "id", "n_shingles", "node", "sig", "bands", "body", "row_a", "row_b"],
            )

    arrow_rows(docs.sparkSession)
    return written(rows.mapInArrow(run, "uid long, id long, n_shingles long, node long, sig array<long>, bands array<long>, body binary, row_a long, row_b long"), "sketches")


def confirmed(pairs: DataFrame, nodes: DataFrame, sketch: DataFrame, threshold: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= threshold * union; written."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "uid"), "node")
    bodies = written(sketch.select("uid", "body").join(wanted, "uid").select("node", "body"), "bodies")
    both = split_join(pairs, bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), "a", "b")
    both = split_join(both, bodies.select(F.col("node").alias("b"), F.col("body").alias("y")), "b", "a", like=pairs)

    def run(batches):
        expand = zstandard.ZstdDecompressor()
        full = lru_cache(64)(lambda body: shingles(expand.decompress(body).split(b" ")))
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = full(x), full(y)
                shared = len(p) + len(q) - len(np.unique(np.concatenate((p, q))))
                keep.append(100 * shared >= threshold * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    discard(bodies)
    return links


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable over links (a, b); nodes without a link are absent. Each round takes the least label
    of the neighbours and then the label's own label, so long chains halve; every round is written."""
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    table = labels
    for _ in range(most_rounds):
        near = split_join(edges, labels.withColumnRenamed("node", "b"), "b", "a").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
        stepped = written(labels.join(near, "node").select("node", F.least("label", "other").alias("step"), F.col("label").alias("was")), "stepped")
        jump = labels.select(F.col("node").alias("step"), F.col("label").alias("far"))
        after = split_join(stepped, jump, "step", "node")
        after = written(after.select("node", F.least("step", "far").alias("label"), (F.least("step", "far") < F.col("was")).alias("moved")), "labels")
        discard(stepped, table)
        labels, table = after.select("node", "label"), after
        if after.where("moved").isEmpty():
            discard(edges)
            return labels
    raise RuntimeError("components did not settle")


def size_class(n: Column) -> Column:
    return F.floor(F.ln(n.cast("double")) / math.log(CLASS) + 1e-9).cast("int")


def in_cell(x: pa.Table, y: pa.Table, threshold: int) -> pa.Table:
    """Pairs (a, b) of a node of x and one of y whose full sets are near enough, by an index of y's shingles."""
    out = []
    if x.num_rows and y.num_rows:
        sets = [v.values.to_numpy() for v in y.column("g")]
        n, nodes = np.array([len(v) for v in sets]), y.column("node").to_numpy()
        all_of, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        order = np.argsort(all_of, kind="stable")
        all_of, owner = all_of[order], owner[order]
        for node, own in zip(x.column("node").to_pylist(), (v.values.to_numpy() for v in x.column("h"))):
            first, last = np.searchsorted(all_of, own), np.searchsorted(all_of, own, "right")
            size = last - first
            at = np.repeat(last - np.cumsum(size), size) + np.arange(size.sum())
            shared = np.bincount(owner[at], minlength=len(sets))
            near = 100 * shared >= threshold * (len(own) + n - shared)
            out += [(min(node, other), max(node, other)) for other in nodes[near].tolist()]
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    return pa.table({"a": a, "b": b})


def across(rest: DataFrame, nodes: DataFrame, sketch: DataFrame, threshold: int, few: int = FEW, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """For rest (node, label, n): pairs (a, b) of different labels that can have 100 * intersection >= threshold * union, by their rarest shingles; and
    links (a, b) that do have it, between nodes and large labels. Together no link is missing."""

    def unpack(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            sets = [shingles(expand.decompress(b).split(b" ")).view(np.int64) for b in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.list_(pa.int64()))], names=["node", "label", "n", "h"])

    bodies = sketch.select("uid", "body").join(rest.join(nodes.select("node", "uid"), "node"), "uid").select("node", "label", "n", "body")
    sets = written(bodies.mapInArrow(unpack, "node long, label long, n long, h array<long>"), "sets")
    rows = sets.select("node", "label", "n", F.explode("h").alias("h"))
    rarity = written(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "rarity")
    # Shingles of one node only come first in its order, and make no pair.
    own = W.partitionBy("node")
    common = split_join(rows, rarity, "h", "node", sizes=rarity.select("h", F.col("df").alias("_n")))
    ranked = common.withColumn("at", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "h")) - 1)
    # The set may have n * threshold / 100 to n * 100 / threshold shingles in common with others of such sizes: one row for each class of sizes.
    least, most = F.ceil(F.col("n") * threshold / 100), F.floor(F.col("n") * 100 / threshold)
    other = ranked.where(F.col("at") <= F.col("n") * (100 - threshold) / 100).withColumns({"c": size_class(F.col("n")), "o": F.explode(F.sequence(size_class(least), size_class(most)))})
    smallest = F.greatest(least, F.floor(F.pow(F.lit(CLASS), F.col("o"))))
    read = F.col("n") - F.ceil(threshold * (F.col("n") + smallest) / (100 + threshold))
    key = ["h", "lo", "hi"]
    firsts = written(other.where(F.col("at") <= read).select("h", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), (F.col("c") > F.col("o")).alias("larger"), "node", "label"), "firsts")
    main = firsts.groupBy(*key, "label").agg(F.count("*").alias("m")).groupBy(*key).agg(F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    main = main.select(*key, F.col("top.label").alias("main"), (F.col("top.m") > few).alias("large"))
    placed = written(firsts.join(main, key).withColumn("is_main", F.col("label") == F.col("main")), "placed")
    discard(rarity, firsts)

    x = placed.where("not is_main").select(*key, F.col("node").alias("x"), F.col("label").alias("lx"), F.col("larger").alias("gx"))
    y = placed.where("not (is_main and large)").select(*key, F.col("node").alias("y"), F.col("label").alias("ly"), F.col("larger").alias("gy"), "is_main")
    sides = ((F.col("lo") == F.col("hi")) | (F.col("gx") != F.col("gy"))) & (F.col("is_main") | (F.col("x") < F.col("y")))
    pairs = x.join(y, key).where((F.col("lx") != F.col("ly")) & sides).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    asked = written(placed.where("large and not is_main").select("node", F.col("main").alias("label")).distinct().join(rest.select("node", "n"), "node"), "asked")
    blocks = lambda df, name: df.groupBy("label").agg(F.ceil(F.sum("n") / cell).cast("int").alias(name))
    cells = written(blocks(asked, "bx").join(blocks(rest, "by"), "label"), "cells")
    piece = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = split_join(asked, cells, "label", "node").select("node", "label", piece("bx").alias("i"), each("by").alias("j"))
    right = split_join(rest, cells, "label", "node").select("node", "label", each("bx").alias("i"), piece("by").alias("j"))
    full = [sets.select(F.col("node").alias("node"), F.col("h").alias(h)) for h in "hg"]  # of two names, since the sides are one table
    grouped = [df.join(f, "node").select(*(F.col(c).alias(c) for c in ("label", "i", "j", "node")), F.col(f.columns[1])).groupBy("label", "i", "j") for df, f in zip((left, right), full)]
    links = written(grouped[0].cogroup(grouped[1]).applyInArrow(lambda a, b: in_cell(a, b, threshold), "a long, b long").distinct(), "found")
    pairs = written(pairs, "candidates")
    discard(sets, placed, asked, cells)
    return pairs, links


def labelled(sketch: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(node, least_id, label): label names the component of each node."""
    some = sketch.where(F.col("node").isNotNull())
    nodes = written(some.groupBy("node").agg(F.min("uid").alias("uid"), F.min("id").alias("least_id")), "nodes")
    sigs = written(sketch.select("uid", "sig", "bands", F.col("n_shingles").alias("n")).join(nodes.select("uid", "node"), "uid").select("node", "sig", "n", "bands"), "sigs")
    bands = sigs.select("node", F.explode("bands").alias("bucket"))
    shared = written(bands.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    members = written(split_join(bands, shared, "bucket", "node", sizes=shared.select("bucket", F.col("m").alias("_n"))), "members")

    def estimated(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose sizes and packed low bits allow the threshold; written."""
        every = pairs = written(pairs, f"{name}-all")
        for k, x, other in (("a", "x", "b"), ("b", "y", "a")):
            pairs = split_join(pairs, sigs.select(F.col("node").alias(k), F.col("sig").alias(f"s{x}"), F.col("n").alias(f"n{x}")), k, other)
        sizes = 100 * F.least("nx", "ny") >= threshold * F.greatest("nx", "ny")
        out = written(pairs.where(sizes & (similarity(F.col("sx"), F.col("sy")) >= threshold / 100 - SLACK)).select("a", "b"), name)
        discard(every)
        return out

    common = written(members.groupBy("node").agg(F.struct(F.sum(F.ln("m")).alias("weight"), "node").alias("rank")), "common")
    placed = written(members.join(common, "node").select("bucket", "node", "rank"), "ranked")
    centres = placed.groupBy("bucket").agg(F.max("rank").alias("c")).select("bucket", F.col("c.node").alias("centre"))
    stars = split_join(placed.select("bucket", "node"), centres, "bucket", "node").where("node != centre")
    pairs = estimated(stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "pairs")
    links = confirmed(pairs, nodes, sketch, threshold)
    labels = components(links)

    owned = written(members.select("bucket", "node").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "owned")
    mixed = owned.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    rest = split_join(owned, mixed, "bucket", "node").select("node", "label").distinct().join(sigs.select("node", "n"), "node")
    rest = written(rest, "rest")
    discard(shared, members, common, placed, owned)
    if not rest.isEmpty():
        candidates, found = across(rest, nodes, sketch, threshold)
        more = estimated(candidates.join(pairs, ["a", "b"], "left_anti"), "more")
        confirmed_now = confirmed(more, nodes, sketch, threshold)
        new = confirmed_now.union(found)
        if not new.isEmpty():
            labels = components(links.union(new))
        discard(candidates, more, confirmed_now, found)
    out = written(nodes.join(labels, "node", "left").select("node", "least_id", F.coalesce("label", "node").alias("label")), "labelled")
    discard(nodes, sigs, rest, pairs, links)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    sketch = sketches(docs, id_col, text_col)
    own, some = labelled(sketch, threshold), sketch.where(F.col("node").isNotNull()).select("id", "n_shingles", "node")
    named = split_join(own, own.groupBy("label").agg(F.min("least_id").alias("component_id")), "label", "node").select("node", "component_id")
    full = split_join(some, named, "node", "id").select("id", "n_shingles", "component_id")
    out = full.union(sketch.where(F.col("node").isNull()).select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, its columns unchanged: the one with the smallest id, whatever rows share that id; a null id stays only
    where there is no other. Rows are told apart by two hashes of all their columns, in columns whose names no column of docs has; of rows that are equal
    throughout, one stays."""
    names = [fresh(docs, "row_a"), fresh(docs, "row_b")]
    rows = docs.withColumns({n: row_hash(docs, k) for k, n in enumerate(names)})
    sketch = sketches(rows, "doc_id", "text", names)
    key = F.struct(F.col("id").isNull().alias("none"), "id", "row_a", "row_b")
    best = sketch.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(key).alias("best"))
    own = labelled(sketch).select("node", "label")
    stay = own.join(best, "node").groupBy("label").agg(F.min("best").alias("best")).select(*(F.col(f"best.{k}").alias(n) for k, n in zip(("row_a", "row_b"), names)))
    empty = sketch.where(F.col("node").isNull()).select(*(F.col(k).alias(n) for k, n in zip(("row_a", "row_b"), names)))
    lone = rows.join(empty, names, "left_semi")  # without words: none is a copy of another, repeated rows stay
    return rows.join(stay, names, "left_semi").dropDuplicates(names).union(lone).select(*(F.col(f"`{c}`") for c in docs.columns))
