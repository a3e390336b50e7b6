"""Ranked lexical search: exact maximum inner products over ball trees of sparse vectors.

1. The items asked for are cut into blocks of some thousand terms; a block's vocabulary is broadcast. One pass over the whole texts of all documents gives each document's
   length and how often it has each of these terms, a vector without the terms that no item of the block asks for, since they add to no score. Document
   frequencies, and with them the terms' weights, come from all documents.
2. Documents become shards of bounded size, each a ball tree over the vectors of weight times saturated frequency: a node's documents lie within a radius of a
   centroid, as a whole and in each coordinate. Splits are at the median between two documents far apart. Shards are written as a table, the index.
3. An item's score of a document is the product of the item's counts with the vector, so that centroid product plus norm times radius bounds the scores of a subtree;
   so does the sum over the item's terms of centroid plus radius of the coordinate, which is the largest value below the node and an integer. The smaller of
   both counts. Radii and bounds are rounded up by more than what floating point can have lost. Subtrees are visited best-first and dropped once their bound is
   below what the result needs; leaves are scored in 64-bit integers, exactly. The terms of a document that an item doesn't ask for widen the whole radius, so
   where texts have little in common it is the coordinates that prune.
4. Best-first across shards too: roots' bounds name the few shards that promise most for an item; the k-th best score in these is a floor that the search of all
   shards starts from. Each shard returns at most k documents for an item, and the best of them are merged by pieces, then by item.

Terms are the maximal matches of TERM, with only A-Z lower-cased. A null or empty text, or one without a term, is no document for the counts and has no score.
Ties of score go by ascending doc_id, null ids last. Repeated documents are ranked each, repeated items are answered each. Very long texts are read whole. No item
or no document: no rows. Columns other than id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_rows, discard, written

#: The terms, for SQL: what is neither a letter nor a digit of ASCII nor beyond it stands between them.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
#: Terms of a block of items (more only for a single item); documents of a leaf, of a shard, and vector entries of a shard; cells of a shard's centroids.
BLOCK_TERMS, LEAF, SHARD, ENTRIES, CELLS = 8192, 16, 4096, 1_000_000, 8_000_000
#: Shards searched first for each item; pieces in which an item's candidates are merged.
PROBES, PIECES = 4, 64


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


class BallTree:
    """Documents as rows of (term, value), values already saturated; weights turn them into the vectors that the tree is grown over."""

    def __init__(self, ids, nulls, ptr, idx, val, lo, hi, left, radius, weights):
        self.ids, self.nulls, self.ptr, self.idx, self.val = ids, nulls, ptr, idx, val
        self.lo, self.hi, self.left, self.radius, self.weights = lo, hi, left, radius, weights
        self.x = self.val * weights[self.idx].astype(float)

    @staticmethod
    def rows(ptr: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the entries of these rows one after another, where each row starts among them)."""
        sizes = ptr[order + 1] - ptr[order]
        starts = np.cumsum(sizes) - sizes
        return np.repeat(ptr[order] - starts, sizes) + np.arange(sizes.sum()), starts

    @classmethod
    def grown(cls, ids, nulls, ptr, idx, val, weights, leaf: int = LEAF) -> BallTree:
        x, n, terms = val * weights[idx].astype(float), len(ids), len(weights)
        order, bounds, left, at = np.arange(n), [(0, n)], [-1], 0
        while at < len(bounds):
            lo, hi = bounds[at]
            if hi - lo > leaf:
                own = order[lo:hi]
                place, starts = cls.rows(ptr, own)
                i, v = idx[place], x[place]
                norms = np.add.reduceat(v * v, starts)

                def farthest(point):
                    row = own[np.argmax(norms - 2 * np.add.reduceat(v * point[i], starts))]
                    out = np.zeros(terms)
                    out[idx[ptr[row] : ptr[row + 1]]] = x[ptr[row] : ptr[row + 1]]
                    return out

                one = farthest(np.bincount(i, v, terms) / len(own))
                along = np.add.reduceat(v * (farthest(one) - one)[i], starts)
                order[lo:hi] = own[np.argsort(along, kind="stable")]
                left[at] = len(bounds)
                bounds += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
                left += [-1, -1]
            at += 1
        place, starts = cls.rows(ptr, order)
        lo, hi = np.array(bounds).T
        tree = cls(ids[order], nulls[order], np.append(starts, len(place)), idx[place], val[place], lo, hi, np.array(left), np.zeros(len(lo)), weights)
        tree.radius = np.array([tree._reach(k) for k in range(len(lo))])
        return tree

    def centroid(self, node: int) -> np.ndarray:
        a, b = self.ptr[self.lo[node]], self.ptr[self.hi[node]]
        return np.bincount(self.idx[a:b], self.x[a:b], len(self.weights)) / (self.hi[node] - self.lo[node])

    def _reach(self, node: int) -> float:
        """No document of the node is farther from its centroid than this: the rounding of sums of so many terms is added."""
        c, starts = self.centroid(node), self.ptr[self.lo[node] : self.hi[node]]
        a, b = starts[0], self.ptr[self.hi[node]]
        v, own = self.x[a:b], c[self.idx[a:b]]
        inner, norms, square = np.add.reduceat(v * (v - 2 * own), starts - a), np.add.reduceat(v * v, starts - a), c @ c
        lost = (len(c) + np.diff(np.append(starts, b)).max() + 16) * 2.0**-50 * (norms.max() + square)
        return math.sqrt(max(0.0, float((inner + square).max())) + lost) * (1 + 2.0**-40)

    def plane(self) -> np.ndarray:
        """Centroids of all nodes, a row for each term."""
        return np.ascontiguousarray(np.stack([self.centroid(k) for k in range(len(self.lo))]).T)

    def tops(self) -> np.ndarray:
        """The largest value of each term below each node (centroid plus radius of that coordinate), a row for each term."""
        out = np.zeros((len(self.lo), len(self.weights)), np.int64)
        for node in range(len(self.lo) - 1, -1, -1):  # children have higher numbers
            if (child := self.left[node]) >= 0:
                np.maximum(out[child], out[child + 1], out=out[node])
            else:
                a, b = self.ptr[self.lo[node]], self.ptr[self.hi[node]]
                np.maximum.at(out[node], self.idx[a:b], self.val[a:b])
        return np.ascontiguousarray(out.T)

    def bounds(self, plane: np.ndarray, tops: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """No document below a node has a larger score."""
        own = counts.astype(float)
        whole = (own @ plane[terms] + math.sqrt(float(own @ own)) * self.radius) * (1 + (len(terms) + 16) * 2.0**-50) + 1
        each = (counts * self.weights[terms]) @ tops[terms]  # integers, exact
        return np.minimum(whole, each * (1 + 2.0**-50))

    def best(self, plane: np.ndarray, tops: np.ndarray, terms: np.ndarray, counts: np.ndarray, k: int, floor: int, asked: np.ndarray) -> list[tuple[int, bool, int]]:
        """At most k of (score, null id, id) with a score of at least floor, and above 0. asked is a buffer of zeros for all terms."""
        bound = self.bounds(plane, tops, terms, counts).tolist()
        asked[terms] = counts * self.weights[terms]
        held, todo = [], [(-bound[0], 0)]
        while todo:
            least = max(floor, held[0][0]) if len(held) == k else floor
            upper, node = heapq.heappop(todo)
            if -upper < least:
                break
            if self.left[node] >= 0:
                for child in (int(self.left[node]), int(self.left[node]) + 1):
                    heapq.heappush(todo, (-bound[child], child))
                continue
            lo, hi = self.lo[node], self.hi[node]
            a, b = self.ptr[lo], self.ptr[hi]
            scores = np.add.reduceat(asked[self.idx[a:b]] * self.val[a:b], self.ptr[lo:hi] - a)
            for at in np.flatnonzero(scores >= max(least, 1)).tolist():
                entry = (int(scores[at]), -int(self.nulls[lo + at]), -int(self.ids[lo + at]))
                if len(held) < k:
                    heapq.heappush(held, entry)
                elif entry > held[0]:
                    heapq.heapreplace(held, entry)
        asked[terms] = 0
        return [(s, bool(null), -i) for s, null, i in held]

    FORM = {"ids": np.int64, "nulls": np.bool_, "ptr": np.int64, "idx": np.int32, "val": np.int32, "lo": np.int32, "hi": np.int32, "left": np.int32, "radius": np.float64}

    def packed(self) -> list[bytes]:
        return [getattr(self, k).astype(t).tobytes() for k, t in self.FORM.items()]

    @classmethod
    def unpacked(cls, parts: list[bytes], weights: np.ndarray) -> BallTree:
        a = {k: np.frombuffer(p, t) for (k, t), p in zip(cls.FORM.items(), parts)}
        return cls(*(v.astype(np.int64) if k in ("idx", "val", "lo", "hi") else v for k, v in a.items()), weights)


def counted_items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(q, item_id, terms, counts): q numbers the rows; written."""
    rows = items.select(F.monotonically_increasing_id().alias("q"), F.col(item_col).alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            counts = [Counter(words_of(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))], names=["q", "item_id", "terms", "counts"])

    arrow_rows(items.sparkSession)
    return written(rows.mapInArrow(run, f"q long, item_id {kind}, terms array<binary>, counts array<long>"), "items")


def vectors(docs: DataFrame, places: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, idx, tf): terms with repeats, and those of `places` with how often they occur; written."""
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches):
        known = shared.value
        names = known.keys()
        for batch in batches:
            n, idx, tf = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                n.append(len(words))
                c = Counter(words)
                own = sorted((known[w], c[w]) for w in c.keys() & names)
                idx.append([a for a, _ in own])
                tf.append([b for _, b in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(idx, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], names=["id", "n", "idx", "tf"])

    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return written(rows.mapInArrow(run, "id long, n long, idx array<int>, tf array<int>"), "vectors")


def index(rows: DataFrame, weights: np.ndarray, documents: int, length: int, leaf: int, most: int) -> DataFrame:
    """A row for each shard: the root's centroid (root_idx, root_val) and radius, and the tree's arrays; written. rows: vectors() that aren't empty."""
    most = max(leaf, min(most, CELLS * leaf // (2 * max(1, len(weights)))))
    parts = list(BallTree.FORM)

    def grown(held):
        at = [pa.chunked_array([b.column(k) for b in held]).combine_chunks() for k in range(4)]
        idx, tf = at[2].flatten().to_numpy(), at[3].flatten().to_numpy().astype(np.int64)
        sizes = np.diff(at[2].offsets.to_numpy())
        long = 100 - 25 + (25 * at[1].to_numpy() * documents) // length
        val = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(long, sizes))
        tree = BallTree.grown(at[0].fill_null(0).to_numpy(), at[0].is_null().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes)), idx, val, weights, leaf)
        root = tree.centroid(0)
        places = np.flatnonzero(root)
        values = [places.astype(np.int32).tobytes(), root[places].tobytes(), float(tree.radius[0]), *tree.packed()]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["root_idx", "root_val", "root_radius", *parts])

    def run(batches):
        held, docs, entries = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, leaf):
                part = batch.slice(at, leaf)
                held.append(part)
                docs, entries = docs + part.num_rows, entries + len(part.column(2).flatten())
                if docs + leaf > most or entries >= ENTRIES:
                    yield grown(held)
                    held, docs, entries = [], 0, 0
        if held:
            yield grown(held)

    arrow_rows(rows.sparkSession, 1024)
    shards = rows.mapInArrow(run, "root_idx binary, root_val binary, root_radius double, " + ", ".join(f"`{p}` binary" for p in parts))
    return written(shards.withColumn("shard", F.monotonically_increasing_id()), "shards")


def promising(shards: DataFrame, queries: list, weights: np.ndarray, probes: int) -> dict[int, list[int]]:
    """shard -> the places in queries of the items for which it is one of the `probes` shards whose roots have the highest bounds."""
    n = len(weights)

    def run(batches):
        best: list[list] = [[] for _ in queries]
        for batch in batches:
            for shard, i, v, radius in zip(*(c.to_pylist() for c in batch.columns)):
                root = np.zeros(n)
                root[np.frombuffer(i, np.int32)] = np.frombuffer(v, float)
                for held, (_, terms, counts) in zip(best, queries):
                    entry = (float(counts @ root[terms] + math.sqrt(float(counts @ counts)) * radius), shard)
                    (heapq.heappush if len(held) < probes else heapq.heappushpop)(held, entry)
        rows = [(at, b, s) for at, held in enumerate(best) for b, s in held]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], names=["at", "bound", "shard"])

    roots = shards.select("shard", "root_idx", "root_val", "root_radius").mapInArrow(run, "at long, bound double, shard long")
    top = roots.withColumn("r", F.row_number().over(W.partitionBy("at").orderBy(F.desc("bound"), "shard"))).where(F.col("r") <= probes)
    out: dict[int, list[int]] = {}
    for r in top.select("at", "shard").collect():  # `probes` rows for an item of the block
        out.setdefault(r.shard, []).append(r.at)
    return out


def searched(shards: DataFrame, queries: list, weights: np.ndarray, k: int, floors: list[int], only: dict[int, list[int]] | None = None) -> DataFrame:
    """(q, id, score): at most k documents of a shard for each item, or for those that `only` names."""
    columns = ["shard", *BallTree.FORM]
    shared = shards.sparkSession.sparkContext.broadcast((queries, weights, floors, only))

    def run(batches):
        queries, weights, floors, only = shared.value
        asked = np.zeros(len(weights), np.int64)
        for batch in batches:
            for shard, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                tree, out = BallTree.unpacked(parts, weights), []
                plane, tops = tree.plane(), tree.tops()
                for at in range(len(queries)) if only is None else only.get(shard, ()):
                    q, terms, counts = queries[at]
                    out += [(q, None if null else i, s) for s, null, i in tree.best(plane, tops, terms, counts, k, floors[at], asked)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["q", "id", "score"])

    arrow_rows(shards.sparkSession, 1)
    some = shards if only is None else shards.where(F.col("shard").isin(list(only)))
    return some.select(*columns).mapInArrow(run, "q long, id long, score long")


def merged(found: DataFrame, k: int) -> DataFrame:
    """(q, id, score, rank): the k best of each item, first within pieces of its candidates."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    pieces = found.withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(PIECES)))
    local = pieces.withColumn("r", F.row_number().over(W.partitionBy("q", "piece").orderBy(*order))).where(F.col("r") <= k)
    return local.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k).drop("r", "piece")


def search_block(docs: DataFrame, block: list, k: int, id_col: str, text_col: str, leaf: int, most: int, probes: int) -> DataFrame:
    """merged() for items (q, terms, counts) of one block."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms, _ in block for t in terms})
    places = {t: i for i, t in enumerate(vocabulary)}
    rows = vectors(docs, places, id_col, text_col)
    documents, length = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(rows.select(F.explode("idx").alias("i")).groupBy("i").agg(F.count("*")).collect())  # a number for each term of the block
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
    shards = index(rows.where(F.size("idx") > 0), weights, documents, length, leaf, most)
    discard(rows)
    queries = []
    for q, terms, counts in block:
        at = np.array([places[t] for t in terms])
        order = np.argsort(at)
        queries.append((q, at[order], np.array(counts, np.int64)[order]))
    first = promising(shards, queries, weights, probes)
    floors = dict(merged(searched(shards, queries, weights, k, [1] * len(queries), first), k).where(F.col("rank") == k).select("q", "score").collect())
    out = written(merged(searched(shards, queries, weights, k, [floors.get(q, 1) for q, _, _ in queries]), k), "best")
    discard(shards)
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", leaf: int = LEAF, most: int = SHARD, block_terms: int = BLOCK_TERMS, probes: int = PROBES) -> DataFrame:
    """item_id, rank (int), doc_id, score (long): the k documents with the highest scores above 0 for each item."""
    asked = counted_items(items, item_col, item_text).where(F.size("terms") > 0)
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    results = []
    for b in range(blocks):  # items are collected one block at a time, to be broadcast
        block = [(r.q, [bytes(t) for t in r.terms], r.counts) for r in asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "terms", "counts").collect()]
        if block:
            results.append(search_block(docs, block, k, id_col, text_col, leaf, most, probes))
    if not results:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("score")).limit(0)
    best = reduce(DataFrame.union, results)
    return best.join(asked.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
