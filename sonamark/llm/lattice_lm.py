"""LM scoring by a subword lattice.

The pieces are an existing vocabulary's; no piece is added. A word's probability is the sum over all its segmentations into
pieces of the product of the pieces' unigram probabilities, by a forward recursion in log space over the byte positions. The vocabularies at hand
state no probabilities, so those of the pieces are estimated: first from their ranks, then by one round of expected counts over all training words
(forward and backward). `lattice_score` is the document's probability by these segmentations alone.

`score` adds to it what a lattice of pieces can't know, how often whole words come: a training word is an edge over the whole lattice. With c occurrences
of N its weight is c, against `alpha` for the segmentations (alpha: words seen once, the Good-Turing count of new words), so that

    p(word) = (c + alpha * lattice(word)) / (N + alpha)

is a proper distribution over all words. The end of a document is a token with a fixed small share of the lattice's mass.

A text is in one language, and most words are in few. So there is such a distribution for each class k of training documents (the
values of a label column such as `lang`, which has some tens of them: each is a column here; null is one more), which falls back on p with its own count of new words: p_k = (c_k + b_k * p) / (N_k + b_k).
A document's probability is the sum over the classes, each with its share of the training documents, of the product
of its tokens' p_k: the marginal over classes and over all segmentations. No label is read when a text is scored.

At scale: words are counted in tasks and summed by a shuffle; the word table (which grows with the corpus) is never broadcast.
Each distinct word goes through the lattice once. The HOT most frequent words of at most HOT_BYTES bytes are broadcast
and scored where the text is read; the rest, each rare by then, meets the word table in a join.

Nulls count as the empty text: one token, the end. A null id takes the fold of the empty string. Repeated rows are scored
each. A very long text is counted word by word, a very long word goes through the recursion alone. With no training rows at all the pieces keep the estimate
from their ranks. Empty tables give empty results. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_lexicon import VOCABULARY, byte_chars
from .common import arrow_rows, crc_mod, most_frequent, tokenizer_path, words_of, written

MODULUS, HELD_OUT = 7, 2
HOT, HOT_BYTES = 65_536, 64
END_SHARE = 1e-3
#: Longer words go through the recursion one by one, position by position.
VECTOR_BYTES = 48
STOP = 255  # the byte that stands for the end of a word; UTF-8 has none such
END = b""  # the end of a document, in the word table
A = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_pieces(path: str) -> list[bytes]:
    """Pieces in the vocabulary's order (merges later in the list are rarer), the end of a word as byte 255."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back, end = {c: b for b, c in enumerate(byte_chars())}, model["end_of_word_suffix"]
    return [bytes(back[c] for c in s.removesuffix(end)) + bytes([STOP]) * s.endswith(end) for s, _ in sorted(model["vocab"].items(), key=lambda x: x[1])]


class Lattice:
    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.pieces, self.log_p = pieces, np.append(log_p, -np.inf)
        self.longest, self.at = max(map(len, pieces)), {p: i for i, p in enumerate(pieces)}
        keys = np.zeros(len(pieces), np.uint64)
        for n in {*map(len, pieces)}:
            own = [i for i, p in enumerate(pieces) if len(p) == n]
            block = np.frombuffer(b"".join(pieces[i] for i in own), np.uint8).reshape(-1, n)
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = h * A + block[:, k] + np.uint64(1)
            keys[own] = h
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int64)
        self.slot = np.full(1 << 22, len(pieces), np.int32)
        self.slot_key = np.zeros(1 << 22, np.uint64)
        place = (self.keys * A) >> np.uint64(42)
        self.slot[place], self.slot_key[place] = self.ids, self.keys

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of the hashes; len(pieces), whose probability is 0, where there is none."""
        place = (h * A) >> np.uint64(42)
        out = np.where(self.slot_key[place] == h, self.slot[place], len(self.pieces)).astype(np.int64)
        lost = np.flatnonzero((self.slot_key[place] != h) & (self.slot_key[place] != 0))  # two keys in one slot: look among all
        if len(lost):
            k = np.minimum(np.searchsorted(self.keys, h[lost]), len(self.keys) - 1)
            out[lost] = np.where(self.keys[k] == h[lost], self.ids[k], len(self.pieces))
        return out

    def edges(self, block: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(from, to) -> piece numbers, for words of one length; edges that no word has are left out."""
        out = {}
        n = block.shape[1]
        for i in range(n):
            h = np.zeros(len(block), np.uint64)
            for j in range(i, min(n, i + self.longest)):
                h = h * A + block[:, j] + np.uint64(1)
                found = self.find(h)
                if (found < len(self.pieces)).any():
                    out[i, j + 1] = found
        return out

    def forward(self, words: list[bytes], weights: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """ln of the marginal probability of each word; adds the weighted expected counts of pieces to expected."""
        out = np.empty(len(words))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > VECTOR_BYTES:
                out[k] = self._long(w, 0 if weights is None else weights[k], expected)
            else:
                by_length.setdefault(len(w), []).append(k)
        for n, own in by_length.items():
            block = np.frombuffer(b"".join(words[k] + b"\xff" for k in own), np.uint8).reshape(-1, n + 1)
            edges = self.edges(block)
            f = np.full((n + 2, len(own)), -np.inf)
            f[0] = 0
            for (i, j), found in edges.items():  # in order of i, so f[i] is complete
                f[j] = np.logaddexp(f[j], f[i] + self.log_p[found])
            out[own] = f[n + 1]
            if expected is not None:
                b = np.full((n + 2, len(own)), -np.inf)
                b[n + 1] = 0
                for (i, j), found in reversed(edges.items()):
                    b[i] = np.logaddexp(b[i], b[j] + self.log_p[found])
                for (i, j), found in edges.items():
                    share = np.exp(f[i] + self.log_p[found] + b[j] - f[n + 1]) * weights[own]
                    expected += np.bincount(found, np.nan_to_num(share), len(expected))
        return out

    def _long(self, word: bytes, weight: float, expected: np.ndarray | None) -> float:
        text = word + b"\xff"
        n, at, log_p = len(text), self.at, self.log_p
        f = [-np.inf] * (n + 1)
        f[0], steps = 0.0, []
        for j in range(1, n + 1):
            got = [(i, k, f[i] + log_p[k]) for i in range(max(0, j - self.longest), j) if (k := at.get(text[i:j])) is not None]
            top = max((x for _, _, x in got), default=-np.inf)
            f[j] = top + np.log(sum(np.exp(x - top) for _, _, x in got)) if top > -np.inf else -np.inf
            if expected is not None:
                steps.append(got)
        if expected is not None:
            mass = [0.0] * n + [float(weight)]  # expected number of segmentations through a position
            for j in range(n, 0, -1):
                for i, k, x in steps[j - 1]:
                    part = mass[j] * np.exp(x - f[j])
                    expected[k] += part
                    mass[i] += part
        return f[n]


@lru_cache(2)
def lattice_of(path: str, log_p: bytes | None) -> Lattice:
    pieces = vocabulary_pieces(path)
    p = 1.0 / (np.arange(len(pieces)) + 10.0) if log_p is None else None
    return Lattice(pieces, np.log(p / p.sum()) if log_p is None else np.frombuffer(log_p))


def word_counts(docs: DataFrame, classes: int) -> DataFrame:
    """(word, c0, c1, ...): all words of all documents with their training counts in each class; END with those of documents."""

    def run(batches):
        train, other = [Counter() for _ in range(classes)], set()

        def rows():
            cols = [(w, k, n) for k, count in enumerate(train) for w, n in count.items()] + [(w, 0, 0) for w in other]
            for count in (*train, other):
                count.clear()
            word, k, n = zip(*cols) if cols else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(k, pa.int32()), pa.array(n, pa.int64())], names=["word", "k", "n"])

        for batch in batches:
            for text, held, k in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                words = words_of(text)
                if held:
                    other.update(words)
                else:
                    train[k].update(words)
                    train[k][END] += 1
            if sum(map(len, train)) + len(other) > 200_000:
                yield rows()
        yield rows()

    long = docs.mapInArrow(run, "word binary, k int, n long")
    return long.groupBy("word").agg(*(F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(classes)))


def classes_of(docs: DataFrame, class_col: str | None) -> list[str]:
    """The labels of training documents."""
    if class_col is None:
        return []
    return sorted(r.label for r in docs.where(~F.col("held_out") & F.col("label").isNotNull()).select("label").distinct().collect())


def piece_scores(words: DataFrame, path: str) -> bytes:
    """ln probabilities of the pieces after one round of expected counts over the training words. As many rows as the vocabulary has
    pieces come to the driver, whatever the corpus."""

    def run(batches):
        lattice = lattice_of(path, None)
        expected = np.zeros(len(lattice.pieces) + 1)
        for batch in batches:
            lattice.forward(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float), expected)
        some = np.flatnonzero(expected[:-1])
        yield pa.RecordBatch.from_pydict({"piece": pa.array(some, pa.int64()), "n": pa.array(expected[some], pa.float64())})

    counts = words.where((F.col("c") > 0) & (F.octet_length("word") > 0)).select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return lattice_of(path, None).log_p[:-1].tobytes()
    n = np.full(len(vocabulary_pieces(path)), 0.01)
    n[counts["piece"].to_numpy()] += counts["n"].to_numpy()
    return np.log(n / n.sum()).tobytes()


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", path: str | None = None, modulus: int = MODULUS, held_out: int = HELD_OUT) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score."""
    spark, path = docs.sparkSession, path or tokenizer_path(VOCABULARY)
    class_col = class_col if class_col in docs.columns else None
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (crc_mod(F.col(id_col), modulus) == held_out).alias("held_out"), F.col(class_col).cast("string").alias("label") if class_col else F.lit(None).cast("string").alias("label"))
    labels = classes_of(docs, class_col)
    m = len(labels) + 1  # the last for no label
    number = F.lit(m - 1)
    for k, label in enumerate(labels):
        number = F.when(F.col("label") == label, k).otherwise(number)
    docs = docs.select("doc_id", "text", "held_out", number.alias("k"))
    own = [f"c{k}" for k in range(m)]
    arrow_rows(spark)
    words = written(word_counts(docs, m).withColumn("c", sum((F.col(x) for x in own[1:]), F.col("c0"))), "words")
    once = [F.count_if(F.col(x) == 1).alias(f"once_{x}") for x in own] + [F.coalesce(F.sum(x), F.lit(0)).alias(f"n_{x}") for x in own]
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once"), *once).first()
    ends = words.where(F.octet_length("word") == 0).first()
    n, v, alpha = total["n"], total["v"], max(1, total["once"])
    n_k, beta = (np.array([max(least, total[f"{what}_{x}"]) for x in own], float) for what, least in (("n", 0), ("once", 1)))
    share = np.array([(ends[x] if ends else 0) + 1.0 for x in own])
    prior = np.log10(share / share.sum()).tolist()
    arrow_rows(spark, 65_536)  # words, not texts
    log_p = piece_scores(words, path)

    def score(batches):
        lattice = lattice_of(path, log_p)
        for batch in batches:
            word, c = batch.column(0).to_pylist(), np.array([batch.column(i + 1) for i in range(m)], float).T
            free = np.where([w == END for w in word], np.log(END_SHARE), lattice.forward(word) + np.log1p(-END_SHARE))
            with np.errstate(divide="ignore"):
                ln = np.logaddexp(np.log(c.sum(axis=1)), np.log(alpha) + free) - np.log(n + alpha)
                lp = (np.logaddexp(np.log(c), np.log(beta) + ln[:, None]) - np.log(n_k + beta)) / np.log(10)
            seen = c.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seen.astype(np.int64)), pa.array(np.log10((seen + 1) / (n + v + 1))), pa.array(free / np.log(10)), *(pa.array(x) for x in lp.T)], names=["word", "c", "base", "lattice", *lps])

    lps = [f"lp{k}" for k in range(m)]
    doubles = ", ".join(f"{x} double" for x in lps)
    scored = written(words.select("word", *own).mapInArrow(score, f"word binary, c long, base double, lattice double, {doubles}"), "scored")
    arrow_rows(spark)
    top = most_frequent(scored.where(F.octet_length("word") <= HOT_BYTES), "c", HOT).toPandas()
    hot = spark.sparkContext.broadcast(({bytes(w): i for i, w in enumerate(top["word"])}, np.column_stack([top["c"] > 0, top["base"], top["lattice"], *(top[x] for x in lps)]).astype(float)))

    def sums(batches):
        """A row with the sums over frequent words for each document, and a row for each other word in it."""
        place, table = hot.value
        for batch in batches:
            uids, words, ks, n_tokens, totals = [], [], [], [], []
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count = Counter(words_of(text))
                count[END] += 1
                at = [place.get(w, -1) for w in count]
                k, at_np = np.fromiter(count.values(), float, len(count)), np.array(at)
                rare = [w for w, i in zip(count, at) if i < 0]
                uids += [uid] * (1 + len(rare))
                words += [None, *rare]
                ks += [0, *k[at_np < 0].astype(int).tolist()]
                n_tokens += [count.total(), *[None] * len(rare)]
                totals += [(k[at_np >= 0] @ table[at_np[at_np >= 0]]).tolist(), *[none] * len(rare)]
            arrays = [pa.array(uids, pa.int64()), pa.array(words, pa.binary()), pa.array(ks, pa.int64()), pa.array(n_tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(x, pa.float64()) for x in zip(*totals))], names=["uid", "word", "k", "n_tokens", "seen", "base", "lattice", *lps])

    none = [None] * (m + 3)
    named = docs.withColumn("uid", F.monotonically_increasing_id())
    ids = written(named.select("uid", "doc_id", "held_out"), "ids")
    parts = written(named.select("uid", "text").mapInArrow(sums, f"uid long, word binary, k long, n_tokens long, seen double, base double, lattice double, {doubles}"), "parts")
    rare = parts.where("word is not null").select("uid", "word", "k").join(scored, "word")
    rare = rare.select("uid", F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("k")).otherwise(0).cast("double").alias("seen"), *((F.col("k") * F.col(x)).alias(x) for x in ("base", "lattice", *lps)))
    heads = parts.where("word is null").select("uid", "n_tokens", "seen", "base", "lattice", *lps)
    out = heads.union(rare).groupBy("uid").agg(*(F.sum(x).alias(x) for x in ("n_tokens", "seen", "base", "lattice", *lps)))
    joint = F.array(*(F.col(x) + p for x, p in zip(lps, prior)))
    most = F.array_max(joint)
    score = most + F.log10(F.aggregate(joint, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - most)))
    return ids.join(out, "uid").select("doc_id", "held_out", "n_tokens", F.col("seen").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score"), F.col("lattice").alias("lattice_score"))
